"""Ordered traces: run-length compression, workflows, transitions, first-k, call depth.

A trace has run_id, seq (order within the run) and role; everything is a window or an
aggregation by run, so runs are spread over the cluster and never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import profiles as P
from ..functions.columns import role


def compressed(trace: DataFrame) -> DataFrame:
    """The trace without steps that repeat the role of the step before."""
    w = Window.partitionBy("run_id").orderBy("seq")
    return trace.withColumn("before", F.lag("role").over(w)).where("before is null or before <> role").drop("before")


#: How roles are called in a narrative.
ROLE_NAMES = {
    "api": "API boundary",
    "validation": "validation",
    "orchestration": "orchestration",
    "domain_decision": "domain decision",
    "side_effect": "side effect",
    "persistence": "persistence",
    "internal": "internal computation",
}


def workflows(trace: DataFrame) -> DataFrame:
    """run_id, steps, signature ("a -> b -> c") of every run's compressed roles, and the same
    as a narrative."""
    c = compressed(trace).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role"))).alias("s"))
    named = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
    said = lambda x: F.coalesce(F.try_element_at(named, x["role"]), x["role"])
    return c.select("run_id", F.size("s").cast("long").alias("steps"), F.array_join(F.transform("s", lambda x: x["role"]), " -> ").alias("signature"), F.array_join(F.transform("s", said), " -> ").alias("narrative"))


def flow_roles(flow: DataFrame) -> DataFrame:
    """flow (source, target, type: node ids) -> from_role, to_role, n: runtime calls, or edges
    without a type, between the roles that the ids name."""
    kind = F.upper(F.trim(F.coalesce("type", F.lit(""))))
    rows = flow.where((kind == "") | (kind == "RUNTIME_CALL")).select(role(F.col("source")).alias("from_role"), role(F.col("target")).alias("to_role"))
    return rows.groupBy("from_role", "to_role").agg(F.count("*").alias("n"))


def transitions(trace: DataFrame, flow: DataFrame | None = None) -> DataFrame:
    """from_role, to_role, n over adjacent compressed steps, and over flow_roles of a flow."""
    w = Window.partitionBy("run_id").orderBy("seq")
    t = compressed(trace).withColumn("to_role", F.lead("role").over(w)).where("to_role is not null")
    steps = t.groupBy(F.col("role").alias("from_role"), "to_role").agg(F.count("*").alias("n"))
    return steps if flow is None else steps.unionByName(flow_roles(flow)).groupBy("from_role", "to_role").agg(F.sum("n").alias("n"))


def templates(trace: DataFrame, k: int = 12) -> DataFrame:
    """signature, n, rank: the k most frequent workflows (a top-k report)."""
    c = workflows(trace).groupBy("signature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "signature").limit(k)
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "signature")))


def first_distinct(trace: DataFrame, k: int = 10) -> DataFrame:
    """run_id, node_id, rank: the first k different nodes of every run, in order of first sight."""
    first = trace.groupBy("run_id", "node_id").agg(F.min("seq").alias("seq"))
    w = Window.partitionBy("run_id").orderBy("seq", "node_id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("run_id", "node_id", "rank")


def causal_score(trace: DataFrame) -> DataFrame:
    """One row: runs, role coverage, direct api-to-persistence steps, the score, and the issues
    (codes in the order of profiles.CAUSAL_ISSUES).

    An empty trace scores 1 and has no issues.
    """
    roles = P.EXPECTED_ROLES
    seen = trace.agg(*[F.max((F.col("role") == r).cast("int")).alias(r) for r in roles], F.countDistinct("run_id").alias("runs"), F.count("*").alias("calls"))
    direct = transitions(trace).where("from_role = 'api' and to_role = 'persistence'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("direct"))
    one = seen.crossJoin(F.broadcast(direct))
    has = {r: F.coalesce(r, F.lit(0)) > 0 for r in roles}
    have = sum((h.cast("int") for h in has.values()), F.lit(0))
    coverage = have / len(roles)
    ends = has["side_effect"] | has["persistence"]
    decides = has["validation"] | has["orchestration"] | has["domain_decision"]
    penalty = (
        0.45 * (1 - coverage)
        + F.when(~decides, 0.20).otherwise(0.0)
        + F.when(~ends, 0.20).otherwise(0.0)
        + F.least(F.lit(0.15), 0.02 * F.col("direct"))
        + F.when(F.col("runs") == 0, 0.25).otherwise(0.0)
    )
    score = F.when(F.col("runs") == 0, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - penalty), 3))
    ran = F.col("calls") > 0
    holds = (ran & (F.col("runs") == 0), ran & ~has["api"], ran & ~decides, ran & ~ends, F.col("direct") > 0)
    issues = F.array_compact(F.array(*[F.when(h, code) for code, h in zip(P.CAUSAL_ISSUES, holds)]))
    return one.select("runs", F.round(coverage, 3).alias("coverage"), F.col("direct").cast("long").alias("direct"), score.alias("score"), issues.alias("issues"))


def call_depths(trace: DataFrame) -> DataFrame:
    """Adds depth to call rows (run_id, seq, caller, node_id): one more than the caller's
    last depth in the run; 2 for a caller not seen before, 1 without a caller.

    An ordered fold: runs are streamed in order through each task, so a run of any length
    takes the memory of its distinct nodes only.
    """
    schema = "run_id string, seq long, node_id string, depth long"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, depth = None, {}
        for rows in batches:
            out = []
            for r, caller, node in zip(rows["run_id"], rows["caller"], rows["node_id"]):
                if r != run:
                    run, depth = r, {}
                d = depth.get(caller, 1) + 1 if caller else 1
                depth[node] = d
                out.append(d)
            yield pd.DataFrame({"run_id": rows["run_id"], "seq": rows["seq"], "node_id": rows["node_id"], "depth": out})

    n = int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = trace.select(F.col("run_id").cast("string").alias("run_id"), "seq", "caller", "node_id").repartition(n, "run_id").sortWithinPartitions("run_id", "seq")
    return ordered.mapInPandas(fold, schema)


def step(stack: list, event: str, node) -> int | None:
    """One event on a stack of calls: a call is pushed and has the depth that it gives, a return
    pops its node only if that is on top."""
    if event == "call":
        stack.append(node)
        return len(stack)
    if event == "return" and stack and stack[-1] == node:
        stack.pop()
    return None


def call_stacks(trace: DataFrame) -> DataFrame:
    """run_id, seq, node_id, depth of the call rows of a trace (run_id, seq, event, node_id), by
    a stack a run.  Runs are streamed in order through each task, with one stack in memory."""
    kinds = {c: trace.schema[c].dataType.simpleString() for c in ("run_id", "seq", "node_id")}

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, stack = None, []
        for rows in batches:
            depth = []
            for r, event, node in zip(rows["run_id"], rows["event"], rows["node_id"]):
                if r != run:
                    run, stack = r, []
                depth.append(step(stack, event, node))
            kept = rows[["run_id", "seq", "node_id"]].assign(depth=pd.array(depth, "Int64"))
            yield kept[kept["depth"].notna()]

    n = int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = trace.where("run_id is not null").select("run_id", "seq", "event", "node_id").repartition(n, "run_id").sortWithinPartitions("run_id", "seq")
    return ordered.mapInPandas(fold, f"{', '.join(f'{c} {k}' for c, k in kinds.items())}, depth long")
