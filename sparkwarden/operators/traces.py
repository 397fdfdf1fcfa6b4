"""Aggregates of runtime traces: runs, labels, the runtime gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import profiles as P
from ..functions.columns import any_of, node_path, normalize_path, ratio
from .pairs import FEW
from .tables import counted, stored

#: Calls of a source, from which on they are made distinct before they come together.
MANY_CALLS = 100_000


def run_counters(trace: DataFrame) -> DataFrame:
    """trace (run_id, event, node_id, depth) -> run_id, events, calls, imports, nodes, max_depth.

    Late and partial runs are kept as they are.
    """
    event = F.col("event")
    return trace.groupBy("run_id").agg(F.count("*").alias("events"), F.count_if(event == "call").alias("calls"), F.count_if(event == "import").alias("imports"), F.countDistinct(F.when(event == "call", F.col("node_id"))).alias("nodes"), F.max("depth").alias("max_depth"))


def run_label(timed_out: Column, exit_code: Column, calls: Column, imports: Column, events: Column) -> Column:
    """Label of a run; a timeout that left events is a partial success."""
    return (
        F.when(timed_out & (events > 0), "PARTIAL_SUCCESS")
        .when(timed_out, "TIMEOUT")
        .when(exit_code != 0, "CRASHED")
        .when(calls > 0, "CALL_ACTIVITY")
        .when(imports > 0, "IMPORT_ONLY")
        .when(events == 0, "NO_OP")
        .otherwise("NO_CALL_ACTIVITY")
    )


def flow_edges(trace: DataFrame) -> DataFrame:
    """Distinct runtime call edges: source, target."""
    return trace.where("event = 'call' and caller is not null and caller <> ''").select(F.col("caller").alias("source"), F.col("node_id").alias("target")).distinct()


def trace_summary(trace: DataFrame) -> DataFrame:
    """One row: runs, events, calls, distinct nodes and edges."""
    pair = F.when((F.col("event") == "call") & (F.col("caller") != ""), F.struct("caller", "node_id"))
    return trace.agg(F.countDistinct("run_id").alias("runs"), F.count("*").alias("events"), F.count_if(F.col("event") == "call").alias("calls"), F.countDistinct(F.when(F.col("event") == "call", F.col("node_id"))).alias("nodes"), F.countDistinct(pair).alias("edges"))


def module_hits(trace: DataFrame) -> DataFrame:
    """module, hits: calls of each module (trace: event, module)."""
    return trace.where("event = 'call' and module <> ''").groupBy("module").agg(F.count("*").alias("hits"))


#: Where a run came from.
ORIGINS = ("seed", "continuation", "import_followup", "forced_probe")


def run_summary(trace: DataFrame, runs: DataFrame, nodes: DataFrame, before: DataFrame, target: float = 0.0) -> DataFrame:
    """One row over all runs of a plan.

    trace: run_id, event, node_id; runs: run_id (each once), origin (see ORIGINS), executed,
    timed_out, exit_code; nodes: node_id of the graph; before: node_id hit by earlier traces;
    target: the share of nodes that the plan wanted to hit.  Counts of executed runs by label
    and origin, of planned ones by origin (scheduled), of events by kind; failed runs are those
    that crashed or timed out without an event; warnings (an array of codes).
    """
    event = F.col("event")
    by = trace.groupBy("run_id").agg(F.count("*").alias("events"), *[F.count_if(event == e).alias(f"{e}s") for e in ("call", "import", "line")])
    ran = runs.where("executed").join(by, "run_id", "left").na.fill(0, ["events", "calls", "imports", "lines"])
    labelled = ran.withColumn("label", run_label(F.col("timed_out"), F.col("exit_code"), F.col("calls"), F.col("imports"), F.col("events")))
    of = lambda name: F.count_if(F.col("label") == name)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = labelled.agg(
        F.count("*").alias("runs"), total("calls").alias("call_events"), total("imports").alias("import_events"), total("lines").alias("line_events"), F.count_if("timed_out").alias("timeouts"),
        of("CALL_ACTIVITY").alias("call_activity_runs"), of("IMPORT_ONLY").alias("import_only_runs"), F.count_if((F.col("calls") == 0) & (F.col("imports") > 0)).alias("import_heavy_runs"),
        of("NO_OP").alias("no_op_runs"), of("NO_CALL_ACTIVITY").alias("no_call_activity_runs"), of("CRASHED").alias("crashed_runs"), of("PARTIAL_SUCCESS").alias("partial_success_runs"),
        (of("CRASHED") + of("TIMEOUT")).alias("failed_runs"), *[F.count_if(F.col("origin") == o).alias(f"{o}_runs") for o in ORIGINS],
    )
    planned = runs.agg(*[F.count_if(F.col("origin") == o).alias(f"{o}_scheduled") for o in ORIGINS[1:]])
    hit = trace.where((event == "call") & (F.col("node_id") != "")).select("node_id").distinct()
    old = before.select("node_id").distinct().withColumn("old", F.lit(True))
    covered = hit.join(old, "node_id", "left").agg(F.count("*").alias("hit_nodes"), F.count_if(F.col("old").isNull()).alias("new_nodes"))
    sizes = nodes.agg(F.countDistinct("node_id").alias("nodes")).crossJoin(F.broadcast(old.agg(F.count("*").alias("hit_before"))))
    for part in (planned, covered, sizes):
        one = one.crossJoin(F.broadcast(part))
    share, earlier = ratio(F.col("hit_nodes"), F.col("nodes")), ratio(F.col("hit_before"), F.col("nodes"))
    some = F.col("runs") > 0
    warnings = F.array_compact(
        F.array(
            F.when(~some, "no_runs"), F.when(some & (share <= earlier), "coverage_not_above_baseline"), F.when(some & (F.col("failed_runs") > 0), "failed_runs"), F.when(some & (F.col("call_activity_runs") == 0), "no_call_activity"),
            F.when(F.col("import_heavy_runs") > F.col("call_activity_runs"), "imports_dominate"), F.when(F.col("partial_success_runs") > 0, "partial_traces_kept"), F.when(some & F.lit(0 < target) & (share < target), "coverage_target_missed"),
        )
    )
    return one.select("*", (F.col("runs") - F.col("failed_runs")).alias("successful_runs"), F.round(share, 6).alias("coverage"), F.round(earlier, 6).alias("baseline_coverage"), F.round(share - earlier, 6).alias("coverage_delta"), warnings.alias("warnings"))


def runtime_facts(trace: DataFrame, nodes: DataFrame) -> DataFrame:
    """trace (event, node_id, file, depth), nodes (node_id) -> one row: calls, imports, unique
    (different called nodes of the graph), unmatched (calls of no node), local (calls in a
    file), max_depth, hit_nodes."""
    known = nodes.select(F.col("node_id").alias("known")).distinct()
    calls = trace.where("event = 'call'").join(known, F.col("node_id") == F.col("known"), "left")
    text = F.trim(F.coalesce("file", F.lit("")))
    local = (text != "") & ~text.startswith("<")
    one = calls.agg(
        F.count("*").alias("calls"), F.countDistinct("known").alias("unique"), F.count_if(F.col("known").isNull()).alias("unmatched"),
        F.count_if(local).alias("local"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth"), F.countDistinct("known").alias("hit_nodes"),
    )
    return one.crossJoin(F.broadcast(trace.agg(F.count_if(F.col("event") == "import").alias("imports"))))


def runtime_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Runtime nodes that are reached over runtime edges (source, target) from those without an
    incoming one, or from all of them if every one has some.  nodes: node_id, besides the
    edges' ends.  node_id, depth."""
    from . import graph

    links = edges.select("source", "target").where("source is not null and target is not null").distinct()
    every = nodes.select("node_id").union(links.select("source")).union(links.select("target")).where("node_id is not null").distinct()
    roots = every.join(links.select(F.col("target").alias("node_id")).distinct(), "node_id", "left_anti")
    return graph.reach(links, every if roots.isEmpty() else roots, every)


def entrypoint_evidence(entrypoints: DataFrame, seen: DataFrame) -> DataFrame:
    """entrypoints (path), seen (node_id: canonical ids with hits or reached at runtime) ->
    path, executed.  The path is read from the id, so this is an equi-join."""
    paths = seen.select(node_path(F.col("node_id")).alias("path")).where("path is not null").distinct().withColumn("executed", F.lit(True))
    asked = entrypoints.select(normalize_path(F.col("path")).alias("path")).where("path <> ''").distinct()
    return asked.join(paths, "path", "left").select("path", F.coalesce("executed", F.lit(False)).alias("executed"))


def runtime_gate(one: DataFrame) -> DataFrame:
    """Adds issues (an ordered array of codes) to a row of synthetic, calls, imports, unique,
    unmatched, depth, local, nodes, hit_nodes, reached, static_edges, runtime_edges,
    shared_edges, entrypoints, executed.

    Minima adapt to the graph: few nodes ask for few callees.
    """
    m, c = P.RUNTIME_MINIMA, F.col
    total = F.greatest(F.lit(1), c("nodes"))
    min_unique = F.least(F.lit(m["unique_callees"]), F.greatest(F.lit(3), F.ceil(0.03 * total)))
    min_calls = F.least(F.lit(m["call_events"]), F.greatest(F.lit(10), c("unique")))
    holds = (
        c("synthetic"),
        (c("calls") <= 0) & (c("imports") > 0),
        c("calls") < min_calls,
        c("unique") < min_unique,
        c("depth") < m["call_depth"],
        c("local") < m["local_calls"],
        (c("calls") > 0) & (c("hit_nodes") == 0),
        ratio(c("hit_nodes"), total) < m["coverage"],
        ratio(c("reached"), total) < m["reachable"],
        (c("static_edges") > 0) & (c("runtime_edges") > 0) & (c("shared_edges") == 0),
        (c("entrypoints") > 0) & (c("executed") == 0),
        (c("unmatched") > 0) & (c("unique") == 0),
    )
    return one.withColumn("issues", F.array_compact(F.array(*[F.when(h, code) for code, h in zip(P.RUNTIME_ISSUES, holds)])))


def entrypoint_domain(path: Column) -> Column:
    """api, cli or background by the words of a path, else other."""
    words = F.split(F.regexp_replace(F.lower(path), r"[_\-.\\]", "/"), "[/:]")
    # Words that name an entrypoint's domain.
    lists = {"api": ("api", "rest", "http", "web"), "cli": ("cli", "command", "commands", "cmd"), "background": ("job", "jobs", "worker", "workers", "scheduler", "cron", "background", "queue", "queues", "task", "tasks")}
    out = None
    for name, values in lists.items():
        hit = F.arrays_overlap(words, any_of(values))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def neighbours(edges: DataFrame, k: int = 8) -> DataFrame:
    """source, target, rank: each node's call targets of most outgoing calls (a top-k).

    Equal calls have one rank, so every task cuts its rows to k ranks a source before any is
    dealt out; only the calls of a source with very many are first made distinct.  Outgoing
    calls count for targets that call something themselves; where none does, there is no join.
    """
    calls = edges.where("type = 'CALL'").select("source", "target")
    made, seen = counted(calls.groupBy("source").agg(F.count("*").alias("n")), "callers", large=F.count_if(F.col("n") > MANY_CALLS))
    if seen["large"]:
        large = F.broadcast(made.where(F.col("n") > MANY_CALLS).select("source"))
        calls = calls.join(large, "source", "left_anti").unionByName(calls.join(large, "source", "left_semi").distinct())
    order = [F.col("target")]
    called = calls.select(F.col("target").alias("source")).distinct()
    busy, seen = counted(called.join(made, "source", "left_semi"), "callers", n=F.count(F.lit(1)))
    if seen["n"]:
        few = F.broadcast if seen["n"] <= FEW else lambda df: df
        out = calls.join(few(busy), "source", "left_semi").distinct().groupBy("source").agg(F.count("*").alias("out")).withColumnRenamed("source", "target")
        calls = calls.join(few(out), "target", "left").withColumn("out", F.coalesce("out", F.lit(0)))
        order = [F.desc("out"), *order]
    rank = F.dense_rank().over(Window.partitionBy("source").orderBy(*order))
    return calls.withColumn("rank", rank).where(F.col("rank") <= k).select("source", "target", "rank").distinct()


def identity_collisions(nodes: DataFrame) -> DataFrame:
    """nodes (node_id, path) -> path, ids: paths that several ids claim."""
    return nodes.groupBy("path").agg(F.countDistinct("node_id").alias("ids")).where("ids > 1")


def pairwise_f1(labels: DataFrame) -> DataFrame:
    """labels (id, found, truth) -> one row: precision, recall, f1 over pairs of ids that
    share a cluster, from group sizes alone (no pairs are made)."""
    pairs_of = lambda n: n * (n - 1) / 2
    size = lambda *c: labels.groupBy(*c).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(pairs_of(F.col("n"))), F.lit(0.0)).alias("p"))
    both, found, truth = size("found", "truth"), size("found").withColumnRenamed("p", "f"), size("truth").withColumnRenamed("p", "t")
    one = both.crossJoin(F.broadcast(found)).crossJoin(F.broadcast(truth))
    p, r = ratio(F.col("p"), F.col("f")), ratio(F.col("p"), F.col("t"))
    return one.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def directory_coverage(files: DataFrame, k: int = 20) -> DataFrame:
    """files (path) -> folder, files, sample: the first k names of each top folder."""
    from .ranking import top_per_group

    rows = files.select(F.substring_index("path", "/", 1).alias("folder"), "path")
    counts = rows.groupBy("folder").agg(F.count("*").alias("files"))
    few = top_per_group(rows, ["folder"], [F.col("path")], k).groupBy("folder").agg(F.array_sort(F.collect_list("path")).alias("sample"))
    return counts.join(few, "folder")


def shared_basenames(files: DataFrame, left_out: tuple[str, ...] = ("__init__", "__main__")) -> DataFrame:
    """files (path) -> stem, path, files: Python files whose name without folder and suffix
    others have too, and how many have it."""
    stem = F.regexp_replace(F.substring_index(normalize_path(F.col("path")), "/", -1), r"(.)\.[^.]*$", "$1")
    rows = files.select(stem.alias("stem"), "path").where(~F.col("stem").isin(*left_out)).distinct()
    return rows.join(rows.groupBy("stem").agg(F.count("*").alias("files")).where("files > 1"), "stem").select("stem", "path", "files")


def graph_sanity(nodes: DataFrame, edges: DataFrame, entrypoints: DataFrame, limits: dict | None = None) -> DataFrame:
    """One row: nodes, edges between them, entrypoints among them, reachable and isolated nodes
    with their shares, and reasons (an array) against limits (reachable_nodes, isolated_nodes)."""
    from . import graph

    t = P.MEANINGFUL | (limits or {})
    known = stored(nodes.select("node_id").where("node_id <> ''").distinct(), "known")
    ends = lambda rows: rows.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    raw = edges.select("source", "target").where("source is not null and target is not null")
    # Links to elsewhere are looked for by the few ends, and joined away only if there are some.
    strange, seen = counted(ends(raw).join(known, "node_id", "left_anti"), "strange", n=F.count(F.lit(1)))
    if seen["n"]:
        for c in ("source", "target"):
            raw = raw.join(strange.withColumnRenamed("node_id", c), c, "left_anti")
    links = raw.distinct()
    starts = entrypoints.select("node_id").distinct().join(known, "node_id", "left_semi")
    linked = ends(raw)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = count(known, "nodes")
    for rows, name in ((links, "edges"), (starts, "entrypoints"), (graph.reach(raw, starts, known), "reachable"), (known.join(linked, "node_id", "left_anti"), "isolated")):
        one = one.crossJoin(F.broadcast(count(rows, name)))
    reachable, isolated = ratio(F.col("reachable"), F.col("nodes")), ratio(F.col("isolated"), F.col("nodes"))
    reasons = F.array_compact(F.array(F.when(F.col("entrypoints") == 0, "no_entrypoint"), F.when(reachable < t["reachable_nodes"], "reachable_nodes_below_minimum"), F.when(isolated > t["isolated_nodes"], "isolated_nodes_above_maximum")))
    return one.select("*", F.round(reachable, 6).alias("reachable_ratio"), F.round(isolated, 6).alias("isolated_ratio"), reasons.alias("reasons"))


def _public_names(symbols: DataFrame) -> DataFrame:
    return symbols.where(~F.col("name").startswith("_")).groupBy(F.col("file").alias("id")).agg(F.collect_set("name").alias("tokens"))


def shared_names(symbols: DataFrame, min_shared: int = 5, min_jaccard: float = 0.6) -> DataFrame:
    """symbols (file, name) -> a, b, shared, jaccard: files whose public function names overlap.
    Files with the same names stand as their least one; shared_name_members tells which."""
    from .similarity import similar_pairs

    return similar_pairs(_public_names(symbols), min_jaccard, min_shared)


def shared_name_members(symbols: DataFrame, min_shared: int = 5, min_jaccard: float = 0.6) -> DataFrame:
    """symbols (file, name) -> id, rep, same, links: every file, those with the same public
    names, and how many pairs of shared_names it is in."""
    from .similarity import linked_members

    return linked_members(_public_names(symbols), min_jaccard, min_shared)
