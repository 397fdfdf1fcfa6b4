"""Degrees, references, runtime hits; heat classes and dead-code candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import profiles as P
from ..functions.columns import clamp, log_share
from .tables import stored


def reference_counts(edges: DataFrame) -> DataFrame:
    """edges (source, target, type) -> node_id, inbound, outbound, executable, non_executable.

    Repeated edges count each time.  One aggregation over both ends of every edge.
    """
    call = F.col("type") == "CALL"
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("target").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o"), call.cast("int").alias("x")),
                F.struct(F.col("source").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0).alias("x")),
            )
        ).alias("e")
    ).select("e.*")
    return ends.groupBy("node_id").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"), F.sum("x").alias("executable"), F.sum(F.col("i") - F.col("x")).alias("non_executable"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """node_id, degree, centrality (degree / greatest degree, 6 places)."""
    d = edges.select(F.explode(F.array("source", "target")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    top = d.agg(F.max("degree").alias("top"))
    return d.crossJoin(F.broadcast(top)).select("node_id", "degree", F.round(F.col("degree") / F.col("top"), 6).alias("centrality"))


def runtime_hits(trace: DataFrame) -> DataFrame:
    """trace (node_id, event) -> node_id, hits: call events a node."""
    return trace.where("event = 'call'").groupBy("node_id").agg(F.count("*").alias("hits"))


def heat(nodes: DataFrame, edges: DataFrame, trace: DataFrame, reachable: DataFrame | None = None) -> DataFrame:
    """Heat class of every node: score from runtime, reachability and references, then the guards.

    reachable: node_id reached at runtime; default: the nodes with hits.  The two maxima are
    one-row aggregates, so their broadcast never grows.
    """
    hits = runtime_hits(trace)
    refs = reference_counts(edges)
    reach = (reachable if reachable is not None else hits).select("node_id").distinct().withColumn("reached", F.lit(True))
    base = nodes.select("node_id").distinct().join(hits, "node_id", "left").join(refs, "node_id", "left").join(reach, "node_id", "left")
    base = base.na.fill(0, ["hits", "inbound", "outbound", "executable", "non_executable"]).na.fill(False, ["reached"])
    total = F.col("executable") + F.col("non_executable") + F.col("inbound")
    # The table is used twice, for its maxima and for its rows, so it is written once.
    base = stored(base, "heat")
    most = base.agg(F.max("hits").alias("most_hits"), F.max(total).alias("most_refs"))
    rows = base.crossJoin(F.broadcast(most))
    runtime, w = log_share(F.col("hits"), F.col("most_hits")), P.HEAT_WEIGHTS
    score = F.round(clamp(w["runtime"] * runtime + w["reachability"] * F.col("reached").cast("double") + w["reference"] * log_share(total, F.col("most_refs"))), 3)
    rows = rows.withColumn("score", score)
    t = P.HEAT_THRESHOLDS
    by_score = F.when(F.col("score") >= t["HOT"], "HOT").when(F.col("score") >= t["WARM"], "WARM").when(F.col("score") >= t["COLD"], "COLD").otherwise("DEAD")
    unused = (F.col("hits") == 0) & (F.col("executable") == 0) & (F.col("inbound") == 0)
    used = (F.col("hits") > 0) | (F.col("executable") > 0) | F.col("reached") | (F.col("inbound") > 0)
    first = F.when(unused, "DEAD").otherwise(by_score)
    second = F.when((first == "HOT") & (F.col("hits") <= 0), "WARM").otherwise(first)
    final = F.when((second == "DEAD") & used, "COLD").otherwise(second)
    graph = 0.7 * F.col("reached").cast("double") + F.when(F.col("inbound") > 0, 0.3).otherwise(0.0)
    static = F.when(F.col("executable") > 0, 0.7).otherwise(0.0) + F.when(F.col("non_executable") > 0, 0.3).otherwise(0.0)
    rows = rows.withColumn("classification", final).withColumn("confidence", F.round(clamp(0.5 * runtime + 0.25 * graph + 0.25 * static), 3))
    return rows.select("node_id", "classification", "score", "confidence", "hits", "inbound", "outbound", "executable", "non_executable")


def cap_confidence(heat_rows: DataFrame) -> DataFrame:
    """Without any HOT or WARM node no confidence exceeds the cap."""
    warm = heat_rows.agg(F.count_if(F.col("classification").isin("HOT", "WARM")).alias("warm"))
    capped = F.when(F.col("warm") == 0, F.least("confidence", F.lit(P.MAX_CONFIDENCE_WITHOUT_HEAT))).otherwise(F.col("confidence"))
    return heat_rows.crossJoin(F.broadcast(warm)).withColumn("confidence", capped).drop("warm")


def heat_distribution(heat_rows: DataFrame) -> DataFrame:
    """One row: nodes a class and the dead ratio."""
    c = F.col("classification")
    counts = heat_rows.agg(*[F.count_if(c == k).alias(k.lower()) for k in ("HOT", "WARM", "COLD", "DEAD")], F.count("*").alias("n"))
    return counts.select("hot", "warm", "cold", "dead", F.when(F.col("n") == 0, 0.0).otherwise(F.round(F.col("dead") / F.col("n"), 6)).alias("dead_ratio"))


def dead_ratio_gate(distribution: DataFrame, passed: bool) -> DataFrame:
    """heat_distribution's row with sane: false if the runtime signal has passed its gate and
    yet more nodes are DEAD than MAX_DEAD_RATIO allows."""
    return distribution.withColumn("sane", ~(F.lit(passed) & (F.col("dead_ratio") > P.MAX_DEAD_RATIO)))


def warm_near_hot(heat_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: WARM nodes, those that HOT nodes reach over the edges, their share, and DEAD
    nodes that nevertheless have hits or incoming edges (conflicts)."""
    from . import graph

    c = F.col("classification")
    seen = graph.reach(edges, heat_rows.where(c == "HOT").select("node_id"), heat_rows).select("node_id")
    near = heat_rows.where(c == "WARM").join(seen, "node_id", "left_semi").agg(F.count("*").alias("near"))
    counts = heat_rows.agg(F.count_if(c == "WARM").alias("warm"), F.count_if((c == "DEAD") & ((F.col("hits") > 0) | (F.col("inbound") > 0))).alias("conflicts"))
    share = F.when(F.col("warm") == 0, 1.0).otherwise(F.round(F.col("near") / F.col("warm"), 6))
    return counts.crossJoin(F.broadcast(near)).select("warm", "near", share.alias("share"), "conflicts")


def dead_candidates(heat_rows: DataFrame, coverage: float) -> DataFrame:
    """DEAD nodes without inbound edges: probability by rule weights, confidence by coverage."""
    w = P.DEAD_WEIGHTS
    p = (
        F.when(F.col("hits") == 0, w["hits"]).otherwise(0.0)
        + F.when(F.col("executable") == 0, w["executable"]).otherwise(0.0)
        + F.when(F.col("non_executable") == 0, w["non_executable"]).otherwise(0.0)
    )
    rows = heat_rows.where("classification = 'DEAD' and inbound = 0")
    return rows.select("node_id", F.round(p, 3).alias("probability"), F.round(p * coverage, 3).alias("confidence"))


def overcoupled(edges: DataFrame) -> DataFrame:
    """Nodes of a degree over max(8, twice the upper median degree): node_id, degree, threshold.

    The upper median comes from the counts by degree (as many rows as there are different
    degrees), not from a sort of all nodes.
    """
    from pyspark.sql.window import Window

    d = edges.select(F.explode(F.array("source", "target")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    by_degree = d.groupBy("degree").agg(F.count("*").alias("n"))
    run = Window.orderBy("degree")
    placed = by_degree.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    median = placed.where(F.col("upto") >= F.floor(F.col("all") / 2) + 1).agg(F.min("degree").alias("median"))
    limit = median.select(F.greatest(F.lit(8), 2 * F.col("median")).alias("threshold"))
    return d.crossJoin(F.broadcast(limit)).where("degree > threshold").select("node_id", "degree", "threshold")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return nodes.select("node_id").join(ends, "node_id", "left_anti")
