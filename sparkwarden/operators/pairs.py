"""Set operations over edge pairs: differences, overlap, divergence, edge validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import profiles as P
from ..functions.columns import clamp, namespace, ratio
from .tables import counted

#: Ids that are sent to every task instead of dealing out what they are joined to.
FEW = 100_000


def pair_counts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n_a, n_b, n_both, n_either over distinct keys.

    Union and one aggregation by key, then one of its result: no join.
    """
    tagged = a.select(*keys, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).union(b.select(*keys, F.lit(0), F.lit(1)))
    flags = tagged.groupBy(*keys).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return flags.agg(
        F.coalesce(F.sum("in_a"), F.lit(0)).alias("n_a"),
        F.coalesce(F.sum("in_b"), F.lit(0)).alias("n_b"),
        F.coalesce(F.sum(F.col("in_a") * F.col("in_b")), F.lit(0)).alias("n_both"),
        F.count("*").alias("n_either"),
    )


def divergence(profile: str = "v2") -> Column:
    """Over the columns of pair_counts; 0 if both are empty."""
    apart = ratio(F.col("n_either") - F.col("n_both"), F.col("n_either"))
    if profile == "v2":
        weight = 0.70 + 0.30 * ratio(F.least("n_a", "n_b"), F.col("n_either"))
    else:
        weight = clamp(F.col("n_a") / F.greatest(F.lit(1), F.col("n_b")))
    return F.round(apart * weight, 3)


def overlap() -> Column:
    """Shared share of the smaller set; both empty: 1, one empty: 0."""
    return F.when((F.col("n_a") == 0) & (F.col("n_b") == 0), 1.0).otherwise(F.round(ratio(F.col("n_both"), F.least("n_a", "n_b")), 3))


def reconcile(static: DataFrame, runtime: DataFrame) -> DataFrame:
    """One row: static, runtime and shared call edges and their overlap (of the static ones)."""
    c = pair_counts(static, runtime, ["source", "target"])
    return c.select(
        F.col("n_a").alias("static_edges"), F.col("n_b").alias("runtime_edges"), F.col("n_both").alias("shared_edges"),
        (F.col("n_a") - F.col("n_both")).alias("static_only"), (F.col("n_b") - F.col("n_both")).alias("runtime_only"),
        F.round(ratio(F.col("n_both"), F.col("n_a")), 6).alias("overlap_ratio"),
    )


def with_unknown_ends(known: DataFrame, ends: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with unknown: whether an end is none of known (node_id).  ends (source, target): rows
    with all the ends of edges that this matters for.

    The different ends without a node are found first and are few as a rule: then no join deals
    out the edges.
    """
    ids = ends.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    strange, seen = counted(ids.join(known.select("node_id").distinct(), "node_id", "left_anti"), "unknown-ends", n=F.count(F.lit(1)))
    if not seen["n"]:
        return edges.withColumn("unknown", F.lit(False))
    few = F.broadcast if seen["n"] <= FEW else lambda df: df
    for c in ("source", "target"):
        edges = edges.join(few(strange.select(F.col("node_id").alias(c), F.lit(True).alias(f"unknown_{c}"))), c, "left")
    unknown = F.col("unknown_source").isNotNull() | F.col("unknown_target").isNotNull()
    return edges.withColumn("unknown", unknown).drop("unknown_source", "unknown_target")


def edge_status(nodes: DataFrame, edges: DataFrame, allowed: tuple[str, ...] = P.ALLOWED_EDGE_TYPES["v2"]) -> DataFrame:
    """Distinct edges (source, target, type, confidence) with the first fault that holds:
    malformed, invalid_type, unresolved or valid; cross_namespace for valid ones."""
    e = edges.select(F.trim(F.coalesce("source", F.lit(""))).alias("source"), F.trim(F.coalesce("target", F.lit(""))).alias("target"), F.upper(F.trim(F.coalesce("type", F.lit("")))).alias("type"), "confidence")
    fault = (
        F.when((F.col("source") == "") | (F.col("target") == "") | (F.col("type") == ""), "malformed")
        .when(~F.col("type").isin(*allowed), "invalid_type")
        .when(F.col("confidence").isNull(), "malformed")
    )
    # The ends of edges with another fault are never looked up.
    e = with_unknown_ends(nodes.select(F.trim("node_id").alias("node_id")), e.where(fault.isNull()), e.distinct())
    status = fault.when(F.col("unknown"), "unresolved").otherwise("valid")
    crosses = (status == "valid") & (namespace(F.col("source")) != namespace(F.col("target")))
    return e.select("source", "target", "type", status.alias("status"), crosses.alias("cross_namespace"))


def resolver_edges(*frames: DataFrame, profile: str = "v2") -> DataFrame:
    """Distinct resolver edges; an unknown source becomes UNKNOWN (v2) or goes (v1)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    source = F.upper(F.trim(F.coalesce("origin", F.lit(""))))
    rows = out.select(F.trim("source").alias("source"), F.trim("target").alias("target"), F.when(source.isin(*P.RESOLVER_SOURCES), source).otherwise("UNKNOWN").alias("origin"))
    rows = rows.where("source <> '' and target <> ''").distinct()
    return rows if profile == "v2" else rows.where("origin <> 'UNKNOWN'")


def node_universe(*frames: DataFrame) -> DataFrame:
    """Distinct node_id over all frames."""
    out = frames[0].select("node_id")
    for f in frames[1:]:
        out = out.union(f.select("node_id"))
    return out.where("node_id is not null and node_id <> ''").distinct()
