"""Integrity of a canonical graph: the gate on its edges, its components, the authority.

Everything is a count or a component table in Spark; what reaches the driver is one row of
counts and a bounded sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import profiles as P
from ..functions.columns import layer, normalize_path
from ..operators import graph, traces
from ..operators.tables import stored
from .verdict import issue, sample


def _text(column: str, otherwise: str = "") -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(F.col(column).cast("string"))), F.lit("")), F.lit(otherwise))


def gated_edges(edges: DataFrame) -> DataFrame:
    """edges (source, target, type, confidence, origin) in their canonical form: trimmed ends,
    type IMPORT, origin AST and confidence 1 where there is none (or a confidence of zero)."""
    trimmed = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    confidence = F.coalesce(F.nullif(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(1.0))
    return edges.select(trimmed("source").alias("source"), trimmed("target").alias("target"), _text("type", "IMPORT").alias("type"), confidence.alias("confidence"), _text("origin", "AST").alias("origin"))


def edge_gate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: unresolved (edges of which an end is no node), underived (injected pairs that
    were not parsed), and code: the reason to reject the edges, empty without one."""
    known = nodes.select(F.trim("node_id").alias("k")).where("k <> ''").distinct()
    e = stored(gated_edges(edges), "gated")
    s, t = known.select(F.col("k").alias("source"), F.lit(True).alias("s")), known.select(F.col("k").alias("target"), F.lit(True).alias("t"))
    unresolved = e.join(s, "source", "left").join(t, "target", "left").agg(F.count_if(F.col("s").isNull() | F.col("t").isNull()).alias("unresolved"))
    # Origins are read as they stand: an edge without one is no parsed edge here.
    raw = edges.select(F.trim("source").alias("source"), F.trim("target").alias("target"), _text("origin").alias("origin"), _text("type").alias("type"))
    pair = raw.groupBy("source", "target").agg(F.bool_or(F.col("origin") == "AST").alias("parsed"), F.bool_or((F.col("origin") == "DI") | (F.col("type") == "DI")).alias("injected"))
    underived = pair.agg(F.count_if(F.col("injected") & ~F.col("parsed")).alias("underived"))
    code = F.when(F.col("unresolved") > 0, "UNRESOLVED_EDGE_REFERENCE").when(F.col("underived") > 0, "DI_NOT_DERIVED_FROM_AST").otherwise("")
    return unresolved.crossJoin(F.broadcast(underived)).withColumn("code", code)


def components_of(nodes: DataFrame, edges: DataFrame, entrypoints: DataFrame | None = None) -> DataFrame:
    """component, size, entered (whether an entrypoint is a member), primary (the component that
    the least node is in)."""
    groups = stored(graph.weak_components(nodes, edges), "components")
    starts = (entrypoints if entrypoints is not None else groups.limit(0)).select("node_id").distinct().withColumn("start", F.lit(True))
    sizes = groups.join(starts, "node_id", "left").groupBy("component").agg(F.count("*").alias("size"), F.coalesce(F.bool_or("start"), F.lit(False)).alias("entered"))
    first = sizes.agg(F.min("component").alias("first"))  # one row
    return sizes.crossJoin(F.broadcast(first)).select("component", "size", "entered", (F.col("component") == F.col("first")).alias("primary"))


def graph_integrity(nodes: DataFrame, edges: DataFrame) -> dict:
    """nodes (node_id, path), edges (source, target, ...): issues, metrics, and a trust of one
    or zero.  Clusters besides the one of the least node are disconnected."""
    ids = stored(nodes.select("node_id", normalize_path(F.col("path")).alias("path")).where("trim(node_id) <> ''").distinct(), "ids")
    gate = edge_gate(ids, edges).first()
    parts = stored(components_of(ids, edges), "parts")
    apart = parts.where("not primary").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("members")).first()
    claimed = stored(traces.identity_collisions(ids.where("path <> ''")), "claimed")
    n_claimed = claimed.count()
    found = []
    if gate["unresolved"]:
        found.append(issue("graph_integrity", "UNRESOLVED_EDGE_REFERENCE", "HIGH", "edges end at nodes that are not in the graph", gate["unresolved"]))
    if apart["n"]:
        found.append(issue("graph_integrity", "DISCONNECTED_SUBGRAPHS", "HIGH", "components beside the primary one", apart["n"], sample(parts.where("not primary"), "component")))
    if n_claimed:
        found.append(issue("graph_integrity", "IDENTITY_COLLISION_NAMESPACE_FILEPATH", "HIGH", "paths that several ids claim", n_claimed, sample(claimed, "path")))
    valid = not found
    metrics = {"orphan_nodes": apart["members"], "disconnected_clusters": apart["n"], "di_nodes_missing_edges": gate["unresolved"]}
    return {"status": "VALID" if valid else "INVALID", "critical_failure": not valid, "system_valid": valid, "trust_score": 1.0 if valid else 0.0, "issues": found, "metrics": metrics}


def island_anomalies(nodes: DataFrame, edges: DataFrame, entrypoints: DataFrame) -> dict:
    """Components without an entrypoint, which can look healthy though nothing enters them."""
    parts = stored(components_of(nodes, edges, entrypoints), "parts")
    lost = parts.where("not entered")
    n = lost.count()
    kinds = (("DISCONNECTED_ISLANDS", "components that no entrypoint is in"), ("FALSE_HEALTHY_SUBGRAPHS", "components whose health says nothing, as nothing enters them"))
    return {"status": "FAIL" if n else "PASS", "anomalies": [issue("graph_integrity", k, "HIGH", m, n, sample(lost, "component")) for k, m in kinds] if n else []}


def authority(result: dict, min_trust: float = P.MIN_AUTHORITY_TRUST, entrypoints: tuple[str, ...] = ()) -> dict:
    """The decision over run_verification's result: valid without a critical failure and with
    the least trust.  At least one entrypoint must have been named."""
    starts = sorted({e.strip() for e in entrypoints if e.strip()})
    if not starts:
        raise ValueError("the authority gate needs entrypoints")
    least = max(0.0, min(1.0, float(min_trust)))
    critical = bool(result["policy"]["hard"])
    trust = float(result.get("trust_score") or 0.0)
    return {"authority_valid": not critical and trust >= least, "critical_failure": critical, "trust_score": trust, "min_trust": least, "entrypoints_used": starts, "issues": result["issues"], "failures": result["failures"]}


def layer_counts(paths: DataFrame) -> DataFrame:
    """paths (path) -> layer, n."""
    return paths.groupBy(layer(F.col("path")).alias("layer")).agg(F.count("*").alias("n"))


def inventory_gaps(graph_paths: DataFrame, inventory: DataFrame) -> DataFrame:
    """path, side: files of the graph that the inventory lacks (graph) and the other way round
    (inventory)."""
    clean = lambda rows: rows.select(normalize_path(F.col("path")).alias("path")).where("path <> ''").distinct()
    a, b = clean(graph_paths), clean(inventory)
    side = a.withColumn("g", F.lit(1)).unionByName(b.withColumn("i", F.lit(1)), allowMissingColumns=True).groupBy("path").agg(F.max("g").alias("g"), F.max("i").alias("i"))
    return side.where("g is null or i is null").select("path", F.when(F.col("g") == 1, "graph").otherwise("inventory").alias("side"))
