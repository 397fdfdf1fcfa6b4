"""The older (v1) profile of the verdict: its evaluators, issues, trust and policy.

Each evaluator is one row of counts over the tables; the verdict is made of those rows and a
bounded sample of node ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import profiles as P
from ..functions import scores as S
from ..functions.columns import valid_namespace
from ..operators import graph, pairs
from ..operators.tables import stored
from .verdict import issue

#: Caps of the penalties, in the order of the formula.
CAPS = {
    "invalid_edges": 0.25, "malformed_nodes": 0.10, "unreachable": 0.30, "di_unreachable": 0.20, "missing_di": 0.25, "divergence": 0.25, "islands": 0.10, "cycles": 0.10,
}
GROUPS = {"structural": ("invalid_edges", "malformed_nodes"), "reachability": ("unreachable", "di_unreachable"), "resolver": ("missing_di", "divergence"), "semantic": ("islands", "cycles")}
#: Policy thresholds and the coverage under which a warning is given.
MIN_TRUST, MAX_MISSING_DI, MAX_ISLANDS, MIN_COVERAGE = 0.40, 0.10, 0.85, 0.7
SOURCES = ("AST", "DI", "CONFIG", "HEURISTIC")


def _trimmed(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit("")))


def known_ids(nodes: DataFrame) -> DataFrame:
    return nodes.select(_trimmed("node_id").alias("node_id")).where("node_id <> ''").distinct()


def node_figures(nodes: DataFrame) -> DataFrame:
    """One row: nodes, valid_nodes (different ids), malformed, duplicates, bad_namespace."""
    by = nodes.groupBy(_trimmed("node_id").alias("node_id")).agg(F.count("*").alias("k"))
    some = F.col("node_id") != ""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    return by.agg(
        total(F.col("k"))("nodes"), F.count_if(some).alias("valid_nodes"), total(F.when(~some, F.col("k")))("malformed"), total(F.when(some, F.col("k") - 1))("duplicates"),
        F.count_if(some & ~valid_namespace(F.col("node_id"))).alias("bad_namespace"),
    )


def judged_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges (source, target, type, origin) -> the same, in canonical writing, with status:
    malformed, invalid_type, unresolved or valid.  Repeated rows stay."""
    e = edges.select(_trimmed("source").alias("source"), _trimmed("target").alias("target"), F.upper(_trimmed("type")).alias("type"), F.upper(_trimmed("origin")).alias("origin"))
    fault = F.when((F.col("source") == "") | (F.col("target") == "") | (F.col("type") == ""), "malformed").when(~F.col("type").isin(*P.ALLOWED_EDGE_TYPES["v1"]), "invalid_type")
    e = pairs.with_unknown_ends(known_ids(nodes), e.where(fault.isNull()), e)
    return e.select("source", "target", "type", "origin", fault.when(F.col("unknown"), "unresolved").otherwise("valid").alias("status"))


def edge_figures(judged: DataFrame) -> DataFrame:
    """One row: edges, valid_edges, malformed_edges, unresolved_edges, invalid_type_edges."""
    of = lambda s: F.count_if(F.col("status") == s)
    return judged.agg(F.count("*").alias("edges"), of("valid").alias("valid_edges"), of("malformed").alias("malformed_edges"), of("unresolved").alias("unresolved_edges"), of("invalid_type").alias("invalid_type_edges"))


def standing(edges: DataFrame) -> DataFrame:
    """Those of edges (type, origin) that can stand for resolver edges: no other is counted there,
    so none has to be judged or dealt out for it."""
    return edges.where(F.upper(_trimmed("origin")).isin(*SOURCES) | F.upper(_trimmed("type")).isin(*SOURCES))


def dependency_figures(nodes: DataFrame, judged: DataFrame, resolver: DataFrame) -> DataFrame:
    """One row over resolver edges (source, target, origin) and judged edges: for each source,
    how many resolver edges it has and how many valid edges stand for them (by origin and by
    type); missing and referenced injected nodes, inferred pairs, divergence and alignment."""
    rows = stored(resolver.select(_trimmed("source").alias("source"), _trimmed("target").alias("target"), F.upper(_trimmed("origin")).alias("origin")).where(F.col("origin").isin(*SOURCES) & (F.col("source") != "") & (F.col("target") != "")), "resolver")
    name = str.lower
    totals = rows.agg(F.count("*").alias("resolver_edges"), *[F.count_if(F.col("origin") == s).alias(f"{name(s)}_edges") for s in SOURCES])
    valid = standing(judged.where("status = 'valid'")).select("source", "target", "type", "origin").distinct()
    stand = valid.agg(*[(F.count_if(F.col("origin") == s) + F.count_if(F.col("type") == s)).alias(f"{name(s)}_represented") for s in SOURCES])
    of = lambda s: rows.where(F.col("origin") == s).select("source", "target")
    keys = ["source", "target"]
    ast = pairs.pair_counts(of("AST"), of("DI"), keys).select(pairs.divergence("v1").alias("divergence"), (F.col("n_b") - F.col("n_both")).alias("inferred"), (F.col("n_either") - F.col("n_both")).alias("apart"))
    config = pairs.pair_counts(of("CONFIG"), of("HEURISTIC"), keys).select(pairs.overlap().alias("alignment"))
    ends = of("DI").select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    missing = ends.join(known_ids(nodes).withColumn("k", F.lit(True)), "node_id", "left").agg(F.count("*").alias("di_nodes"), F.count_if(F.col("k").isNull()).alias("missing_di"))
    one = totals
    for part in (stand, ast, config, missing):
        one = one.crossJoin(F.broadcast(part))
    return one


def topology_figures(nodes: DataFrame, judged: DataFrame, entrypoints: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """One row of counts, and the tables that samples come from (missing_entrypoints,
    unreachable, cycle_violations).  nodes: node_id and optionally isolated, cycle_allowed."""
    known = stored(known_ids(nodes), "nodes")
    valid = stored(judged.where("status = 'valid'").select("source", "target", "type"), "links")
    marked = lambda c: known.limit(0) if c not in nodes.columns else nodes.where(F.col(c)).select(_trimmed("node_id").alias("node_id")).distinct()
    asked = entrypoints.select(_trimmed("node_id").alias("node_id")).where("node_id <> ''")
    seen = stored(graph.reach(valid, asked.distinct(), known).select("node_id"), "reached")
    lost = stored(known.join(seen, "node_id", "left_anti"), "unreached")
    cyclic = stored(graph.peel(known, valid), "cyclic")
    violations = stored(cyclic.join(marked("cycle_allowed"), "node_id", "left_anti"), "cycle-violations")
    absent = stored(asked.distinct().join(known, "node_id", "left_anti"), "missing-entrypoints")
    # A component stands apart if no member is reached: reached nodes reach all of their valid
    # links' targets, but may be linked from unreached ones.
    parts = graph.weak_components(known, valid)
    parts = stored(parts.join(lost.withColumn("lost", F.lit(True)), "node_id", "left"), "parts")
    apart = parts.groupBy("component").agg(F.bool_and(F.coalesce("lost", F.lit(False))).alias("apart")).where("apart").select("component")
    kinds = stored(graph.islands(parts.join(apart, "component", "left_semi").select("node_id", "component"), marked("isolated"), cyclic), "islands")
    of = lambda k: kinds.agg(F.count_if(F.col("kind") == k), F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("size"))), F.lit(0))).first()
    islands = {k: of(k) for k in ("isolated_module", "orphan_subgraph", "cyclic_island")}
    di = valid.where("type = 'DI'")
    hidden = di.join(lost.select(F.col("node_id").alias("source"), F.lit(True).alias("s")).distinct(), "source", "left").join(lost.select(F.col("node_id").alias("target"), F.lit(True).alias("t")).distinct(), "target", "left").where("s or t")
    figures = {
        "entrypoints": asked.count(), "missing_entrypoints": absent.count(), "reachable": seen.count(), "unreachable": lost.count(), "di_edges": di.count(), "di_unreachable": hidden.count(),
        "cycle_nodes": cyclic.count(), "cycle_violations": violations.count(), **{k: v[0] for k, v in islands.items()}, **{f"{k}_nodes": v[1] for k, v in islands.items()},
    }
    row = nodes.sparkSession.createDataFrame([tuple(int(v) for v in figures.values())], ", ".join(f"{k} long" for k in figures))
    return row, {"missing_entrypoints": absent, "unreachable": lost, "cycle_violations": violations}


def _first(rows: DataFrame) -> list:
    return [r[0] for r in rows.orderBy("node_id").limit(P.SAMPLE_LIMIT["v1"]).collect()]


def trust(figures: dict) -> dict:
    """Trust of the four penalties (each group's parts stopped at their caps) and the scores."""
    ratio = lambda a, b: S.c01(S.div(a, max(1, b)))
    f = figures
    ratios = {
        "invalid_edges": ratio(f["malformed_edges"] + f["unresolved_edges"] + f["invalid_type_edges"], f["valid_edges"]), "malformed_nodes": ratio(f["malformed"] + f["duplicates"], f["valid_nodes"]),
        "unreachable": ratio(f["unreachable"], f["valid_nodes"]), "di_unreachable": ratio(f["di_unreachable"], f["di_edges"]), "missing_di": ratio(f["missing_di"], f["di_nodes"]), "divergence": S.c01(f["divergence"]),
        "islands": ratio(f["orphan_subgraph_nodes"], f["valid_nodes"]), "cycles": ratio(f["cycle_violations"], f["valid_nodes"]),
    }
    penalties = {g: S.r3(sum(min(CAPS[k], ratios[k] * CAPS[k]) for k in parts)) for g, parts in GROUPS.items()}
    most = {g: sum(CAPS[k] for k in parts) for g, parts in GROUPS.items()}
    score = lambda p, m: S.r3(S.c01(1 - S.div(p, m)))
    scores = {g: score(penalties[g], most[g]) for g in GROUPS}
    domains = {"structural_integrity": scores["structural"], "dependency_consistency": scores["resolver"], "topology_validation": score(penalties["reachability"] + penalties["semantic"], most["reachability"] + most["semantic"]), "semantic_observations": scores["semantic"]}
    return {"trust_score": S.r3(S.c01(1 - sum(penalties.values()))), "penalties": penalties | {"total": S.r3(sum(penalties.values()))}, "ratios": {k: S.r3(v) for k, v in ratios.items()}, "scores": domains}


def verify_v1(nodes: DataFrame, edges: DataFrame, resolver: DataFrame, entrypoints: DataFrame) -> dict:
    """The verdict of the older profile.

    nodes: node_id and optionally isolated, cycle_allowed; edges: source, target, type, origin;
    resolver: source, target, origin; entrypoints: node_id.
    """
    judged = stored(judged_edges(nodes, edges), "judged")
    row, tables = topology_figures(nodes, judged, entrypoints)
    one = node_figures(nodes)
    for part in (edge_figures(judged), dependency_figures(nodes, judged, resolver), row):
        one = one.crossJoin(F.broadcast(part))
    f = one.first().asDict()
    invalid = f["malformed_edges"] + f["unresolved_edges"] + f["invalid_type_edges"]
    counts = (
        ("structural_integrity", "MALFORMED_NODE_IDS", "HIGH", f["malformed"], "nodes without an id"),
        ("structural_integrity", "DUPLICATE_NODE_IDS", "HIGH", f["duplicates"], "node ids that occur again"),
        ("structural_integrity", "INVALID_NODE_NAMESPACE", "MEDIUM", f["bad_namespace"], "node ids without a namespace"),
        ("structural_integrity", "INVALID_EDGES", "HIGH", invalid, "edges that are malformed, of no allowed type, or end nowhere"),
        ("dependency_consistency", "MISSING_DI_NODES", "HIGH", f["missing_di"], "injected nodes are not in the graph"),
        ("dependency_consistency", "AST_DI_DIVERGENCE_TRACKED", "MEDIUM", f["apart"] if f["divergence"] > 0 else 0, "parsed and injected pairs differ"),
        ("dependency_consistency", "NON_AST_INFERRED_DI_EDGES", "LOW", f["inferred"], "injected pairs that were not parsed"),
        ("topology_validation", "MISSING_ENTRYPOINTS", "MEDIUM", f["missing_entrypoints"], "entrypoints that are no node"),
        ("topology_validation", "UNREACHABLE_NODES", "LOW", f["unreachable"], "nodes no entrypoint reaches"),
        ("topology_validation", "UNEXPECTED_ORPHAN_SUBGRAPH", "MEDIUM", f["orphan_subgraph"], "subgraphs without a reason to stand alone"),
        ("topology_validation", "CYCLE_POLICY_VIOLATION", "MEDIUM", f["cycle_violations"], "nodes on or behind a cycle that is not allowed"),
    )
    samples = {"MISSING_ENTRYPOINTS": "missing_entrypoints", "UNREACHABLE_NODES": "unreachable", "CYCLE_POLICY_VIOLATION": "cycle_violations"}
    issues = [issue(d, k, s, text, n) | {"sample": _first(tables[samples[k]]) if k in samples else []} for d, k, s, n, text in counts if n]
    covered = {s: S.div(f[f"{s}_represented"], max(1, f[f"{s}_edges"])) for s in ("ast", "di")}
    warnings = [f"{s}_coverage_below_{MIN_COVERAGE}" for s, c in covered.items() if f[f"{s}_edges"] > 0 and c < MIN_COVERAGE]
    warnings += [k for k, n in (("no_valid_nodes", f["valid_nodes"] == 0), ("cyclic_islands", f["cyclic_island"]), ("disconnected_islands", f["isolated_module"] + f["orphan_subgraph"] + f["cyclic_island"]), ("orphan_subgraphs", f["orphan_subgraph"])) if n]
    t = trust(f)
    hard = [k for k, bad in (("no_valid_nodes", f["valid_nodes"] == 0), ("missing_di_nodes", t["ratios"]["missing_di"] > MAX_MISSING_DI), ("unexpected_islands", S.div(f["orphan_subgraph_nodes"], max(1, f["valid_nodes"])) > MAX_ISLANDS)) if bad]
    soft = [k for k, bad in (("trust_below_minimum", t["trust_score"] < MIN_TRUST), ("cycle_violations", f["cycle_violations"]), ("ast_di_divergence", f["divergence"] > 0)) if bad]
    return {"figures": f, "issues": issues, "warnings": sorted(set(warnings)), "coverage": covered, "trust": t, "policy": {"hard": hard, "soft": soft}, "critical_failure": bool(hard), "system_valid": not hard and t["trust_score"] >= MIN_TRUST}
