"""Verification of a graph: domain evaluators on Spark, verdict formulas on the driver.

Each evaluator reduces its tables to one row of counts in Spark; what reaches the driver
is that row and a bounded sample of identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import profiles as P
from ..functions import scores as S
from ..functions.columns import node_path, valid_namespace
from ..operators import graph, pairs
from ..operators.tables import stored
from . import domains as D
from .verdict import Domain, issue, sample


def structural_integrity(nodes: DataFrame, edges: DataFrame, allow_call: bool = False, keep: bool = True) -> tuple[Domain, DataFrame]:
    """Also returns the status of every distinct edge; it is stored if it is to be read again
    (keep)."""
    allowed = P.ALLOWED_EDGE_TYPES["v2"] + (("CALL",) if allow_call else ())
    status = pairs.edge_status(nodes, edges, allowed)
    status = stored(status, "edge-status") if keep else status
    by = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
    n = nodes.groupBy("node_id").agg(F.count("*").alias("k")).agg(
        F.count_if(F.trim(F.coalesce("node_id", F.lit(""))) == "").alias("malformed"), F.count_if((F.col("k") > 1) & (F.col("node_id") != "")).alias("repeated"),
        F.count_if((F.trim("node_id") != "") & ~valid_namespace(F.col("node_id"))).alias("namespace"), F.count("*").alias("n"),
    ).first()
    bad = sum(by.get(k, 0) for k in ("malformed", "invalid_type", "unresolved"))
    total = bad + by.get("valid", 0)
    counts = (
        ("MALFORMED_NODE_ID", "HIGH", n["malformed"]),
        ("DUPLICATE_NODE_ID", "MEDIUM", n["repeated"]),
        ("INVALID_NODE_NAMESPACE", "MEDIUM", n["namespace"]),
        ("MALFORMED_EDGE_SCHEMA", "HIGH", by.get("malformed", 0)),
        ("INVALID_EDGE_TYPE", "MEDIUM", by.get("invalid_type", 0)),
        ("UNRESOLVED_EDGE_REFERENCE", "HIGH", by.get("unresolved", 0)),
    )
    name = "structural_integrity"
    issues = [issue(name, k, s, k.replace("_", " ").lower(), c) for k, s, c in counts if c]
    ratios = S.div(bad, total), S.div(n["malformed"] + n["namespace"], n["n"])
    return Domain(name, S.structural(*ratios), {"invalid_edge_ratio": S.r3(ratios[0]), "malformed_node_ratio": S.r3(ratios[1]), "valid_edges": by.get("valid", 0), "valid_nodes": n["n"] - n["malformed"]}, issues), status


def dependency_consistency(nodes: DataFrame, edges: DataFrame, resolver: DataFrame) -> Domain:
    """resolver: source, target, origin."""
    name, keys = "dependency_consistency", ["source", "target"]
    rows = pairs.resolver_edges(resolver)
    of = lambda origin: rows.where(F.col("origin") == origin).select(*keys)
    graph_di = edges.where("type = 'DI'").select(*keys)
    ast_di, drift = pairs.pair_counts(of("AST"), of("DI"), keys).first(), pairs.pair_counts(graph_di, of("DI"), keys).first()
    ends = of("DI").select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    missing = ends.join(nodes.select("node_id").distinct(), "node_id", "left_anti")
    n_missing, n_ends = missing.count(), ends.count()
    divergence = S.pair_divergence(ast_di["n_a"], ast_di["n_b"], ast_di["n_both"], ast_di["n_either"])
    drifted = S.pair_divergence(drift["n_a"], drift["n_b"], drift["n_both"], drift["n_either"])
    ratio = S.div(n_missing, n_ends)
    issues = []
    if n_missing:
        issues.append(issue(name, "MISSING_DI_NODES", "HIGH", "injected nodes are not in the graph", n_missing, sample(missing, "node_id")))
    if divergence > 0:
        high = divergence > P.DIVERGENCE_LIMIT
        issues.append(issue(name, "AST_DI_DIVERGENCE_ESCALATED" if high else "AST_DI_DIVERGENCE_TRACKED", "HIGH" if high else "LOW", "parsed and injected pairs differ", ast_di["n_either"] - ast_di["n_both"]))
    if drifted > 0.35:
        issues.append(issue(name, "GRAPH_DI_DRIFT", "MEDIUM", "graph and resolver injections differ", round(drifted * max(1, drift["n_a"] + drift["n_b"]))))
    metrics = {"missing_di_ratio": S.r3(ratio), "ast_di_divergence": divergence, "ast_di_overlap": S.pair_overlap(ast_di["n_a"], ast_di["n_b"], ast_di["n_both"]), "graph_di_drift": drifted}
    return Domain(name, S.dependency(ratio, divergence, drifted), metrics, issues)


def topology_validation(nodes: DataFrame, links: DataFrame, entrypoints: DataFrame, isolated: DataFrame, di_nodes: DataFrame, cycles_allowed: bool = False) -> Domain:
    """links: valid edges.  Without an entrypoint in the graph reachability is not judged."""
    name = "topology_validation"
    all_nodes = stored(nodes.select("node_id").where("node_id <> ''").distinct(), "nodes")
    n = all_nodes.count()
    starts = entrypoints.select("node_id").distinct().join(all_nodes, "node_id", "left_semi")
    issues = []
    cyclic = graph.peel(all_nodes, links)
    n_cyclic = cyclic.count()
    lost, n_lost, di_lost, orphaned = None, 0, 0, 0
    if starts.isEmpty():
        issues.append(issue(name, "MISSING_ENTRYPOINTS", "HIGH", "no entrypoint is in the graph", 1))
    else:
        seen = graph.reach(links, starts, all_nodes)
        lost = stored(all_nodes.join(seen, "node_id", "left_anti"), "unreached")
        n_lost = lost.count()
        di_lost = lost.join(di_nodes.select("node_id").distinct(), "node_id", "left_semi").count()
        kinds = graph.islands(graph.weak_components(lost, links), isolated, cyclic)
        unexpected = kinds.where("kind = 'orphan_subgraph'").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("members")).first()
        orphaned = unexpected["members"]
        if n_lost:
            issues.append(issue(name, "UNREACHABLE_NODES", "MEDIUM", "nodes no entrypoint reaches", n_lost, sample(lost, "node_id")))
        if unexpected["n"]:
            issues.append(issue(name, "UNEXPECTED_ORPHAN_SUBGRAPH", "MEDIUM", "subgraphs without a reason to stand alone", unexpected["n"]))
    if n_cyclic and not cycles_allowed:
        issues.append(issue(name, "CYCLE_POLICY_VIOLATION", "MEDIUM", "nodes on or behind a cycle", n_cyclic, sample(cyclic, "node_id")))
    ratios = [S.div(x, n) for x in (n_lost, di_lost, orphaned, 0 if cycles_allowed else n_cyclic)]
    metrics = dict(zip(("unreachable_ratio", "di_unreachable_ratio", "orphan_node_ratio", "cycle_ratio"), map(S.r3, ratios)))
    return Domain(name, S.topology(*ratios), metrics, issues)


def run_verification(
    nodes: DataFrame, edges: DataFrame, resolver: DataFrame, entrypoints: DataFrame, evidence: dict | None = None, min_trust: float = 0.0, allow_call: bool = False,
    paths: DataFrame | None = None, files: DataFrame | None = None, symbols: DataFrame | None = None, trace: DataFrame | None = None,
) -> dict:
    """The verdict: eight domains, trust, policy, failure ranks.

    nodes: node_id and optionally isolated (boolean); edges: source, target, type,
    confidence; resolver: source, target, origin; entrypoints: node_id.  evidence: see
    domains.execution_confidence.  paths: source_path, target_path of edges (default: those of
    the valid edges' canonical ids); files: path, symbols: name, file and trace: run_id, seq,
    role, of call events; without these semantics or causal flow are not judged and score 1.
    """
    structure, status = structural_integrity(nodes, edges, allow_call)
    links = status.where("status = 'valid'").select("source", "target")
    dependency = dependency_consistency(nodes, edges, resolver)
    isolated: Column = F.col("isolated") if "isolated" in nodes.columns else F.lit(False)
    di = pairs.resolver_edges(resolver).where("origin = 'DI'").select(F.explode(F.array("source", "target")).alias("node_id"))
    topology = topology_validation(nodes, links, entrypoints, nodes.where(isolated).select("node_id"), di)
    warnings = [w for d in (structure, dependency, topology) for w in d.warnings]
    divergence = dependency.metrics["ast_di_divergence"]
    observations = Domain("semantic_observations", S.semantic(len(warnings), divergence), {"warnings": len(warnings)})
    e = evidence or {}
    execution = D.execution_confidence(e)
    ran = execution.metrics["runtime_signal_present"]
    if paths is None:
        paths = links.select(node_path(F.col("source")).alias("source_path"), node_path(F.col("target")).alias("target_path")).where("source_path is not null and target_path is not null")
    intent = D.architectural_intent(paths)
    missing = lambda name, what: Domain(name, 1.0, {"judged": False}, [], [f"{what}: not judged"])
    semantics = D.semantic_consistency(files, symbols) if files is not None and symbols is not None else missing("semantic_consistency", "no symbols")
    causal = D.causal_flow(trace) if trace is not None else missing("causal_flow", "no trace")
    every = [structure, dependency, topology, observations, execution, intent, semantics, causal]
    scores = {d.name: d.score for d in every}
    trust = S.trust(scores, execution.score, execution.metrics["authority"] if ran else None, e.get("coverage", 0.0), divergence)
    drifted = divergence > P.DIVERGENCE_LIMIT
    m = {
        "valid_nodes": structure.metrics["valid_nodes"], "missing_di_ratio": dependency.metrics["missing_di_ratio"], "orphan_node_ratio": topology.metrics["orphan_node_ratio"],
        "coverage": e.get("coverage", 0.0), "trust": trust["trust_score"], "raw_confidence": execution.metrics["raw"], "runtime": ran, "drifted": drifted,
        "entrypoint_coverage": execution.metrics["entrypoint_coverage"], "domain_coverage": execution.metrics["domain_coverage"], "scenario_coverage": execution.metrics["scenario_coverage"],
        "expected_domains": execution.metrics["expected_domains"], "cycles": sum(i["type"] == "CYCLE_POLICY_VIOLATION" for i in topology.issues),
        "architecture_coverage": intent.metrics["constraint_coverage_ratio"], "violation_ratio": intent.metrics["violation_ratio"], "architecture_score": intent.score,
        "semantic_score": semantics.score, "collisions": semantics.metrics.get("abstraction_collision_count", 0), "causal_enforced": causal.metrics.get("analysis_enforced", False), "causal_score": causal.score,
    }
    verdict = S.policy(m, min_trust)
    issues = sorted((i for d in every for i in d.issues), key=lambda i: (P.DOMAIN_ORDER[i["domain"]], P.SEVERITY_RANK.get(i["severity"], 99), i["type"]))
    return {
        "domains": {d.name: {"score": d.score, "metrics": d.metrics, "warnings": d.warnings} for d in every}, "issues": issues, "trust": trust, "policy": verdict,
        "failures": S.failure_impacts(scores, drifted), "trust_score": trust["trust_score"], "system_valid": verdict["system_valid"],
    }
