"""The final report over an audit's contract: four audits, three principles, design quality.

Everything here reads the one contract that run_audit returns; no table is touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import profiles as P
from ..functions import scores as S
from ..functions.columns import ratio

#: Floors of PASS and DEGRADED.
FLOORS = {
    "structural": (0.75, 0.50), "behavioral": (0.70, 0.45), "redundancy_overlap": (0.80, 0.60), "architectural_quality": (0.72, 0.50),
    "principle": (0.72, 0.48), "design": (0.75, 0.52),
}


def _part(kind: str, score: float, signals: dict, notes: list[tuple[bool, str]]) -> dict:
    found = [text for holds, text in notes if holds]
    return {"score": S.r3(score), "status": S.band(score, *FLOORS[kind]), "signals": signals, "findings": found or ["nothing to report"]}


def final_report(contract: dict) -> dict:
    """contract: what run_audit returns for the full pipeline."""
    summary, verdict = contract["summary"], contract["verification"]
    domains = verdict["domains"]
    score = {name: d["score"] for name, d in domains.items()}
    intent_m, semantic_m, causal_m = (domains[x]["metrics"] for x in ("architectural_intent", "semantic_consistency", "causal_flow"))
    runtime, manifest, graph = summary["runtime"], summary["manifest"], summary["graph"]
    edges = sum(n for kind, n in graph.items() if kind != "nodes")
    coverage, execution = S.c01(S.div(runtime["hit_nodes"], runtime["nodes"])), score["execution_confidence"]
    levels = S.report_scores(
        [score[x] for x in ("structural_integrity", "dependency_consistency", "topology_validation")],
        [score[x] for x in ("architectural_intent", "semantic_consistency", "causal_flow")],
        [execution, coverage, S.c01(causal_m.get("role_coverage_ratio", 0.0) or 0.0)],
    )
    get = lambda m, k: int(m.get(k, 0) or 0)
    duplicates, collisions, cross, high = (get(semantic_m, k) for k in ("duplicate_intent_cluster_count", "abstraction_collision_count", "cross_context_cluster_count", "high_overlap_cluster_count"))
    direct, broken, crossings = get(causal_m, "direct_api_to_persistence_count"), get(intent_m, "violation_count"), get(intent_m, "boundary_crossing_count")
    crossing_ratio = S.c01(S.div(crossings, edges))
    redundancy = S.redundancy(duplicates, collisions, cross, high)
    quality = S.architectural_quality(levels["intent"], levels["structure"], intent_m["violation_ratio"], crossing_ratio, direct)
    ran = runtime["calls"] > 0
    sources = {
        "intent": ["architecture_constraints"] + ["semantic_clusters"] * (semantic_m.get("judged", True)) + ["causal_flow"] * (causal_m.get("judged", True)),
        "structure": ["manifest_inventory", "static_analysis", "dependency_graph", "trust_model"],
        "runtime": ["runtime_execution"] + ["runtime_trace_events"] * ran,
    }
    signals = sum(map(len, sources.values()))
    confirmed = signals >= 4 and len(sources["intent"]) >= 2 and len(sources["structure"]) >= 2 and len(sources["runtime"]) >= 1
    principles = {"intent_over_execution": S.c01(0.70 * levels["intent"] + 0.30 * execution), "structure_over_runtime_alone": S.c01(0.65 * levels["structure"] + 0.35 * execution)}
    design = S.design_quality(levels["intent"], levels["structure"], execution, confirmed, signals)
    parts = {
        "structural": _part(
            "structural", levels["structure"], {"file_count": manifest["file_count"], "entrypoint_count": manifest["entrypoint_count"], "graph_node_count": graph["nodes"], "graph_edge_count": edges, "architecture_violation_count": broken},
            [(not manifest["file_count"], "no file is in the inventory"), (not graph["nodes"], "the graph has no node"), (broken > 0, f"{broken} edges break architecture rules"), (intent_m["constraint_coverage_ratio"] < 0.6, "under 0.60 of the edges join known layers")],
        ),
        "behavioral": _part(
            "behavioral", levels["behaviour"], {"call_event_count": runtime["calls"], "coverage_ratio": S.r3(coverage), "workflow_count": get(causal_m, "workflow_count"), "execution_confidence": execution},
            [(not ran, "nothing ran"), (ran and execution < P.MIN_EXECUTION_CONFIDENCE, "execution confidence is below its minimum"), (ran and not get(causal_m, "workflow_count"), "no workflow was found in the trace"), (direct > 0, f"{direct} steps lead from an interface straight to storage")],
        ),
        "redundancy_overlap": _part(
            "redundancy_overlap", redundancy, {"duplicate_intent_cluster_count": duplicates, "abstraction_collision_count": collisions, "cross_context_cluster_count": cross, "high_overlap_cluster_count": high},
            [(duplicates > 0, f"{duplicates} clusters repeat an intent"), (collisions > 0, f"{collisions} concepts have several kinds of abstraction"), (cross > 0, f"{cross} clusters span contexts"), (high > 0, f"{high} clusters overlap highly")],
        ),
        "architectural_quality": _part(
            "architectural_quality", quality, {"intent_score": S.r3(levels["intent"]), "structure_score": S.r3(levels["structure"]), "violation_ratio": intent_m["violation_ratio"], "boundary_crossing_ratio": S.r3(crossing_ratio)},
            [(broken > 0, f"{broken} breaches of intent"), (crossings > 0, f"{crossings} edges cross owners without a contract"), (direct > 0, "storage is reached without mediation")],
        ),
    }
    parts["architectural_quality"]["missing_stages"] = sorted(i["type"] for i in verdict["issues"] if i["type"].startswith("MISSING_") and i["domain"] == "causal_flow")
    parts["architectural_quality"]["root_causes"] = [c["id"] for c in contract["diagnostics"]["root_causes"][:3]]
    authority = "multi_signal_intent_first" if confirmed else "intent_and_structure_with_limited_runtime" if sources["intent"] and sources["structure"] else "single_metric_fallback"
    return {
        "audits": parts,
        "principles": {k: {"score": S.r3(x), "status": S.band(x, *FLOORS["principle"])} for k, x in principles.items()} | {"multi_signal_confirmation": {"score": 1.0 if confirmed else S.r3(S.c01(signals / 4)), "status": "PASS" if confirmed else "FAIL", "sources": sources}},
        "design_quality": {"score": S.r3(design), "status": S.band(design, *FLOORS["design"]), "authority": authority},
        "answers": answers(parts, runtime, confirmed),
        "summary": {"status": "PASSED" if contract["system_valid"] else "FAILED", "signals": signals, "heat": summary["heat"]},
    }


def answers(parts: dict, runtime: dict, confirmed: bool) -> list[dict]:
    """Three questions that a reader asks, each with its answer and what it rests on."""
    weak = sorted(k for k, p in parts.items() if p["status"] != "PASS")
    return [
        {"question": "Does the structure hold?", "answer": parts["structural"]["status"], "evidence": parts["structural"]["findings"]},
        {"question": "Does it behave as intended?", "answer": parts["behavioral"]["status"] if runtime["calls"] else "UNKNOWN", "evidence": parts["behavioral"]["findings"]},
        {"question": "What has to change first?", "answer": weak[0] if weak else "nothing", "evidence": parts[weak[0]]["findings"] if weak else [], "confirmed": confirmed},
    ]


def runtime_meaning(trace: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """trace (event, node_id, module, local: whether the module is the tree's own, depth) ->
    one row: modules, local_modules, functions, local_functions, max_depth, calls, imports,
    and reasons (an array): what is too little for the trace to mean anything."""
    t = P.MEANINGFUL | (thresholds or {})
    call = F.col("event") == "call"
    own = F.coalesce("local", F.lit(False))
    one = trace.agg(
        F.countDistinct(F.when(call, F.col("module"))).alias("modules"), F.countDistinct(F.when(call & own, F.col("module"))).alias("local_modules"),
        F.countDistinct(F.when(call, F.col("node_id"))).alias("functions"), F.countDistinct(F.when(call & own, F.col("node_id"))).alias("local_functions"),
        F.coalesce(F.max(F.when(call, F.col("depth"))), F.lit(0)).alias("max_depth"), F.count_if(call).alias("calls"), F.count_if(F.col("event") == "import").alias("imports"),
    )
    few = [F.when(F.col(k) < least, f"{k}_below_{least}") for k, least in t.items() if k in one.columns]
    return one.withColumn("reasons", F.array_compact(F.array(*few, F.when(F.col("calls") <= F.col("imports"), "calls_not_above_imports"))))


def truth_layer(meaning: DataFrame, shared: DataFrame, nodes: int, reached: int, isolated: int, warm: DataFrame) -> DataFrame:
    """One row of issues (an array) over runtime_meaning's row, reconcile's row (static_edges,
    shared_edges), the graph's counts, and warm_near_hot's row (conflicts)."""
    t = P.MEANINGFUL
    one = meaning.select("reasons").crossJoin(F.broadcast(shared.select("static_edges", "shared_edges"))).crossJoin(F.broadcast(warm.select("conflicts")))
    n = max(1, nodes)
    more = F.array_compact(
        F.array(
            F.when((F.col("static_edges") > 0) & (ratio(F.col("shared_edges"), F.col("static_edges")) < t["confirmed_edges"]), "confirmed_edges_below_minimum"),
            F.when(F.lit(reached / n) < t["reachable_nodes"], "reachable_nodes_below_minimum"),
            F.when(F.lit(isolated / n) > t["isolated_nodes"], "isolated_nodes_above_maximum"),
            F.when(F.col("conflicts") > 0, "dead_nodes_with_evidence"),
        )
    )
    return one.select(F.concat("reasons", more).alias("issues")).withColumn("passed", F.size("issues") == 0)


def contract_health(contract: dict, stages: tuple[str, ...]) -> dict:
    """Whether all stages ran, in their order, and left their sections."""
    ran = list(contract.get("stages", []))
    wanted = {"manifest": "manifest", "static": "static", "graph": "graph", "heat": "heat"}
    missing = [s for s, k in wanted.items() if s in stages and not contract.get("summary", {}).get(k)]
    missing += [k for s, k in (("verification", "verification"), ("diagnostics", "diagnostics")) if s in stages and not contract.get(k)]
    return {"pipeline_success": set(stages) <= set(ran), "stage_order_ok": ran == list(stages), "missing_sections": missing, "passed": ran == list(stages) and not missing}
