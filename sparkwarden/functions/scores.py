"""Scalar verdict formulas on the driver: they take one row of counts, never data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from .. import profiles as P


def r3(x: float) -> float:
    return round(float(x), 3)


def c01(x: float) -> float:
    return max(0.0, min(1.0, float(x)))


def div(a: float, b: float) -> float:
    return a / b if b else 0.0


def pair_divergence(a: int, b: int, both: int, either: int, profile: str = "v2") -> float:
    if not either:
        return 0.0
    apart = (either - both) / either
    weight = 0.70 + 0.30 * min(a, b) / either if profile == "v2" else c01(a / max(1, b))
    return r3(apart * weight)


def pair_overlap(a: int, b: int, both: int) -> float:
    if not a and not b:
        return 1.0
    return r3(div(both, min(a, b)))


def structural(invalid_edge_ratio: float, malformed_node_ratio: float) -> float:
    return r3(1 - min(1.0, 0.8 * invalid_edge_ratio + 0.2 * malformed_node_ratio))


def dependency(missing_di: float, divergence: float, drift: float) -> float:
    return r3(1 - min(1.0, 0.65 * c01(missing_di) + 0.20 * c01(divergence) + 0.15 * c01(drift)))


def topology(unreachable: float, di_unreachable: float, orphan_nodes: float, cycles: float) -> float:
    return r3(1 - min(1.0, 0.60 * unreachable + 0.20 * di_unreachable + 0.15 * orphan_nodes + 0.15 * cycles))


def semantic(warnings: int, divergence: float) -> float:
    return r3(1 - min(0.6, 0.18 * warnings + 0.10 * divergence))


def call_frequency(calls: int, unique: int, min_calls: int = 50, min_unique: int = 10) -> float:
    return c01(0.7 * c01(div(calls, max(1, min_calls))) + 0.3 * c01(div(unique, max(1, min_unique))))


def path_centrality(overlap: float, reachable: float) -> float:
    return c01(max(5 * overlap, 3 * reachable))


def scenario_importance(priorities: Sequence[float], coverage: float, warnings: int) -> float:
    top = max(priorities, default=0.0)
    mean = sum(p / top for p in priorities) / len(priorities) if top > 0 else 0.0
    return c01((0.7 * mean + 0.3 * coverage) * (1 - min(0.30, 0.08 * warnings)))


def execution_confidence(coverage: float, overlap: float, frequency: float, centrality: float, scenario: float) -> dict[str, float]:
    """Raw confidence, authority, and the lesser of both."""
    raw = min(c01(10 * coverage), c01(20 * overlap))
    authority = c01(0.5 * frequency + 0.3 * centrality + 0.2 * scenario)
    return {"raw": r3(raw), "authority": r3(authority), "adjusted": r3(min(raw, authority))}


def scenario_completeness(entrypoints: float, domains: float, importance: float, warnings: int) -> float:
    return r3(c01((0.45 * entrypoints + 0.35 * domains + 0.20 * importance) * (1 - min(0.30, 0.08 * warnings))))


def trust(scores: Mapping[str, float], confidence: float, authority: float | None, coverage: float, divergence: float, min_confidence: float = P.MIN_EXECUTION_CONFIDENCE) -> dict:
    """Trust from domain scores: every contribution is rounded before the sum, then the
    execution gate, the authority (with a runtime signal), the coverage floor and the drift
    penalty apply in turn."""
    parts = {d: r3(scores.get(d, 1.0) * w) for d, w in P.DOMAIN_WEIGHTS.items()}
    base = r3(sum(parts.values()))
    gate = confidence if confidence < min_confidence else 1.0
    standing = 1.0 if authority is None else c01(0.5 + 0.5 * authority)
    floor = P.COVERAGE_MULTIPLIER if coverage < P.COVERAGE_FLOOR else 1.0
    penalty = P.DRIFT_PENALTY if divergence > P.DIVERGENCE_LIMIT else 0.0
    gated = r3(base * gate * standing * floor)
    return {"base": base, "contributions": parts, "gated": gated, "penalty": penalty, "trust_score": r3(c01(gated - penalty))}


def policy(m: Mapping[str, float], min_trust: float = 0.0, min_confidence: float = P.MIN_EXECUTION_CONFIDENCE) -> dict:
    """Hard and soft reasons; valid without hard reasons and without the two soft ones that count."""
    ran, layered = bool(m.get("runtime", 0)), m.get("architecture_coverage", 0) >= 0.20
    hard = [
        reason
        for reason, holds in (
            ("no_valid_nodes", m.get("valid_nodes", 1) <= 0),
            ("missing_di_ratio_exceeded", m.get("missing_di_ratio", 0) > 0.50),
            ("orphan_node_ratio_exceeded", m.get("orphan_node_ratio", 0) > 0.40),
            ("architecture_violations_exceeded", layered and m.get("violation_ratio", 0) > 0.60),
            ("coverage_below_floor", m.get("coverage", 0) < P.COVERAGE_FLOOR),
            ("entrypoint_coverage_below_floor", ran and m.get("entrypoint_coverage", 1) < P.MIN_ENTRYPOINT_COVERAGE),
        )
        if holds
    ]
    soft = [
        reason
        for reason, holds in (
            ("trust_below_minimum", m.get("trust", 0) < min_trust),
            ("execution_confidence_below_minimum", m.get("raw_confidence", 0) < min_confidence),
            ("domain_coverage_below_minimum", ran and m.get("expected_domains", 0) > 0 and m.get("domain_coverage", 1) < P.MIN_DOMAIN_COVERAGE),
            ("scenario_coverage_below_minimum", ran and m.get("scenario_coverage", 1) < P.MIN_SCENARIO_COVERAGE),
            ("architecture_drift", bool(m.get("drifted", 0))),
            ("cycles", m.get("cycles", 0) > 0),
            ("architecture_score_low", layered and m.get("architecture_score", 1) < 0.60),
            ("semantic_collisions", m.get("semantic_score", 1) < 0.55 and m.get("collisions", 0) > 0),
            ("causal_score_low", bool(m.get("causal_enforced", 0)) and m.get("causal_score", 1) < 0.40),
        )
        if holds
    ]
    counted = {"trust_below_minimum", "execution_confidence_below_minimum"} & set(soft)
    return {"hard": hard, "soft": soft, "system_valid": not hard and not counted}


def semantic_clusters(cross: float, high: float, collisions: int, files: int) -> float:
    return r3(1 - min(1.0, 0.45 * cross + 0.25 * high + 0.30 * min(1.0, collisions / max(1, files // 8))))


def failure_impacts(scores: Mapping[str, float], drifted: bool = False) -> list[dict]:
    """Domains by impact (1 - score) * weight, then stage and name; a drift is a record of its own."""
    rows = [{"domain": d, "impact": r3((1 - s) * P.FAILURE_WEIGHTS[d]), "stage": P.DOMAIN_ORDER[d]} for d, s in scores.items() if d in P.FAILURE_WEIGHTS]
    if drifted:
        rows.append({"domain": "architecture_drift", "impact": max(0.20, 0.12), "stage": P.DOMAIN_ORDER["architecture_drift"]})
    rows = sorted((r for r in rows if r["impact"] > 0), key=lambda r: (-r["impact"], r["stage"], r["domain"]))
    return [r | {"rank": i + 1} for i, r in enumerate(rows)]


def health_confidence(health: Sequence[float]) -> float:
    return r3(c01(0.45 + 0.4 * (sum(health) / len(health) if health else 0.0)))


def all_or_nothing(scores: Sequence[float]) -> float:
    """The mean, or 0 if any input fails."""
    return r3(sum(scores) / len(scores)) if scores and all(s > 0 for s in scores) else 0.0


def band(score: float, passed: float, degraded: float) -> str:
    return "PASS" if score >= passed else "DEGRADED" if score >= degraded else "FAIL"


def report_scores(structure: Sequence[float], intent: Sequence[float], behaviour: Sequence[float]) -> dict[str, float]:
    """Means of the three structural, intent and behavioural inputs."""
    mean = lambda v: c01(sum(v) / len(v)) if v else 0.0
    return {"structure": mean(structure), "intent": mean(intent), "behaviour": mean(behaviour)}


def redundancy(duplicates: int, collisions: int, cross_context: int, high_overlap: int) -> float:
    return c01(1 - min(1.0, 0.12 * duplicates + 0.12 * collisions + 0.08 * cross_context + 0.05 * high_overlap))


def architectural_quality(intent: float, structure: float, violation_ratio: float, crossing_ratio: float, direct: int) -> float:
    penalty = min(1.0, 0.55 * c01(violation_ratio) + 0.30 * c01(crossing_ratio) + min(0.15, 0.03 * direct))
    return c01(0.60 * intent + 0.40 * structure - penalty)


def design_quality(intent: float, structure: float, execution: float, confirmed: bool, signals: int) -> float:
    intent_first = c01(0.70 * intent + 0.30 * execution)
    structure_first = c01(0.65 * structure + 0.35 * execution)
    return c01(0.40 * intent_first + 0.35 * structure_first + 0.25 * (1.0 if confirmed else c01(signals / 4)))
