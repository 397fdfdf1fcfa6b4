"""Diagnostics over a verification result: status, sections, ranked causes, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from ..functions.columns import clamp
from ..operators import ranking
from ..operators.tables import stored

#: Sections of the report and the domain that each reads.
SECTIONS = {
    "structural_validation": "structural_integrity",
    "resolver_consistency": "dependency_consistency",
    "reachability_analysis": "topology_validation",
    "semantic_validation": "semantic_observations",
    "architecture_constraints": "architectural_intent",
    "semantic_consistency": "semantic_consistency",
    "causal_flow": "causal_flow",
}


#: The kind of cause that a domain's issues are.
CAUSE_KINDS = {
    "structural_integrity": "STRUCTURAL",
    "dependency_consistency": "RESOLVER",
    "topology_validation": "REACHABILITY",
    "semantic_observations": "SEMANTIC",
    "architectural_intent": "ARCHITECTURE",
    "semantic_consistency": "SEMANTIC",
    "causal_flow": "PROCESS",
}
#: The stages that an issue goes through, by its domain.
PROPAGATION = {
    "dependency_consistency": ("AST extraction", "Resolver consistency", "Graph build", "Reachability analysis", "Validation failure"),
    "topology_validation": ("Resolver consistency", "Graph build", "Reachability analysis", "Semantic validation", "Validation failure"),
    "structural_integrity": ("Canonical synthesis", "Graph build", "Reachability analysis", "Validation failure"),
    "": ("AST extraction", "Resolver consistency", "Graph build", "Semantic validation", "Validation failure"),
}
#: Issues that come from the resolver whatever domain reports them.
RESOLVER_ISSUES = ("MISSING_DI_NODES", "GRAPH_DI_DRIFT")
#: What to do about an issue, in the order of the domains.
ACTIONS = {
    "MALFORMED_NODE_ID": "Bring node ids into their canonical form before the graph is built.",
    "DUPLICATE_NODE_ID": "Give every node one id where ids are made.",
    "INVALID_NODE_NAMESPACE": "Use ids of the form canonical://<namespace>/<path>.",
    "MALFORMED_EDGE_SCHEMA": "Write source, target, type and confidence of every edge.",
    "INVALID_EDGE_TYPE": "Use no edge types but the allowed ones.",
    "UNRESOLVED_EDGE_REFERENCE": "Let every edge end at nodes that are in the graph.",
    "MISSING_DI_NODES": "Let the resolver name injected nodes as the graph does.",
    "AST_DI_DIVERGENCE_TRACKED": "Look at how parsed and injected edges drift apart.",
    "GRAPH_DI_DRIFT": "Bring injected edges of the graph and of the resolver together.",
    "MISSING_ENTRYPOINTS": "Name entrypoints that are nodes of the graph.",
    "UNREACHABLE_NODES": "Link nodes that no entrypoint reaches, or allow them to stand alone.",
    "UNEXPECTED_ORPHAN_SUBGRAPH": "Link the parts that stand apart.",
    "CYCLE_POLICY_VIOLATION": "Break the cycles, or allow them by policy.",
    "ARCHITECTURE_CONSTRAINT_VIOLATION": "Keep to the direction of layers, to ownership, and to orchestrated changes of state.",
    "DUPLICATE_INTENT_CLUSTERS": "Merge clusters that serve one intent, under one owner.",
    "FAKE_ABSTRACTION_COLLISION": "Keep one kind of abstraction for one concept.",
    "NO_WORKFLOW_RECONSTRUCTION": "Trace more scenarios from end to end.",
    "MISSING_API_BOUNDARY": "Trace workflows from their API boundary on.",
    "MISSING_DOMAIN_DECISION_STAGE": "Let workflows pass through a decision of the domain.",
    "MISSING_SIDE_EFFECT_OR_PERSISTENCE_STAGE": "Trace workflows up to what they write or cause.",
    "DIRECT_API_TO_PERSISTENCE_PATH": "Put the domain between the API boundary and what is stored.",
}
#: Domains whose scores are the system's health.
HEALTH = ("structural_integrity", "topology_validation", "dependency_consistency", "semantic_observations")
#: Share of centrality where no node, or no edge, is known; share of a domain's impact.
UNKNOWN_CENTRALITY, IMPACT_SHARE = 0.30, 0.25


def status(hard: bool, causes: list[dict], health: list[float]) -> str:
    """FAIL on a hard reason, a severe cause or a very low domain; DEGRADED with any cause."""
    if hard:
        return "FAIL"
    if not causes:
        return "PASS"
    return "FAIL" if max(c["severity"] for c in causes) >= 0.85 or min(health, default=1.0) < 0.40 else "DEGRADED"


def stability(state: str, causes: list[dict]) -> str:
    """BROKEN by a severe structural or resolver cause, FRAGILE by three causes of several
    kinds, DEGRADED by any that matters or a failure, else STABLE."""
    if any(c["kind"] in ("STRUCTURAL", "RESOLVER") and c["severity"] >= 0.85 for c in causes):
        return "BROKEN"
    if len(causes) >= 3 and len({c["kind"] for c in causes}) >= 2:
        return "FRAGILE"
    return "DEGRADED" if state == "FAIL" or any(c["severity"] > 0.2 for c in causes) else "STABLE"


def sections(result: dict) -> dict[str, dict]:
    """Score and band of every section that has been evaluated."""
    have = {s: result["domains"][d]["score"] for s, d in SECTIONS.items() if d in result["domains"]}
    return {s: {"score": x, "status": S.band(x, 0.90, 0.65)} for s, x in have.items()}


def issue_table(spark: SparkSession, result: dict) -> DataFrame:
    """The result's issues as a table, one row a sampled node."""
    rows = []
    for i, x in enumerate(result["issues"]):
        nodes = [str(n) for n in x["sample"]] or [None]
        rows += [(i, x["domain"], x["type"], x["severity"], x["message"], x["count"] if k == 0 else 0, n) for k, n in enumerate(nodes)]
    return spark.createDataFrame(rows, "idx long, domain string, type string, severity string, message string, count long, node string")


def _by_name(name: Column, choices: dict, otherwise: Column) -> Column:
    out = otherwise
    for k, v in choices.items():
        out = F.when(name == k, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def causes(issues: DataFrame, edges: DataFrame, impacts: DataFrame) -> DataFrame:
    """issues (idx, domain, type, severity, message, count, node: a row a sampled node), edges,
    impacts (domain, impact) -> the ranked causes, one of each collapsed issue: rank, id, kind,
    domain, type, severity, confidence, message, count, nodes, path, action.

    Severity weighs the issue's own (with a share of its domain's impact), how central its
    sampled nodes are on the mean, and how frequent it is.  Only issue rows meet degrees; the
    one window is over collapsed issues.
    """
    degree = edges.select(F.explode(F.array("source", "target")).alias("node")).where("trim(node) <> ''").groupBy("node").agg(F.count("*").alias("degree"))
    degree = stored(degree, "degree")
    found = stored(ranking.collapse_issues(issues).withColumn("type", F.upper("type")), "issues")
    group = ["domain", "type", "message"]
    share = F.coalesce(F.col("degree") / F.col("top"), F.lit(0.0))
    one = degree.agg(F.coalesce(F.max("degree"), F.lit(0)).alias("top"))
    most = issues.groupBy("idx").agg(F.max("count").alias("c")).agg(F.greatest(F.lit(1), F.coalesce(F.max("c"), F.lit(1))).alias("most"))
    central = found.select(*group, F.explode("nodes").alias("node")).join(degree, "node", "left").crossJoin(F.broadcast(one)).groupBy(*group).agg(F.max("top").alias("top"), F.round(F.avg(share), 3).alias("mean"))
    central = central.select(*group, F.when(F.col("top") > 0, F.col("mean")).alias("mean"))
    rows = found.join(central, group, "left").join(impacts.select("domain", "impact"), "domain", "left").crossJoin(F.broadcast(most))
    weight = clamp(ranking.severity_weight(F.col("severity")) + clamp(F.coalesce("impact", F.lit(0.0)) * IMPACT_SHARE))
    frequency = F.round(clamp(F.greatest(F.lit(1), "count") / F.col("most")), 3)
    severity = F.round(weight * 0.5 + F.coalesce("mean", F.lit(UNKNOWN_CENTRALITY)) * 0.3 + frequency * 0.2, 3)
    evidence = clamp(F.least(F.lit(5), F.size("nodes")) * 0.1 + F.least(F.lit(20), "count") / 40.0)
    scored = rows.select("*", severity.alias("score")).withColumn("confidence", F.round(clamp(F.col("score") * 0.65 + evidence * 0.35), 3))
    ranked = scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("confidence"), "domain", "type", "message")))
    steps = {k: F.array(*[F.lit(x) for x in v]) for k, v in PROPAGATION.items()}
    path = F.when(F.col("type").isin(*RESOLVER_ISSUES), steps["dependency_consistency"]).otherwise(_by_name(F.col("domain"), {k: v for k, v in steps.items() if k}, steps[""]))
    return ranked.select(
        "rank", F.format_string("rc-%02d-%s", "rank", F.lower("type")).alias("id"), _by_name(F.col("domain"), CAUSE_KINDS, F.lit("SEMANTIC")).alias("kind"), "domain", "type",
        F.col("score").alias("severity"), "confidence", "message", "count", "nodes", path.alias("path"), _by_name(F.col("type"), ACTIONS, F.lit(None).cast("string")).alias("action"),
    )


def recommendations(causes: list[dict]) -> list[str]:
    """What to do, in the order of the causes, each once."""
    known = list(dict.fromkeys(c["action"] for c in causes if c["action"]))
    return known or (["See to the first cause, then verify again."] if causes else ["Nothing to do but to watch for drift."])


def causal_chain(state: str, causes: list[dict]) -> list[dict]:
    """How the first cause led to the verdict, a step each; none for a pass."""
    if state == "PASS":
        return []
    if not causes:
        return [{"step": 1, "cause": "a verdict that is no pass, without an issue", "effect": "degraded for want of evidence"}]
    first = causes[0]
    stages = first["path"]
    steps = [{"step": i, "cause": f"{first['kind'].lower()} trouble in: {a}", "effect": f"carried into: {b}"} for i, (a, b) in enumerate(zip(stages, stages[1:]), 1)]
    return [*steps, {"step": len(stages), "cause": f"{first['domain']}: {first['type']}: {first['message']}", "effect": f"verdict {state}"}]


def level(severity: float) -> str:
    return "HIGH" if severity >= 0.8 else "MEDIUM" if severity >= 0.5 else "LOW"


def diagnose(spark: SparkSession, result: dict, edges: DataFrame, most: int = 50) -> dict:
    """Status, summary, sections, the first ``most`` causes, the chain that led to the verdict
    and what to do; the verdict itself is never changed."""
    impacts = spark.createDataFrame([(f["domain"], float(f["impact"])) for f in result["failures"]], "domain string, impact double")
    rows = causes(issue_table(spark, result), edges, impacts).orderBy("rank").limit(most).collect()
    found = [r.asDict() for r in rows]
    health = [result["domains"][d]["score"] if d in result["domains"] else 0.5 for d in HEALTH]
    state = status(bool(result["policy"]["hard"]), found, health)
    first = [f"{c['domain']}: {c['type']}: {c['message']}" for c in found]
    return {
        "status": state, "stability": stability(state, found), "primary": first[0] if first else "none", "secondary": first[1:4], "sections": sections(result),
        "confidence": found[0]["confidence"] if found else S.health_confidence(health), "root_causes": found, "causal_chain": causal_chain(state, found),
        "failure_domains": list(dict.fromkeys(c["kind"].lower() for c in found)), "recommended_actions": recommendations(found),
        "top_issues": [{"rank": c["rank"], "type": c["id"], "domain": c["kind"].lower(), "severity": level(c["severity"]), "impact": c["severity"]} for c in found],
    }


def run_figures(contract: dict) -> dict[str, float]:
    """What two audits are compared by: coverage, overlap, and hot and warm nodes."""
    runtime, heat = contract["summary"]["runtime"], contract["summary"]["heat"]
    return {"coverage": S.div(runtime["hit_nodes"], runtime["nodes"]), "overlap": S.div(runtime["shared_edges"], runtime["static_edges"]), "hot_and_warm": heat["hot"] + heat["warm"]}


def regressions(before: dict, after: dict) -> list[str]:
    """Which of coverage, overlap and number of hot and warm nodes did not improve."""
    return [f"{k}_did_not_improve" for k in ("coverage", "overlap", "hot_and_warm") if after.get(k, 0) <= before.get(k, 0)]


def compared(before: dict, after: dict) -> dict:
    """Two contracts: their figures, what did not improve, and a score that is 0 unless all did."""
    a, b = run_figures(before), run_figures(after)
    worse = regressions(a, b)
    return {"before": a, "after": b, "regressions": worse, "score": S.all_or_nothing([0.0 if f"{k}_did_not_improve" in worse else 1.0 for k in a])}


def _step(key: Column) -> Column:
    """A key as a step of a normalized path: quoted, so that no two keys look alike."""
    return F.concat(F.lit("['"), F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("']"))


def json_leaves(documents: DataFrame, whole_lists: bool = False) -> DataFrame:
    """documents (id, json) -> id, path, key, value: every value of the documents that is neither
    an object nor a list, and every empty one of these, at its normalized path ($['a'][0]['b']);
    key is the nearest object key above it.  With whole_lists a list is one value.

    A round takes one level of all documents apart, so a document of any size is rows.  A key
    that an object repeats counts as it stands last.
    """
    rest = stored(documents.select("id", F.lit("$").alias("path"), F.lit("").alias("key"), F.col("json").alias("value")).where("value is not null"), "json")
    done = rest.limit(0)
    while not rest.isEmpty():
        kind = F.substring(F.ltrim("value"), 1, 1)
        held = (kind == "{") | (F.lit(not whole_lists) & (kind == "["))
        empty = F.regexp_replace("value", r"\s", "").isin("{}", "[]")
        done = done.union(rest.where(~held | empty))
        inner = rest.where(held & ~empty)
        entries = F.map_entries(F.from_json("value", "map<string, variant>"))
        fields = inner.where(kind == "{").select("id", "path", F.posexplode(entries).alias("pos", "e"))
        fields = fields.groupBy("id", F.concat("path", _step(F.col("e.key"))).alias("path")).agg(F.max_by("e.key", "pos").alias("key"), F.max_by(F.to_json("e.value"), "pos").alias("value"))
        items = inner.where(kind == "[").select("id", "path", "key", F.posexplode(F.from_json("value", "array<variant>"))).select("id", F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")).alias("path"), "key", F.to_json("col").alias("value"))
        # A null of a document is the text null: a value, not the lack of one.
        rest = stored(fields.union(items).withColumn("value", F.coalesce("value", F.lit("null"))), "json")
    return done


def differences(a: DataFrame, b: DataFrame, masked: tuple[str, ...] = ()) -> DataFrame:
    """Leaves (id, path, key, value) of documents of two sides -> id, path, left, right where
    they differ; a value that one side lacks is null there.  Leaves below a masked key as the
    nearest one are left out."""
    keep = lambda rows: rows.where(~F.col("key").isin(*masked)) if masked else rows
    left, right = (keep(x).select("id", "path", F.col("value").alias(n)) for x, n in ((a, "left"), (b, "right")))
    both = left.unionByName(right, allowMissingColumns=True).groupBy("id", "path").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    return both.where(~F.col("left").eqNullSafe(F.col("right")))
