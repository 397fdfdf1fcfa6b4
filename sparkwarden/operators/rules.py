"""Architecture rules over edges with paths: violations, their counts, the score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import profiles as P
from ..functions.columns import clamp, is_adapter, is_contract, is_persistence, is_service, layer, owner, ratio, segments

#: Rule names and severities, in the order in which they are checked.
RULES = {
    "LAYER_DIRECTION_VIOLATION": "HIGH",
    "SERVICE_IMPORTS_ADAPTER": "MEDIUM",
    "DIRECT_STATE_CHANGE_BYPASSES_ORCHESTRATOR": "MEDIUM",
    "OWNERSHIP_BOUNDARY_CROSSING": "LOW",
}


def described(edges: DataFrame) -> DataFrame:
    """edges (source_path, target_path) with layer and owner of both ends."""
    return edges.select(
        "source_path", "target_path", layer(F.col("source_path")).alias("source_layer"), layer(F.col("target_path")).alias("target_layer"),
        owner(F.col("source_path")).alias("source_owner"), owner(F.col("target_path")).alias("target_owner"),
    )


def violations(edges: DataFrame) -> DataFrame:
    """One row an edge and rule: source_path, target_path, rule_id, severity.

    All rules are one array expression per edge, so the edges are read once.
    """
    e = described(edges)
    s, t = F.col("source_path"), F.col("target_path")
    forbidden = F.lit(False)
    for name, allowed in P.ALLOWED_LAYERS.items():
        if name != "unknown":
            forbidden = forbidden | ((F.col("source_layer") == name) & (F.col("target_layer") != "unknown") & ~F.col("target_layer").isin(*allowed))
    owners = (F.col("source_owner") != "") & (F.col("target_owner") != "") & (F.col("source_owner") != F.col("target_owner"))
    holds = {
        "LAYER_DIRECTION_VIOLATION": forbidden,
        "SERVICE_IMPORTS_ADAPTER": is_service(s) & is_adapter(t),
        "DIRECT_STATE_CHANGE_BYPASSES_ORCHESTRATOR": (F.col("source_layer") == "api") & is_persistence(t) & ~F.array_contains(segments(s), "orchestrator"),
        "OWNERSHIP_BOUNDARY_CROSSING": owners & ~is_contract(s) & ~is_contract(t),
    }
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule_id"), F.lit(RULES[r]).alias("severity"))) for r, c in holds.items()]))
    return e.select("*", F.explode(found).alias("v")).select("source_path", "target_path", "source_layer", "target_layer", "source_owner", "target_owner", "v.*")


def rule_counts(edges: DataFrame) -> DataFrame:
    """rule_id, n over all violations (repeated edges count)."""
    return violations(edges).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


def violation_sample(found: DataFrame, limit: int = 250) -> DataFrame:
    """Distinct violations, the first ones by rule and paths."""
    return found.select("rule_id", "source_path", "target_path").distinct().orderBy("rule_id", "source_path", "target_path").limit(limit)


def architecture_score(edges: DataFrame) -> DataFrame:
    """One row: edges, layered edges, violations, crossings and the score."""
    e = described(edges)
    layered = (F.col("source_layer") != "unknown") & (F.col("target_layer") != "unknown")
    counts = e.agg(F.count("*").alias("edges"), F.count_if(layered).alias("layered_edges"))
    v = violations(edges).agg(F.count("*").alias("violations"), F.count_if(F.col("rule_id") == "OWNERSHIP_BOUNDARY_CROSSING").alias("crossings"))
    one = counts.crossJoin(F.broadcast(v))
    violation_ratio = ratio(F.col("violations"), F.col("layered_edges"))
    coverage = ratio(F.col("layered_edges"), F.col("edges"))
    crossing = ratio(F.col("crossings"), F.col("edges"))
    score = 1 - F.least(F.lit(1.0), 0.65 * violation_ratio + 0.20 * (1 - clamp(coverage)) + 0.15 * crossing)
    return one.select("edges", "layered_edges", "violations", "crossings", F.round(violation_ratio, 3).alias("violation_ratio"), F.round(coverage, 3).alias("coverage"), F.round(score, 3).alias("score"))


def layer_ranks(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Edges whose source's layer ranks under their target's (an escalation).

    ranks: layer, rank.
    """
    e = described(edges)
    r = ranks.select("layer", "rank")
    both = e.join(r.select(F.col("layer").alias("source_layer"), F.col("rank").alias("sr")), "source_layer").join(r.select(F.col("layer").alias("target_layer"), F.col("rank").alias("tr")), "target_layer")
    return both.where("sr < tr").select("source_path", "target_path", "source_layer", "target_layer")


def top_violations(found: DataFrame, k: int) -> DataFrame:
    """The k most frequent violated pairs of owners for each rule."""
    c = found.groupBy("rule_id", "source_owner", "target_owner").agg(F.count("*").alias("n"))
    w = Window.partitionBy("rule_id").orderBy(F.desc("n"), "source_owner", "target_owner")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def redundant_domains(clusters: DataFrame, collisions: DataFrame) -> DataFrame:
    """clusters (cluster, path: files that serve one intent), collisions (concept, file) -> type,
    source, key, path: a row a file, so that a concept of any number of files is no long row."""
    kind = F.lit("redundant_domain").alias("type")
    a = clusters.where("trim(path) <> ''").select(kind, F.lit("duplicate_intent").alias("source"), F.col("cluster").cast("string").alias("key"), F.trim("path").alias("path"))
    b = collisions.where("trim(file) <> ''").select(kind, F.lit("abstraction_collision").alias("source"), F.col("concept").alias("key"), F.trim("file").alias("path"))
    return a.union(b).distinct()


#: Issues of behaviour that break the layers.
BEHAVIOUR_ISSUES = ("DIRECT_API_TO_PERSISTENCE_PATH", "DIRECT_STATE_CHANGE_BYPASSES_ORCHESTRATOR")


def behaviour_violations(direct: DataFrame, issues: DataFrame) -> DataFrame:
    """direct (one row: direct, how many calls go from the API to what is stored), issues (type,
    message) -> type, source, issue_type, message, count; each once."""
    kind = F.lit("layer_violation").alias("type")
    a = direct.where("direct > 0").select(kind, F.lit("causal_flow").alias("source"), F.lit("").alias("issue_type"), F.lit("calls from the API boundary straight to what is stored").alias("message"), F.col("direct").cast("long").alias("count"))
    code = F.upper(F.trim("type"))
    text = F.coalesce(F.nullif(F.trim("message"), F.lit("")), F.lit("behaviour bypasses orchestration"))
    b = issues.where(code.isin(*BEHAVIOUR_ISSUES)).groupBy(code.alias("issue_type"), text.alias("message")).agg(F.count("*").alias("count"))
    return a.union(b.select(kind, F.lit("causal_flow_issue").alias("source"), "issue_type", "message", "count"))
