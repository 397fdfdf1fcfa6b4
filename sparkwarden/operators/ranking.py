"""Top-k, stratified selection, issue collapse and root-cause ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import profiles as P
from ..functions.columns import is_excluded_seed, is_private, is_test, normalize_path


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """Adds rank and keeps the first k rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def severity_rank(severity: Column) -> Column:
    out = F.lit(99)
    for name, rank in P.SEVERITY_RANK.items():
        out = F.when(F.upper(severity) == name, rank).otherwise(out)
    return out


def severity_weight(severity: Column) -> Column:
    out = F.lit(0.2)
    for name, weight in P.SEVERITY_WEIGHT.items():
        out = F.when(F.upper(severity) == name, weight).otherwise(out)
    return out


def collapse_issues(issues: DataFrame, sample: int = P.SAMPLE_LIMIT["v2"]) -> DataFrame:
    """issues (idx, domain, type, severity, message, count, node) -> one row for each
    domain, type and normalised message: summed count, worst severity, first message,
    sample of distinct nodes in order.

    The sample is cut to its size in every task before it is shuffled.
    """
    key = F.lower(F.trim(F.regexp_replace("message", r"\s+", " ")))
    rows = issues.withColumn("key", key)
    group = ["domain", "type", "key"]
    totals = rows.groupBy(*group).agg(F.sum("count").alias("count"), F.min(severity_rank(F.col("severity"))).alias("worst"), F.min_by("message", "idx").alias("message"))
    nodes = rows.where("node is not null").groupBy(*group, "node").agg(F.min("idx").alias("idx"))
    picked = top_per_group(nodes, group, [F.col("idx"), F.col("node")], sample)
    lists = picked.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rank", "node"))).alias("s")).select(*group, F.transform("s", lambda x: x["node"]).alias("nodes"))
    severity = F.when(F.col("worst") == 0, "HIGH").when(F.col("worst") == 1, "MEDIUM").when(F.col("worst") == 2, "LOW").otherwise("INFO")
    return totals.join(lists, group, "left").select("domain", "type", "message", severity.alias("severity"), "count", F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"))


def root_causes(rows: DataFrame) -> DataFrame:
    """rows (type, impact, centrality, frequency, evidence) -> id, rank, severity, confidence.

    Ranked by severity, then type; one row an issue type, so the single window is small.
    """
    severity = F.round(0.5 * F.col("impact") + 0.3 * F.col("centrality") + 0.2 * F.col("frequency"), 3)
    r = rows.withColumn("severity", severity).withColumn("confidence", F.round(F.least(F.lit(1.0), 0.65 * F.col("severity") + 0.35 * F.col("evidence")), 3))
    r = r.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("severity"), "type")))
    return r.select(F.format_string("rc-%02d-%s", "rank", F.lower("type")).alias("id"), "rank", "type", "severity", "confidence")


def category_score(categories: Column) -> Column:
    """Sum of the entrypoint category weights."""
    weights = F.create_map(*[F.lit(x) for kv in P.CATEGORY_WEIGHTS.items() for x in kv])
    return F.aggregate(categories, F.lit(0.0), lambda a, c: a + F.coalesce(weights[c], F.lit(0.0)))


def path_bonus(path: Column) -> Column:
    """Points for the folder that an entrypoint is in."""
    clean = F.lower(normalize_path(path))
    return sum((F.when(clean.startswith(folder), x).otherwise(0.0) for folder, x in P.PATH_BONUS.items()), F.lit(0.0))


def stratified_top(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """First the best row of every group, then the best of the rest, to k rows in all."""
    w = Window.partitionBy(group).orderBy(*order)
    r = rows.withColumn("lead", F.row_number().over(w) == 1)
    return r.orderBy(F.desc("lead"), *order).limit(k).drop("lead")


def entrypoints(discovered: DataFrame) -> DataFrame:
    """discovered (path, category) over all sources -> path, categories, score, primary."""
    g = discovered.distinct().groupBy("path").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    weights = F.create_map(*[F.lit(x) for kv in P.CATEGORY_WEIGHTS.items() for x in kv])
    best = F.array_min(F.transform("categories", lambda c: F.struct((-F.coalesce(weights[c], F.lit(0.0))).alias("w"), c.alias("c"))))
    return g.select("path", "categories", (category_score(F.col("categories")) + path_bonus(F.col("path"))).alias("score"), best["c"].alias("primary"))


def seed_priority(rows: DataFrame) -> DataFrame:
    """Adds priority of seed scenarios: degrees, preferred names, unexecuted nodes, classes."""
    p = 0.5 * F.col("inbound") + 0.2 * F.col("outbound") + 2.0 * F.col("preferred").cast("int") + 1.0 * (F.col("hits") == 0).cast("int") + 0.25 * (F.col("kind") == "class").cast("int")
    return rows.withColumn("priority", F.round(p, 3))


def probe_priority(rows: DataFrame) -> DataFrame:
    """Adds priority of forced probes."""
    degree = F.col("inbound") + F.col("outbound")
    kind = F.when(F.col("kind") == "function", 10.0).when(F.col("kind") == "class", 4.0).otherwise(2.0)
    p = (
        F.when(F.col("hits") == 0, 120.0).otherwise(0.0) + 6.0 * degree + 25.0 / (1 + F.col("inbound")) + 12.0 * F.col("unexplored")
        + F.when(F.col("preferred"), 18.0).otherwise(0.0) + kind + F.when(degree <= 1, 10.0).otherwise(0.0)
    )
    return rows.withColumn("priority", F.round(p, 3))


def seeds(rows: DataFrame, k: int = 40) -> DataFrame:
    """rows (node_id, kind, path, name, inbound, outbound, hits, preferred) -> node_id, kind,
    path, name, priority: the k best functions and classes that are public, have a path and
    are not excluded (a top-k report)."""
    fit = F.lower(F.trim("kind")).isin("function", "class") & (normalize_path(F.col("path")) != "") & (F.trim("name") != "")
    fit = fit & ~is_excluded_seed(F.col("path")) & ~is_private(F.col("name"))
    ranked = seed_priority(rows.where(fit)).orderBy(F.desc("priority"), "node_id").limit(k)
    return ranked.select("node_id", "kind", "path", "name", "priority")


def path_probes(rows: DataFrame, k: int = 8) -> DataFrame:
    """rows (path, entrypoint, priority) -> path, entrypoint, priority, rank: each path's k best."""
    return top_per_group(rows.select("path", "entrypoint", "priority"), ["path"], [F.desc("priority"), F.col("entrypoint")], k)


def forced_probes(rows: DataFrame, k: int = 60) -> DataFrame:
    """rows (entrypoint, kind: function, class or module, inbound, outbound, hits, priority) ->
    entrypoint, kind, priority, rank: functions and classes that never ran and modules, all of
    few edges; functions first, then classes, then by priority; each entrypoint once; k in all
    (a top-k report)."""
    degree, idle = F.col("inbound") + F.col("outbound"), F.col("hits") == 0
    place = F.when(F.col("kind") == "function", 0).when(F.col("kind") == "class", 1).otherwise(2)
    wanted = ((F.col("kind") == "function") & idle & (degree <= 2)) | ((F.col("kind") == "module") & (degree <= 2)) | ((F.col("kind") == "class") & idle & (degree <= 1))
    rows = rows.where(wanted & (F.trim("entrypoint") != "")).withColumn("place", place)
    # The first of an entrypoint's rows in the whole order is its least one.
    once = rows.groupBy("entrypoint").agg(F.min(F.struct("place", (-F.col("priority")).alias("p"), "kind")).alias("m"))
    few = once.select("entrypoint", "m.kind", (-F.col("m.p")).alias("priority"), F.col("m.place").alias("place")).orderBy("place", F.desc("priority"), "entrypoint").limit(k)
    return few.select("entrypoint", "kind", "priority", F.row_number().over(Window.orderBy("place", F.desc("priority"), "entrypoint")).alias("rank"))


def focused_entrypoints(rows: DataFrame, limit: int) -> DataFrame:
    """rows (path, category, score) -> path, category, score: the stratified choice.

    First the best non-test path of every preferred category, in their order; then the rest
    by score, with at most two scripts in all and tests only while fewer than three are
    chosen; all rows if they are no more than the limit.  Once three are chosen no test
    follows, so the number of admissible rows before a row decides, and windows replace the
    greedy loop.  The table has one row an entrypoint.
    """
    limit = max(1, limit)
    by_score = [F.desc("score"), F.col("path")]
    place = F.lit(len(P.PREFERRED_CATEGORIES))
    for i, c in reversed(list(enumerate(P.PREFERRED_CATEGORIES))):
        place = F.when(F.col("category") == c, i).otherwise(place)
    whole = Window.partitionBy()
    r = rows.withColumn("place", place).withColumn("test", is_test(F.col("path"))).withColumn("all", F.count("*").over(whole))
    best = F.row_number().over(Window.partitionBy("category", "test").orderBy(*by_score))
    r = r.withColumn("lead", ~F.col("test") & (F.col("place") < len(P.PREFERRED_CATEGORIES)) & (best == 1))
    r = r.withColumn("turn", F.when(F.col("lead"), F.row_number().over(Window.partitionBy("lead").orderBy("place"))))
    r = r.withColumn("lead", F.coalesce(F.col("turn") <= limit, F.lit(False)))
    chosen = F.sum(F.col("lead").cast("int")).over(whole)
    scripts = F.sum((F.col("lead") & (F.col("category") == "script_file")).cast("int")).over(whole)
    r = r.withColumn("chosen", chosen).withColumn("scripts", scripts)
    script_turn = F.row_number().over(Window.partitionBy("lead", "category").orderBy(*by_score)) + F.col("scripts")
    r = r.withColumn("open", ~F.col("lead") & ((F.col("category") != "script_file") | (script_turn <= 2)))
    before = F.sum(F.col("open").cast("int")).over(Window.orderBy(*by_score).rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("before", F.col("chosen") + F.coalesce(before, F.lit(0)))
    # Of the admissible rows tests fall out from the third choice on.
    r = r.withColumn("open", F.col("open") & ((F.col("category") != "test_file") | (F.col("before") < 3)))
    taken = F.sum(F.col("open").cast("int")).over(Window.orderBy(*by_score).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = r.withColumn("taken", F.col("chosen") + taken)
    return r.where((F.col("all") <= limit) | F.col("lead") | (F.col("open") & (F.col("taken") <= limit))).select("path", "category", "score")
