"""Driver queries: every operator over the star-schema tables, with its DuckDB SQL.

The tables stand in for audit artifacts: orders, customers, suppliers, parts, nations and
regions are nodes, their keys are typed edges, and events are the runtime trace.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import profiles as P
from .functions import columns as C
from .operators import evidence, graph, pairs, ranking, resolve, rules, sequence, similarity, traces
from .plans import diagnose, integrity, legacy, report, verify
from .sources import scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """source, target, type."""
    o, li, c = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "customer")
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    e = lambda f, a, b, t: f.select(a.alias("source"), b.alias("target"), F.lit(t).alias("type"))
    return (
        e(o, _id("order", "o_orderkey"), _id("customer", "o_custkey"), "IMPORT")
        .union(e(c, _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "IMPORT"))
        .union(e(s, _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "IMPORT"))
        .union(e(n, _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "CONFIG"))
        .union(e(li, _id("order", "l_orderkey"), _id("part", "l_partkey"), "CALL"))
        .union(e(li, _id("order", "l_orderkey"), _id("supplier", "l_suppkey"), "CALL"))
    )


def nodes(spark: SparkSession, d: str) -> DataFrame:
    keys = {"order": ("orders", "o_orderkey"), "customer": ("customer", "c_custkey"), "supplier": ("supplier", "s_suppkey"), "part": ("part", "p_partkey"), "nation": ("nation", "n_nationkey"), "region": ("region", "r_regionkey")}
    return pairs.node_universe(*[table(spark, d, t).select(_id(k, c).alias("node_id")) for k, (t, c) in keys.items()])


def _clerks(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that no edge has: one a customer with an order."""
    return table(spark, d, "orders").select(_id("clerk", "o_custkey").alias("node_id")).distinct()


def trace(spark: SparkSession, d: str) -> DataFrame:
    """run_id, seq, role, node_id, event."""
    ev = table(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[F.col("event_type")]
    event = F.when(F.col("event_type") == "signup", "import").otherwise("call")
    return ev.select(F.col("user_id").alias("run_id"), seq.cast("long").alias("seq"), F.coalesce(role, F.lit("internal")).alias("role"), _id("customer", "user_id").alias("node_id"), event.alias("event"), "event_type", "event_id")


ROLES = {"view": "api", "signup": "validation", "click": "orchestration", "error": "side_effect", "purchase": "persistence"}

EDGES_SQL = """g AS (
  SELECT 'order:' || o_orderkey AS source, 'customer:' || o_custkey AS target, 'IMPORT' AS type FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'IMPORT' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IMPORT' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'CONFIG' FROM nation
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'CALL' FROM lineitem
  UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'CALL' FROM lineitem)"""
NODES_SQL = """n AS (
  SELECT 'order:' || o_orderkey AS node_id FROM orders UNION SELECT 'customer:' || c_custkey FROM customer
  UNION SELECT 'supplier:' || s_suppkey FROM supplier UNION SELECT 'part:' || p_partkey FROM part
  UNION SELECT 'nation:' || n_nationkey FROM nation UNION SELECT 'region:' || r_regionkey FROM region)"""
TRACE_SQL = """t AS (
  SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
    CASE event_type WHEN 'view' THEN 'api' WHEN 'signup' THEN 'validation' WHEN 'click' THEN 'orchestration'
      WHEN 'error' THEN 'side_effect' WHEN 'purchase' THEN 'persistence' ELSE 'internal' END AS role,
    'customer:' || user_id AS node_id, CASE WHEN event_type = 'signup' THEN 'import' ELSE 'call' END AS event, event_type, event_id
  FROM events)"""
REFS_SQL = """ends AS (
  SELECT target AS node_id, 1 AS i, 0 AS o, (type = 'CALL')::INT AS x FROM g UNION ALL SELECT source, 0, 1, 0 FROM g),
r AS (SELECT node_id, sum(i)::BIGINT AS inbound, sum(o)::BIGINT AS outbound, sum(x)::BIGINT AS executable, sum(i - x)::BIGINT AS non_executable FROM ends GROUP BY 1)"""
HEAT_SQL = f"""{EDGES_SQL}, {NODES_SQL}, {TRACE_SQL}, {REFS_SQL},
h AS (SELECT node_id, count(*) AS hits FROM t WHERE event = 'call' GROUP BY 1),
b AS (SELECT node_id, coalesce(hits, 0) AS hits, hits IS NOT NULL AS reached, coalesce(inbound, 0) AS inbound, coalesce(outbound, 0) AS outbound,
    coalesce(executable, 0) AS executable, coalesce(non_executable, 0) AS non_executable FROM n LEFT JOIN h USING (node_id) LEFT JOIN r USING (node_id)),
m AS (SELECT max(hits) AS mh, max(executable + non_executable + inbound) AS mr FROM b),
s AS (SELECT b.*, CASE WHEN hits <= 0 OR mh <= 0 THEN 0.0::DOUBLE ELSE ln(1.0::DOUBLE + hits) / ln(1.0::DOUBLE + mh) END AS rt,
    CASE WHEN executable + non_executable + inbound <= 0 OR mr <= 0 THEN 0.0::DOUBLE ELSE ln(1.0::DOUBLE + executable + non_executable + inbound) / ln(1.0::DOUBLE + mr) END AS rf FROM b, m),
c AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE * rt + 0.25::DOUBLE * reached::INT + 0.15::DOUBLE * rf)), 3) AS score FROM s),
k AS (SELECT *, CASE WHEN hits = 0 AND executable = 0 AND inbound = 0 THEN 'DEAD' WHEN score >= 0.8 THEN 'HOT' WHEN score >= 0.3 THEN 'WARM' WHEN score >= 0.1 THEN 'COLD' ELSE 'DEAD' END AS k1 FROM c),
heat AS (SELECT node_id, CASE WHEN k1 = 'HOT' AND hits <= 0 THEN 'WARM' WHEN k1 = 'DEAD' AND (hits > 0 OR executable > 0 OR reached OR inbound > 0) THEN 'COLD' ELSE k1 END AS classification, score,
    round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE * rt + 0.25::DOUBLE * (0.7::DOUBLE * reached::INT + CASE WHEN inbound > 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)
      + 0.25::DOUBLE * (CASE WHEN executable > 0 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN non_executable > 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END))), 3) AS confidence,
    hits, inbound, outbound, executable, non_executable FROM k)"""


def _heat(spark: SparkSession, d: str) -> DataFrame:
    return evidence.heat(nodes(spark, d), edges(spark, d), trace(spark, d))


@query(f"WITH {HEAT_SQL} SELECT * FROM heat")
def heat_nodes(spark, d):
    return _heat(spark, d)


@query(f"WITH {HEAT_SQL} SELECT count(*) FILTER (classification = 'HOT') AS hot, count(*) FILTER (classification = 'WARM') AS warm, count(*) FILTER (classification = 'COLD') AS cold, count(*) FILTER (classification = 'DEAD') AS dead, round((count(*) FILTER (classification = 'DEAD'))::DOUBLE / count(*), 6) AS dead_ratio FROM heat")
def heat_distribution(spark, d):
    return evidence.heat_distribution(_heat(spark, d))


@query(f"""WITH {HEAT_SQL} SELECT node_id, round(p, 3) AS probability, round(p * 0.25::DOUBLE, 3) AS confidence FROM (SELECT node_id,
  CASE WHEN hits = 0 THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN executable = 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN non_executable = 0 THEN 0.1::DOUBLE ELSE 0 END AS p
  FROM heat WHERE classification = 'DEAD' AND inbound = 0)""")
def dead_candidates(spark, d):
    return evidence.dead_candidates(_heat(spark, d), 0.25)


@query(f"WITH {HEAT_SQL}, x AS (SELECT count(*) FILTER (classification = 'HOT') AS hot, count(*) FILTER (classification = 'WARM') AS warm, count(*) FILTER (classification = 'COLD') AS cold, count(*) FILTER (classification = 'DEAD') AS dead, round((count(*) FILTER (classification = 'DEAD'))::DOUBLE / count(*), 6) AS dead_ratio FROM heat) SELECT *, dead_ratio <= 0.7 AS sane FROM x")
def heat_sanity(spark, d):
    return evidence.dead_ratio_gate(evidence.heat_distribution(_heat(spark, d)), True)


@query(f"""WITH RECURSIVE {HEAT_SQL}, links AS (SELECT DISTINCT source, target FROM g), w(node_id) AS (SELECT node_id FROM heat WHERE classification = 'HOT' UNION SELECT target FROM w JOIN links ON source = node_id),
near AS (SELECT count(*) FILTER (classification = 'WARM') AS warm, count(*) FILTER (classification = 'WARM' AND node_id IN (SELECT node_id FROM w)) AS near, count(*) FILTER (classification = 'DEAD' AND (hits > 0 OR inbound > 0)) AS conflicts FROM heat)
SELECT warm, near.near, CASE WHEN warm = 0 THEN 1.0::DOUBLE ELSE round(near.near::DOUBLE / warm, 6) END AS share, conflicts FROM near""")
def warm_near_hot(spark, d):
    return evidence.warm_near_hot(_heat(spark, d), edges(spark, d))


@query(f"WITH {HEAT_SQL}, w AS (SELECT count(*) FILTER (classification IN ('HOT', 'WARM')) AS warm FROM heat) SELECT node_id, classification, score, CASE WHEN warm = 0 THEN least(confidence, 0.45) ELSE confidence END AS confidence FROM heat, w")
def capped_confidence(spark, d):
    return evidence.cap_confidence(_heat(spark, d)).select("node_id", "classification", "score", "confidence")


@query(f"WITH {EDGES_SQL}, {REFS_SQL} SELECT * FROM r")
def reference_counts(spark, d):
    return evidence.reference_counts(edges(spark, d))


@query(f"WITH {EDGES_SQL}, x AS (SELECT node_id, count(*) AS degree FROM (SELECT source AS node_id FROM g UNION ALL SELECT target FROM g) GROUP BY 1) SELECT node_id, degree, round(degree::DOUBLE / (SELECT max(degree) FROM x), 6) AS centrality FROM x")
def degree_centrality(spark, d):
    return evidence.degree_centrality(edges(spark, d))


@query(f"""WITH {EDGES_SQL}, x AS (SELECT node_id, count(*) AS degree FROM (SELECT source AS node_id FROM g UNION ALL SELECT target FROM g) GROUP BY 1),
y AS (SELECT degree, row_number() OVER (ORDER BY degree) AS k, count(*) OVER () AS n FROM x), z AS (SELECT greatest(8, 2 * degree)::BIGINT AS threshold FROM y WHERE k = n // 2 + 1)
SELECT node_id, degree, threshold FROM x, z WHERE degree > threshold""")
def overcoupled_nodes(spark, d):
    return evidence.overcoupled(edges(spark, d))


@query(f"WITH {EDGES_SQL}, {NODES_SQL}, m AS (SELECT * FROM n UNION SELECT 'clerk:' || o_custkey FROM orders) SELECT node_id FROM m WHERE node_id NOT IN (SELECT source FROM g UNION SELECT target FROM g)")
def orphan_nodes(spark, d):
    return evidence.orphans(pairs.node_universe(nodes(spark, d), _clerks(spark, d)), edges(spark, d))


@query(f"WITH {NODES_SQL}, {TRACE_SQL} SELECT node_id FROM n UNION SELECT node_id FROM t")
def node_universe(spark, d):
    return pairs.node_universe(nodes(spark, d), trace(spark, d))


@query(f"""WITH {EDGES_SQL}, {NODES_SQL}, e AS (SELECT DISTINCT source, target, type FROM g UNION SELECT 'order:' || o_orderkey, 'clerk:' || (o_orderkey % 7), CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'DI' END FROM orders)
SELECT source, target, type, CASE WHEN type = '' THEN 'malformed' WHEN type NOT IN ('CONFIG', 'DI', 'DYNAMIC', 'IMPORT') THEN 'invalid_type'
  WHEN target NOT IN (SELECT node_id FROM n) OR source NOT IN (SELECT node_id FROM n) THEN 'unresolved' ELSE 'valid' END AS status, false AS cross_namespace FROM e""")
def edge_validation(spark, d):
    extra = table(spark, d, "orders").select(_id("order", "o_orderkey").alias("source"), F.concat(F.lit("clerk:"), (F.col("o_orderkey") % 7).cast("string")).alias("target"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("DI").alias("type"))
    return pairs.edge_status(nodes(spark, d), edges(spark, d).union(extra).withColumn("confidence", F.lit(1.0)))


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, d, "lineitem")
    p = lambda flag: li.where(F.col("l_returnflag").isin(*flag)).select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    return p(["A", "N"]), p(["N", "R"])


HALVES_SQL = """a AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem WHERE l_returnflag IN ('A', 'N')),
b AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem WHERE l_returnflag IN ('N', 'R')),
c AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_both, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_either)"""


@query(f"WITH {HALVES_SQL} SELECT n_a, n_b, n_both, n_either, round((n_either - n_both)::DOUBLE / n_either * (0.7::DOUBLE + 0.3::DOUBLE * (least(n_a, n_b)::DOUBLE / n_either)), 3) AS v2, round((n_either - n_both)::DOUBLE / n_either * greatest(0.0::DOUBLE, least(1.0::DOUBLE, n_a::DOUBLE / greatest(1, n_b))), 3) AS v1, round(n_both::DOUBLE / least(n_a, n_b), 3) AS overlap FROM c")
def pair_divergence(spark, d):
    a, b = _halves(spark, d)
    return pairs.pair_counts(a, b, ["source", "target"]).select("*", pairs.divergence("v2").alias("v2"), pairs.divergence("v1").alias("v1"), pairs.overlap().alias("overlap"))


@query(f"WITH {HALVES_SQL} SELECT n_a AS static_edges, n_b AS runtime_edges, n_both AS shared_edges, n_a - n_both AS static_only, n_b - n_both AS runtime_only, round(n_both::DOUBLE / n_a, 6) AS overlap_ratio FROM c")
def call_reconciliation(spark, d):
    a, b = _halves(spark, d)
    return pairs.reconcile(a, b)


@query("""WITH e AS (SELECT 'customer:' || o_custkey AS source, 'order:' || o_orderkey AS target, o_orderpriority AS origin FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'ast' FROM customer)
SELECT DISTINCT source, target, CASE WHEN origin = 'ast' THEN 'AST' ELSE 'UNKNOWN' END AS origin FROM e""")
def resolver_edges(spark, d):
    o = table(spark, d, "orders").select(_id("customer", "o_custkey").alias("source"), _id("order", "o_orderkey").alias("target"), F.col("o_orderpriority").alias("origin"))
    c = table(spark, d, "customer").select(_id("customer", "c_custkey").alias("source"), _id("nation", "c_nationkey").alias("target"), F.lit("ast").alias("origin"))
    return pairs.resolver_edges(o, c)


@query(f"""WITH RECURSIVE {EDGES_SQL}, links AS (SELECT DISTINCT source, target FROM g),
w(node_id, depth) AS (SELECT 'region:' || r_regionkey, 0 FROM region UNION SELECT source, depth + 1 FROM w JOIN links ON target = node_id)
SELECT node_id, min(depth) AS depth FROM w GROUP BY 1""")
def reachability_depth(spark, d):
    back = edges(spark, d).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return graph.reach(back, table(spark, d, "region").select(_id("region", "r_regionkey").alias("node_id")))


def _part_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every part points to the part of half its key; every 64th also to one that leads back to it."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    half = p.where("k > 1").select(F.col("k").alias("source"), F.floor(F.col("k") / 2).cast("long").alias("target"))
    back = p.where("k % 64 = 1 and k > 1").select(F.floor(F.col("k") / 4).cast("long").alias("source"), F.col("k").alias("target")).where("source > 0")
    return p.select(F.col("k").alias("node_id")), half.union(back)


PART_SQL = """p AS (SELECT p_partkey AS k FROM part), e AS (SELECT k AS source, k // 2 AS target FROM p WHERE k > 1 UNION SELECT k // 4, k FROM p WHERE k % 64 = 1 AND k > 1 AND k // 4 > 0),
reach(a, b) AS (SELECT source, target FROM e UNION SELECT a, target FROM reach JOIN e ON b = source)"""


@query(f"WITH RECURSIVE {PART_SQL}, loops AS (SELECT a FROM reach WHERE a = b) SELECT a AS node_id FROM loops UNION SELECT b FROM reach WHERE a IN (SELECT a FROM loops)")
def cycle_peel(spark, d):
    n, e = _part_graph(spark, d)
    return graph.peel(n, e)


@query(f"WITH RECURSIVE {PART_SQL}, both_ways AS (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) SELECT k AS node_id, least(k, coalesce(min(b), k)) AS component FROM p LEFT JOIN both_ways ON k = a GROUP BY k")
def scc_groups(spark, d):
    n, e = _part_graph(spark, d)
    return graph.strong_components(n, e)


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS k FROM part), e AS (SELECT k AS source, k // 2 AS target FROM p WHERE k > 1 UNION SELECT k // 4, k FROM p WHERE k % 64 = 1 AND k > 1 AND k // 4 > 0),
w(path, last) AS (SELECT [source, target], target FROM e WHERE source < target UNION ALL SELECT list_append(path, target), target FROM w JOIN e ON last = source WHERE len(path) < 8 AND target > path[1] AND NOT list_contains(path, target))
SELECT array_to_string(path, ',') AS cycle, len(path)::INT AS size FROM w JOIN e ON last = source AND target = path[1]""")
def graph_cycles(spark, d):
    return graph.cycles(_part_graph(spark, d)[1]).select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ",").alias("cycle"), "size")


ISLAND_SQL = """l AS (SELECT DISTINCT s_nationkey AS x, s_suppkey AS k FROM supplier), ls AS (SELECT s_suppkey AS k, s_suppkey // 4 AS c FROM supplier)"""


@query("SELECT s_suppkey AS node_id, min(s_suppkey) OVER (PARTITION BY s_suppkey // 4) AS component FROM supplier")
def weak_components(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"))
    chain = s.where("node_id % 4 > 0").select(F.col("node_id").alias("source"), (F.col("node_id") - 1).alias("target"))
    return graph.weak_components(s, chain)


@query("""WITH c AS (SELECT s_suppkey AS k, s_suppkey // 4 AS g, s_acctbal < 0 AS i, s_suppkey % 12 = 1 AS c FROM supplier)
SELECT min(k) AS component, count(*) AS size, CASE WHEN bool_and(i) THEN 'isolated_module' WHEN bool_or(c) THEN 'cyclic_island' ELSE 'orphan_subgraph' END AS kind FROM c GROUP BY g""")
def islands(spark, d):
    s = table(spark, d, "supplier")
    flags = lambda c: s.where(c).select(F.col("s_suppkey").alias("node_id"))
    return graph.islands(weak_components(spark, d), flags("s_acctbal < 0"), flags("s_suppkey % 12 = 1"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, {NODES_SQL}, links AS (SELECT DISTINCT source, target FROM g),
w(node_id, depth) AS (SELECT node_id, 0 FROM n UNION SELECT target, depth + 1 FROM w JOIN links ON source = node_id) SELECT node_id, max(depth) AS depth FROM w GROUP BY 1""")
def longest_path_depth(spark, d):
    return graph.longest_path(nodes(spark, d), edges(spark, d))


def _path_edges(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    """Paths made of part types, as edges between them: every lineitem's part to the next key's part."""
    p = table(spark, d, "part")
    names = ["src/api/routes", "src/domain/core", "src/infra/adapters", "src/orchestration", "apps/web/services", "shared/utils", "lib/db", "src/contracts", "tests"]
    path = lambda k: F.concat(F.element_at(F.array(*[F.lit(x) for x in names]), (k % len(names) + 1).cast("int")), F.lit("/"), F.element_at(F.array(*[F.lit(x) for x in ("service.py", "adapter.py", "store.py", "main.py")]), (F.floor(k / 9) % 4 + 1).cast("int")))
    k = F.col("p_partkey")
    return p.select(path(k).alias("source_path"), path(k * 7 + 3).alias("target_path"), *more)


_NAMES = "['src/api/routes', 'src/domain/core', 'src/infra/adapters', 'src/orchestration', 'apps/web/services', 'shared/utils', 'lib/db', 'src/contracts', 'tests']"


def _path_sql(k: str) -> str:
    return f"({_NAMES})[({k}) % 9 + 1] || '/' || (['service.py', 'adapter.py', 'store.py', 'main.py'])[(({k}) // 9) % 4 + 1]"


def _layer_sql(p: str) -> str:
    seg = f"string_split(lower({p}), '/')"
    return "CASE " + " ".join(f"WHEN list_has_any({seg}, {list(v)}) THEN '{k}'" for k, v in P.LAYER_SEGMENTS.items()) + " ELSE 'unknown' END"


def _owner_sql(p: str) -> str:
    seg = f"string_split(lower({p}), '/')"
    return f"array_to_string(list_slice({seg}, 1, CASE WHEN {seg}[1] IN ('apps', 'src', 'tests') THEN 2 ELSE 1 END), '/')"


RULES_SQL = f"""e AS (SELECT {_path_sql('p_partkey')} AS source_path, {_path_sql('p_partkey * 7 + 3')} AS target_path FROM part),
f AS (SELECT *, {_layer_sql('source_path')} AS sl, {_layer_sql('target_path')} AS tl, {_owner_sql('source_path')} AS so, {_owner_sql('target_path')} AS tw,
  string_split(lower(source_path), '/') AS ss, string_split(lower(target_path), '/') AS ts FROM e),
v AS (
  SELECT 'LAYER_DIRECTION_VIOLATION' AS rule_id, 'HIGH' AS severity, * FROM f WHERE tl <> 'unknown' AND ({' OR '.join(f"(sl = '{k}' AND tl NOT IN ({', '.join(repr(x) for x in a)}))" for k, a in P.ALLOWED_LAYERS.items() if k != 'unknown')})
  UNION ALL SELECT 'SERVICE_IMPORTS_ADAPTER', 'MEDIUM', * FROM f WHERE (list_contains(ss, 'services') OR ss[-1] LIKE '%service.py') AND (list_has_any(ts, ['adapter', 'adapters']) OR ts[-1] LIKE '%adapter.py')
  UNION ALL SELECT 'DIRECT_STATE_CHANGE_BYPASSES_ORCHESTRATOR', 'MEDIUM', * FROM f WHERE sl = 'api' AND (list_has_any(ts, {list(P.PERSISTENCE_SEGMENTS)}) OR {' OR '.join(f"ts[-1] LIKE '%{x}'" for x in P.PERSISTENCE_SUFFIXES)}) AND NOT list_contains(ss, 'orchestrator')
  UNION ALL SELECT 'OWNERSHIP_BOUNDARY_CROSSING', 'LOW', * FROM f WHERE so <> '' AND tw <> '' AND so <> tw AND NOT list_has_any(ss, {list(P.CONTRACT_SEGMENTS)}) AND NOT list_has_any(ts, {list(P.CONTRACT_SEGMENTS)}))"""


@query(f"WITH {RULES_SQL} SELECT source_path, target_path, rule_id, count(*) AS n FROM v GROUP BY ALL")
def layer_rules(spark, d):
    return rules.violations(_path_edges(spark, d)).groupBy("source_path", "target_path", "rule_id").agg(F.count("*").alias("n"))


@query(f"WITH {RULES_SQL} SELECT rule_id, severity, count(*) AS n FROM v GROUP BY ALL")
def rule_counts(spark, d):
    return rules.rule_counts(_path_edges(spark, d))


@query(f"WITH {RULES_SQL} SELECT DISTINCT rule_id, source_path, target_path FROM v ORDER BY ALL LIMIT 250")
def violation_sample(spark, d):
    return rules.violation_sample(rules.violations(_path_edges(spark, d)))


@query(f"""WITH {RULES_SQL}, c AS (SELECT rule_id, so AS source_owner, tw AS target_owner, count(*) AS n FROM v GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY n DESC, source_owner, target_owner)::INT AS rank FROM c QUALIFY rank <= 3""")
def owner_crossings(spark, d):
    return rules.top_violations(rules.violations(_path_edges(spark, d)), 3)


@query(f"""WITH {RULES_SQL}, a AS (SELECT count(*) AS edges, count(*) FILTER (sl <> 'unknown' AND tl <> 'unknown') AS layered_edges FROM f), b AS (SELECT count(*) AS violations, count(*) FILTER (rule_id = 'OWNERSHIP_BOUNDARY_CROSSING') AS crossings FROM v)
SELECT edges, layered_edges, violations, crossings, round(violations::DOUBLE / layered_edges, 3) AS violation_ratio, round(layered_edges::DOUBLE / edges, 3) AS coverage,
  round(1 - least(1.0::DOUBLE, 0.65::DOUBLE * (violations::DOUBLE / layered_edges) + 0.2::DOUBLE * (1 - layered_edges::DOUBLE / edges) + 0.15::DOUBLE * (crossings::DOUBLE / edges)), 3) AS score FROM a, b""")
def architecture_score(spark, d):
    return rules.architecture_score(_path_edges(spark, d))


_STOP = ", ".join(repr(w) for w in P.STOPWORDS)


def _tokens_sql(source: str, key: str, text: str) -> str:
    """Rows (key, i, token) of a text column, in order."""
    return f"(SELECT {key}, i, lower(parts[i]) AS token FROM (SELECT {key}, regexp_split_to_array(regexp_replace({text}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+') AS parts FROM {source}), unnest(generate_series(1, len(parts))) AS u(i) WHERE length(parts[i]) >= 3 AND lower(parts[i]) NOT IN ({_STOP}))"


@query(f"SELECT p.p_partkey, coalesce(tokens, '') AS tokens FROM part p LEFT JOIN (SELECT p_partkey, string_agg(token, ' ' ORDER BY i) AS tokens FROM {_tokens_sql('part', 'p_partkey', 'p_name || p_type')} GROUP BY 1) USING (p_partkey)")
def tokenize_ordered(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(C.tokens(F.concat("p_name", "p_type")), " ").alias("tokens"))


@query(f"SELECT p.page_id, coalesce(tokens, '') AS tokens FROM pages p LEFT JOIN (SELECT page_id, string_agg(DISTINCT token, ' ' ORDER BY token) AS tokens FROM {_tokens_sql('pages', 'page_id', 'url')} GROUP BY 1) USING (page_id)")
def tokenize_set(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(C.token_set(F.col("url")), " ").alias("tokens"))


def _document_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), C.token_set(F.col("text")).alias("tokens"))


SETS_SQL = f"""k AS MATERIALIZED (SELECT DISTINCT doc_id AS id, token FROM {_tokens_sql('documents', 'doc_id', 'text')}),
z AS (SELECT id, count(*) AS n, string_agg(token, ' ' ORDER BY token) AS s FROM k GROUP BY 1 HAVING count(*) >= 4),
cls AS MATERIALIZED (SELECT min(id) AS id, any_value(n) AS n FROM z GROUP BY s),
kk AS MATERIALIZED (SELECT id, token FROM k JOIN cls USING (id)),
sh AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM kk x JOIN kk y ON x.token = y.token AND x.id < y.id GROUP BY ALL),
pr AS (SELECT a, b, shared, shared::DOUBLE / (ca.n + cb.n - shared) AS jaccard FROM sh JOIN cls ca ON ca.id = a JOIN cls cb ON cb.id = b WHERE shared >= 4 AND shared::DOUBLE / (ca.n + cb.n - shared) >= 0.45)"""


@query(f"WITH {SETS_SQL} SELECT a, b, shared::INT AS shared, round(jaccard, 6) AS jaccard FROM pr")
def jaccard_pairs(spark, d):
    return similarity.similar_pairs(_document_tokens(spark, d)).select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


@query(f"""WITH {SETS_SQL}, m AS (SELECT id, min(id) OVER (PARTITION BY s) AS rep, count(*) OVER (PARTITION BY s) AS same FROM z),
l AS (SELECT rep, count(*) AS links FROM (SELECT a AS rep FROM pr UNION ALL SELECT b FROM pr) GROUP BY 1) SELECT id, rep, same, coalesce(links, 0) AS links FROM m LEFT JOIN l USING (rep)""")
def jaccard_members(spark, d):
    return similarity.linked_members(_document_tokens(spark, d))


@query(f"""WITH RECURSIVE {SETS_SQL}, m AS (SELECT id, min(id) OVER (PARTITION BY s) AS rep FROM z), l AS (SELECT a AS x, b AS y FROM pr UNION ALL SELECT b, a FROM pr),
w(x, y) AS (SELECT x, y FROM l UNION SELECT w.x, l.y FROM w JOIN l ON w.y = l.x), c AS (SELECT x AS rep, least(x, min(y)) AS cluster FROM w GROUP BY 1)
SELECT doc_id AS id, coalesce(c.cluster, m.rep, doc_id) AS cluster FROM documents LEFT JOIN m ON m.id = doc_id LEFT JOIN c ON c.rep = m.rep""")
def clusters(spark, d):
    return similarity.clusters(_document_tokens(spark, d))


@query(f"""WITH m AS (SELECT p_brand AS cluster, token AS term, count(*) AS n FROM (SELECT DISTINCT p_partkey, p_brand, token FROM {_tokens_sql('part', 'p_partkey, p_brand', 'p_name || p_type')}) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term)::INT AS rank FROM m QUALIFY rank <= 12""")
def cluster_terms(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("cluster"), C.token_set(F.concat("p_name", "p_type")).alias("tokens"))
    return similarity.cluster_terms(p)


KINDS = ("adapter", "manager", "service", "router")

#: Symbol names of parts: the kind of abstraction at the end but one, twice, or amid other words.
SYMBOLS_SQL = """sy AS (SELECT p_partkey, p_size AS file, CASE p_partkey % 3 WHEN 0 THEN w1 || w2 || kind || 'Factory' WHEN 1 THEN kind || w1 || kind || w2
  ELSE lower(w1 || '_' || kind || '_' || w2 || '_' || w1 || '_' || p_type || '_extra') END AS name
  FROM (SELECT *, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS w1, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS w2,
    (['Adapter', 'Manager', 'Service', 'Router'])[p_partkey // 3 % 4 + 1] AS kind FROM part))"""


@query(f"""WITH {SYMBOLS_SQL}, tk AS {_tokens_sql('sy', 'p_partkey, file', 'name')},
kd AS (SELECT p_partkey, arg_max(token, i) AS kind FROM tk WHERE token IN ({', '.join(repr(x) for x in P.ABSTRACTION_SUFFIXES)}) GROUP BY 1),
c AS (SELECT p_partkey, file, kind, token, min(i) AS i FROM tk JOIN kd USING (p_partkey) WHERE token <> kind GROUP BY ALL),
k AS (SELECT p_partkey, file, kind, string_agg(token, '_' ORDER BY i) AS concept FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS r FROM c) WHERE r <= 3 GROUP BY ALL)
SELECT concept, count(DISTINCT kind) AS kinds, count(DISTINCT file) AS files FROM k GROUP BY 1 HAVING count(DISTINCT kind) >= 3 AND count(DISTINCT file) >= 2""")
def collisions(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    word = lambda i: F.initcap(F.split_part("p_name", F.lit(" "), F.lit(i)))
    kind = F.element_at(F.array(*[F.lit(x.capitalize()) for x in KINDS]), (F.floor(k / 3) % 4 + 1).cast("int"))
    mixed = F.lower(F.concat_ws("_", word(1), kind, word(2), word(1), "p_type", F.lit("extra")))
    name = F.when(k % 3 == 0, F.concat(word(1), word(2), kind, F.lit("Factory"))).when(k % 3 == 1, F.concat(kind, word(1), kind, word(2))).otherwise(mixed)
    return similarity.collisions(p.select(name.alias("name"), F.col("p_size").alias("file")))


@query("""WITH s AS (SELECT p_partkey AS id, p_size AS a, p_size + (p_partkey % 5 = 0)::INT AS b, p_size % 7 AS c, p_size % 7 + (p_partkey % 4 = 0)::INT AS d, p_partkey % 3 AS e, p_partkey % 2 AS f, p_brand AS g FROM part)
SELECT id, '$[''a.b'']' AS path, a::VARCHAR AS "left", b::VARCHAR AS "right" FROM s WHERE a <> b
UNION ALL SELECT id, '$[''a''][''b'']', c::VARCHAR, d::VARCHAR FROM s WHERE c <> d
UNION ALL SELECT id, '$[''it\\''s''][1][''k'']', e::VARCHAR, f::VARCHAR FROM s WHERE e <> f
UNION ALL SELECT id, '$[''it\\''s''][2]', NULL, '"' || g || '"' FROM s WHERE f = 1""".replace("\\\\", "\\"))
def json_differences(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    bump = lambda n: F.when(k % n == 0, 1).otherwise(0)

    def document(ab: Column, b: Column, tail: Column) -> DataFrame:
        values = F.format_string("{\"a.b\": %d, \"a\": {\"b\": %d}, \"it's\": [null, %s], \"at\": %d}", ab, b, tail, F.floor(F.rand(1) * 1000).cast("int"))
        return diagnose.json_leaves(p.select(k.alias("id"), values.alias("json")))

    item = lambda n: F.format_string('{"k": %d}', k % n)
    more = F.when(k % 2 == 1, F.concat(item(2), F.lit(', "'), F.col("p_brand"), F.lit('"'))).otherwise(item(2))
    left = document(F.col("p_size").cast("int"), (F.col("p_size") % 7).cast("int"), item(3))
    return diagnose.differences(left, document((F.col("p_size") + bump(5)).cast("int"), (F.col("p_size") % 7 + bump(4)).cast("int"), more), ("at",))


COMPRESSED_SQL = f"""{TRACE_SQL}, c AS (SELECT * FROM (SELECT *, lag(role) OVER (PARTITION BY run_id ORDER BY seq) AS before FROM t) WHERE before IS NULL OR before <> role),
w AS (SELECT run_id, count(*) AS steps, string_agg(role, ' -> ' ORDER BY seq) AS signature FROM c GROUP BY 1)"""


_SAID = "signature"
for _k, _v in sequence.ROLE_NAMES.items():
    if _k != _v:
        _SAID = f"replace({_SAID}, '{_k}', '{_v}')"


@query(f"WITH {COMPRESSED_SQL} SELECT *, {_SAID} AS narrative FROM w")
def workflow_sequences(spark, d):
    return sequence.workflows(trace(spark, d))


@query(f"WITH {COMPRESSED_SQL}, x AS (SELECT role AS from_role, lead(role) OVER (PARTITION BY run_id ORDER BY seq) AS to_role FROM c) SELECT from_role, to_role, count(*) AS n FROM x WHERE to_role IS NOT NULL GROUP BY ALL")
def role_transitions(spark, d):
    return sequence.transitions(trace(spark, d))


@query(f"WITH {COMPRESSED_SQL}, x AS (SELECT signature, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, signature LIMIT 12) SELECT *, row_number() OVER (ORDER BY n DESC, signature)::INT AS rank FROM x")
def workflow_templates(spark, d):
    return sequence.templates(trace(spark, d))


@query("""WITH c AS (SELECT conv_id, turn, role FROM conversations), x AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM c)
SELECT conv_id AS run_id, count(*) AS steps, string_agg(role, ' -> ' ORDER BY turn, role) AS signature, string_agg(role, ' -> ' ORDER BY turn, role) AS narrative FROM x WHERE before IS NULL OR before <> role GROUP BY 1""")
def conversation_flows(spark, d):
    return sequence.workflows(table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), "role"))


@query("""WITH f AS (SELECT user_id AS run_id, event_type AS node_id, min(seq) AS s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) GROUP BY ALL)
SELECT run_id, node_id, row_number() OVER (PARTITION BY run_id ORDER BY s, node_id)::INT AS rank FROM f QUALIFY rank <= 3""")
def first_k_distinct(spark, d):
    return sequence.first_distinct(trace(spark, d).withColumn("node_id", F.col("event_type")), 3)


@query(f"""WITH {COMPRESSED_SQL}, x AS (SELECT role, lead(role) OVER (PARTITION BY run_id ORDER BY seq) AS nxt FROM c), q AS (SELECT count(DISTINCT run_id) AS runs, count(DISTINCT role) FILTER (role <> 'internal')::DOUBLE / 6 AS cov,
  bool_or(role IN ('validation', 'orchestration', 'domain_decision')) AS dd, bool_or(role = 'api') AS api, bool_or(role IN ('side_effect', 'persistence')) AS se FROM t), y AS (SELECT count(*) AS direct FROM x WHERE role = 'api' AND nxt = 'persistence')
SELECT runs, round(cov, 3) AS coverage, direct, CASE WHEN runs = 0 THEN 1.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, 1 - (0.45::DOUBLE * (1 - cov) + CASE WHEN NOT dd THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN NOT se THEN 0.2::DOUBLE ELSE 0 END + least(0.15::DOUBLE, 0.02::DOUBLE * direct))), 3) END AS score,
  concat_ws(',', CASE WHEN NOT api THEN 'MISSING_API_BOUNDARY' END, CASE WHEN NOT dd THEN 'MISSING_DOMAIN_DECISION_STAGE' END, CASE WHEN NOT se THEN 'MISSING_SIDE_EFFECT_OR_PERSISTENCE_STAGE' END, CASE WHEN direct > 0 THEN 'DIRECT_API_TO_PERSISTENCE_PATH' END) AS issues FROM q, y""")
def causal_score(spark, d):
    return sequence.causal_score(trace(spark, d)).withColumn("issues", F.array_join("issues", ","))


@query("""WITH RECURSIVE t AS (SELECT user_id AS run_id, row_number() OVER w AS seq, event_type AS node_id, CASE WHEN event_id % 4 > 0 THEN lag(event_type, 1 + event_id % 3) OVER w END AS caller FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT x.run_id, x.seq, any_value(x.node_id) AS node_id, any_value(x.caller) AS caller, max(y.seq) AS parent FROM t x LEFT JOIN t y ON x.run_id = y.run_id AND y.node_id = x.caller AND y.seq < x.seq GROUP BY x.run_id, x.seq),
d AS (SELECT run_id, seq, node_id, CASE WHEN caller IS NULL THEN 1 ELSE 2 END AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.run_id, p.seq, p.node_id, d.depth + 1 FROM p JOIN d ON p.run_id = d.run_id AND p.parent = d.seq)
SELECT run_id::VARCHAR AS run_id, seq, node_id, depth::BIGINT AS depth FROM d""")
def depth_fold(spark, d):
    w, k = Window.partitionBy("user_id").orderBy("ts", "event_id"), F.col("event_id")
    before = F.when(k % 3 == 0, F.lag("event_type", 1).over(w)).when(k % 3 == 1, F.lag("event_type", 2).over(w)).otherwise(F.lag("event_type", 3).over(w))
    t = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.row_number().over(w).cast("long").alias("seq"), F.col("event_type").alias("node_id"), F.when(k % 4 > 0, before).alias("caller"))
    return sequence.call_depths(t)


@query("""WITH RECURSIVE t AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS node, CASE WHEN event_id % 3 = 0 THEN 'return' ELSE 'call' END AS e FROM events),
s AS (SELECT run_id, seq, CASE WHEN e = 'call' THEN [node] ELSE [] END AS stack, node, e FROM t WHERE seq = 1
  UNION ALL SELECT t.run_id, t.seq, CASE WHEN t.e = 'call' THEN list_append(stack, t.node) WHEN len(stack) > 0 AND stack[-1] = t.node THEN stack[:-2] ELSE stack END, t.node, t.e FROM s JOIN t ON t.run_id = s.run_id AND t.seq = s.seq + 1)
SELECT run_id, seq, node AS node_id, len(stack)::BIGINT AS depth FROM s WHERE e = 'call'""")
def call_stack(spark, d):
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    event = F.when(F.col("event_id") % 3 == 0, "return").otherwise("call")
    return sequence.call_stacks(table(spark, d, "events").select(F.col("user_id").alias("run_id"), seq.cast("long").alias("seq"), event.alias("event"), F.col("event_type").alias("node_id")))


@query("""WITH q AS (SELECT page_id AS id, replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?].*$', ''), '/', ' ') AS name FROM pages)
SELECT id, name, split_part(name, ' ', 1) || CASE WHEN split_part(name, ' ', 2) <> '' THEN ' ' || split_part(name, ' ', 2) ELSE '' END AS path FROM q""")
def prefix_join(spark, d):
    p = table(spark, d, "pages")
    name = F.translate(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?].*$", ""), "/", " ")
    names = p.select(F.col("page_id").alias("id"), name.alias("name"))
    parts = F.split("name", " ")
    # Every host and every host with its first folder is a module.
    modules = F.array_compact(F.array(F.get(parts, F.lit(0)), F.when(F.get(parts, F.lit(1)) != "", F.array_join(F.slice(parts, 1, 2), " "))))
    index = names.select(F.explode(modules).alias("module")).distinct().withColumn("path", F.col("module"))
    return resolve.longest_prefix(names, index, " ")


_PICK = "CASE WHEN count(*) = 1 THEN min(node_id) WHEN count(*) FILTER (kind = 'function') = 1 THEN min(node_id) FILTER (kind = 'function') WHEN count(*) FILTER (kind = 'class') = 1 THEN min(node_id) FILTER (kind = 'class') END"
IMPORTS_SQL = """im AS (SELECT p_brand AS file, 'root.m' || (p_partkey % 6) || '.f' || (p_partkey % 60) AS module, CASE WHEN p_partkey % 11 = 0 THEN 'm' || (p_partkey % 3) ELSE '' END AS alias, left(p_brand, length(p_brand) - 1) || (p_partkey % 5 + 1) AS path FROM part),
ctx AS (SELECT DISTINCT file, key, scope, path FROM (
  SELECT file, path, split_part(module, '.', 1) AS key, 'prefix' AS scope FROM im UNION ALL SELECT file, path, split_part(module, '.', 2), 'prefix' FROM im UNION ALL SELECT file, path, split_part(module, '.', 3), 'prefix' FROM im
  UNION ALL SELECT file, path, alias, 'prefix' FROM im WHERE alias <> '' UNION ALL SELECT file, path, split_part(module, '.', 3), 'symbol' FROM im UNION ALL SELECT file, path, alias, 'symbol' FROM im WHERE alias <> ''))"""


def _imports(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    module = F.concat(F.lit("root.m"), (k % 6).cast("string"), F.lit(".f"), (k % 60).cast("string"))
    alias = F.when(k % 11 == 0, F.concat(F.lit("m"), (k % 3).cast("string"))).otherwise("")
    return p.select(F.col("p_brand").alias("file"), module.alias("module"), alias.alias("alias"), F.concat(F.expr("substring(p_brand, 1, length(p_brand) - 1)"), (k % 5 + 1).cast("string")).alias("path"))


@query(f"WITH {IMPORTS_SQL} SELECT * FROM ctx")
def import_context(spark, d):
    return resolve.import_context(_imports(spark, d))


@query(f"""WITH {IMPORTS_SQL}, s AS (SELECT 'f' || (p_size * 7 + p_partkey % 7) AS name, CASE WHEN p_partkey % 5 = 0 THEN 'class' ELSE 'function' END AS kind, p_brand AS file, p_partkey AS node_id FROM part),
c AS (SELECT p_partkey AS call_id, p_brand AS at, 'f' || ((p_partkey * 7) % 400) AS name, CASE WHEN p_partkey % 4 > 0 THEN 'm' || (p_partkey % 4) END AS prefix FROM part),
pick AS (SELECT call_id, 0 AS o, {_PICK} AS x FROM c JOIN s USING (name) GROUP BY 1
 UNION ALL SELECT call_id, 1, {_PICK} FROM c JOIN s ON c.name = s.name AND s.file = c.at GROUP BY 1
 UNION ALL SELECT call_id, 2, {_PICK} FROM c JOIN s USING (name) JOIN ctx ON ctx.file = c.at AND ctx.scope = 'prefix' AND ctx.key = c.prefix AND ctx.path = s.file GROUP BY 1
 UNION ALL SELECT call_id, 3, {_PICK} FROM c JOIN s USING (name) JOIN ctx ON ctx.file = c.at AND ctx.scope = 'symbol' AND ctx.key = c.name AND ctx.path = s.file GROUP BY 1)
SELECT c.call_id, arg_min(x, o) FILTER (x IS NOT NULL) AS target FROM c LEFT JOIN pick USING (call_id) GROUP BY 1""")
def candidate_resolution(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    text = lambda x: x.cast("string")
    symbols = p.select(F.concat(F.lit("f"), text(F.col("p_size") * 7 + k % 7)).alias("name"), F.when(k % 5 == 0, "class").otherwise("function").alias("kind"), F.col("p_brand").alias("file"), k.alias("node_id"))
    calls = p.select(k.alias("call_id"), F.col("p_brand").alias("file"), F.concat(F.lit("f"), text((k * 7) % 400)).alias("name"), F.when(k % 4 > 0, F.concat(F.lit("m"), text(k % 4))).alias("prefix"))
    return resolve.resolve_calls(calls, symbols, resolve.import_context(_imports(spark, d)))


@query("""WITH p AS (SELECT p_partkey, 'a.b.c' || (p_size % 3) AS module, p_size % 2 = 0 AS package, (['x.y', '.z', '..z', '...z.w', '....z', '.', 'q'])[p_partkey % 7 + 1] AS name FROM part),
q AS (SELECT *, length(name) - length(ltrim(name, '.')) AS level, ltrim(name, '.') AS rest, string_split(module, '.') AS w FROM p),
r AS (SELECT *, len(w) - level + package::INT AS keep FROM q)
SELECT p_partkey, CASE WHEN level = 0 THEN name WHEN keep >= 0 THEN nullif(concat_ws('.', nullif(array_to_string(w[1:keep], '.'), ''), nullif(rest, '')), '') END AS module FROM r""")
def relative_imports(spark, d):
    p = table(spark, d, "part")
    names = ("x.y", ".z", "..z", "...z.w", "....z", ".", "q")
    name = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("p_partkey") % 7 + 1).cast("int"))
    module = F.concat(F.lit("a.b.c"), (F.col("p_size") % 3).cast("string"))
    return p.select("p_partkey", C.absolute_import(name, module, F.col("p_size") % 2 == 0).alias("module"))


@query("""WITH a AS (SELECT p_name AS alias, 0 AS o, p_partkey AS node_id FROM part UNION ALL SELECT p_type, 1, p_partkey FROM part UNION ALL SELECT p_brand, 2, p_partkey FROM part)
SELECT alias, arg_min(node_id, o * 1000000000 + node_id) AS node_id FROM a GROUP BY 1""")
def alias_lookup(spark, d):
    p = table(spark, d, "part")
    return resolve.alias_lookup(*[p.select(F.col(c).alias("alias"), F.col("p_partkey").alias("node_id")) for c in ("p_name", "p_type", "p_brand")])


@query("SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 8")
def topk_per_group(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.top_per_group(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 8).select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"), "rank")


@query("""WITH r AS (SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1 AS lead FROM part)
SELECT p_partkey, p_brand, p_size FROM r ORDER BY lead DESC, p_size DESC, p_partkey LIMIT 40""")
def stratified_topk(spark, d):
    return ranking.stratified_top(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", [F.desc("p_size"), F.col("p_partkey")], 40)


@query("""WITH i AS (SELECT event_id AS idx, event_type AS domain, 'type' || (event_id % 5) AS type, (['HIGH', 'MEDIUM', 'LOW', 'INFO'])[event_id % 4 + 1] AS severity, 'Message  of ' || (event_id % 3) AS message, 1 AS c, user_id::VARCHAR AS node FROM events),
k AS (SELECT *, lower(trim(regexp_replace(message, '\\s+', ' ', 'g'))) AS key, CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END AS sr FROM i),
n AS (SELECT domain, type, key, node, row_number() OVER (PARTITION BY domain, type, key ORDER BY min(idx), node) AS r FROM k GROUP BY domain, type, key, node QUALIFY r <= 25),
s AS (SELECT domain, type, key, string_agg(node, ',' ORDER BY r) AS nodes FROM n GROUP BY ALL)
SELECT domain, type, arg_min(message, idx) AS message, (['HIGH', 'MEDIUM', 'LOW', 'INFO'])[min(sr) + 1] AS severity, sum(c)::BIGINT AS count, any_value(nodes) AS nodes FROM k JOIN s USING (domain, type, key) GROUP BY domain, type, key""")
def issue_collapse(spark, d):
    e = table(spark, d, "events")
    issues = e.select(
        F.col("event_id").alias("idx"), F.col("event_type").alias("domain"), F.concat(F.lit("type"), (F.col("event_id") % 5).cast("string")).alias("type"),
        F.element_at(F.array(*[F.lit(x) for x in P.SEVERITY_RANK]), (F.col("event_id") % 4 + 1).cast("int")).alias("severity"),
        F.concat(F.lit("Message  of "), (F.col("event_id") % 3).cast("string")).alias("message"), F.lit(1).alias("count"), F.col("user_id").cast("string").alias("node"),
    )
    return ranking.collapse_issues(issues).withColumn("nodes", F.array_join("nodes", ","))


@query("""WITH t AS (SELECT event_type AS type, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY 1), m AS (SELECT *, sum(n) OVER () AS a, max(u) OVER () AS b FROM t),
s AS (SELECT type, round(0.5::DOUBLE * (n::DOUBLE / a) + 0.3::DOUBLE * (u::DOUBLE / b) + 0.2::DOUBLE * (n::DOUBLE / a), 3) AS severity FROM m),
r AS (SELECT *, row_number() OVER (ORDER BY severity DESC, type)::INT AS rank FROM s)
SELECT printf('rc-%02d-%s', rank, lower(type)) AS id, rank, type, severity, round(least(1.0::DOUBLE, 0.65::DOUBLE * severity + 0.35::DOUBLE * 0.5::DOUBLE), 3) AS confidence FROM r""")
def root_cause_rank(spark, d):
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u"))
    m = t.agg(F.sum("n").alias("a"), F.max("u").alias("b"))
    rows = t.crossJoin(F.broadcast(m)).select("type", (F.col("n") / F.col("a")).alias("impact"), (F.col("u") / F.col("b")).alias("centrality"), (F.col("n") / F.col("a")).alias("frequency"), F.lit(0.5).alias("evidence"))
    return ranking.root_causes(rows)


FILES_SQL = "f AS (SELECT (['scripts/d', 'pkg/d', 'notes/d'])[doc_id % 3 + 1] || doc_id || (['.py', '.py', '.txt', '.MD', ''])[doc_id % 5 + 1] AS path, coalesce(text, '') AS text FROM documents)"


def _document_files(spark: SparkSession, d: str) -> DataFrame:
    """The documents as files (path, size, content) of a tree."""
    t = table(spark, d, "documents")
    k = F.col("doc_id")
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), (k % len(values) + 1).cast("int"))
    path = F.concat(pick(("scripts/d", "pkg/d", "notes/d")), k.cast("string"), pick((".py", ".py", ".txt", ".MD", "")))
    text = F.coalesce("text", F.lit(""))
    return t.select(path.alias("path"), F.octet_length(text).cast("long").alias("size"), text.cast("binary").alias("content"))


@query(f"""WITH {FILES_SQL} SELECT count(*) AS file_count, count(*) FILTER (path LIKE '%.py') AS python_file_count, sum(strlen(text))::BIGINT AS total_bytes, count(*) FILTER (path LIKE 'scripts/%.py') AS entrypoint_count,
  array_to_string(list_sort(list(path) FILTER (path LIKE 'scripts/%.py'))[1:20], ',') AS entrypoints FROM f""")
def manifest_summary(spark, d):
    return scan.manifest_summary(scan.build_manifest(_document_files(spark, d)), 20).withColumn("entrypoints", F.array_join("entrypoints", ","))


@query(f"""WITH {FILES_SQL} SELECT path, sha256(text) AS sha256, strlen(text)::BIGINT AS size, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.txt' THEN 'txt' WHEN path LIKE '%.MD' THEN 'md' ELSE 'unknown' END AS language,
  replace(replace(path, '.py', ''), '/', '.') AS module FROM f""")
def content_sha256(spark, d):
    return scan.build_manifest(_document_files(spark, d)).select("path", "sha256", "size", "language", "module")


@query(f"WITH {FILES_SQL} SELECT CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.txt' THEN 'txt' WHEN path LIKE '%.MD' THEN 'md' ELSE 'unknown' END AS language, count(*) AS n FROM f GROUP BY 1")
def language_counts(spark, d):
    return scan.language_counts(scan.build_manifest(_document_files(spark, d)))


@query("""WITH p AS (SELECT p_partkey, (['scripts/tool.py', 'pkg/main.py', 'app.py', './a/b/cli.py', 'lib/x.py'])[p_partkey % 5 + 1] AS path, p_size > 40 AS e, p_size % 7 = 0 AS g, p_size % 11 = 0 AS m FROM part)
SELECT p_partkey, array_to_string(list_filter_null, ',') AS reasons FROM (SELECT p_partkey, list_concat(CASE WHEN e THEN ['explicit_config'] ELSE [] END, CASE WHEN path IN ('pkg/main.py', 'app.py', './a/b/cli.py') THEN ['filename_heuristic'] ELSE [] END,
  CASE WHEN g THEN ['main_guard'] ELSE [] END, CASE WHEN m THEN ['main_symbol'] ELSE [] END, CASE WHEN path LIKE 'scripts/%' THEN ['scripts_directory'] ELSE [] END) AS list_filter_null FROM p)""")
def entrypoint_reasons(spark, d):
    p = table(spark, d, "part")
    path = F.element_at(F.array(*[F.lit(x) for x in ("scripts/tool.py", "pkg/main.py", "app.py", "./a/b/cli.py", "lib/x.py")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    symbols = F.when(F.col("p_size") % 11 == 0, F.array(F.lit("run"), F.lit("main"))).otherwise(F.array(F.lit("run")))
    return p.select("p_partkey", F.array_join(C.entrypoint_reasons(path, F.col("p_size") > 40, F.col("p_size") % 7 == 0, symbols), ",").alias("reasons"))


@query("""SELECT c_custkey, 'canonical://customer/' || c_mktsegment || '/' || c_custkey AS canonical_id, 'customer:' || c_mktsegment || ':' || c_custkey AS node_id, 'customer' AS namespace FROM customer""")
def canonical_ids(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    canonical = C.canonical_id(F.lit("customer"), F.col("c_mktsegment"), key)
    return c.select("c_custkey", canonical.alias("canonical_id"), C.node_id(F.lit("customer"), F.col("c_mktsegment"), key).alias("node_id"), C.namespace(canonical).alias("namespace"))


@query("SELECT event_type, count(*) FILTER (props IS NOT NULL) AS with_props, count(*) FILTER (json_valid(props)) AS valid FROM events GROUP BY 1")
def json_flags(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("props").alias("with_props"), F.count(F.try_parse_json("props")).alias("valid"))


@query("""SELECT c_mktsegment AS segment, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())""")
def grouping_counts(spark, d):
    c = table(spark, d, "customer")
    return c.groupingSets([["c_mktsegment"], ["c_nationkey"], []], "c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")).select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS start FROM events),
s AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_at")).select("user_id", "n", "first_at")


@query("""WITH d AS (SELECT DISTINCT (['apps/api/', 'scripts/', 'tests/', 'lib/'])[p_partkey % 4 + 1] || p_brand AS path, (['main_guard', 'script_file', 'test_file', 'web_router'])[p_size % 4 + 1] AS category FROM part), w(c, x) AS (VALUES ('main_guard', 200.0::DOUBLE), ('script_file', 90.0), ('test_file', 30.0), ('web_router', 170.0))
SELECT path, string_agg(category, ',' ORDER BY category) AS categories, sum(x) + CASE WHEN path LIKE 'apps/api/%' THEN 8 WHEN path LIKE 'scripts/%' THEN 4 WHEN path LIKE 'tests/%' THEN 1 ELSE 0 END AS score, arg_max(category, x) AS "primary" FROM d JOIN w ON category = c GROUP BY 1""")
def entrypoint_scores(spark, d):
    p = table(spark, d, "part")
    category = F.element_at(F.array(*[F.lit(x) for x in ("main_guard", "script_file", "test_file", "web_router")]), F.col("p_size") % 4 + 1)
    folder = F.element_at(F.array(*[F.lit(x) for x in ("apps/api/", "scripts/", "tests/", "lib/")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return ranking.entrypoints(p.select(F.concat(folder, "p_brand").alias("path"), category.alias("category"))).select("path", F.array_join("categories", ",").alias("categories"), "score", "primary")


@query(f"""WITH {EDGES_SQL}, {REFS_SQL} SELECT node_id, round(0.5::DOUBLE * inbound + 0.2::DOUBLE * outbound + 1.0, 3) AS seed, round(120.0::DOUBLE + 6.0 * (inbound + outbound) + 25.0::DOUBLE / (1 + inbound) + 12.0 * outbound + 2.0 + CASE WHEN inbound + outbound <= 1 THEN 10.0 ELSE 0.0 END, 3) AS probe FROM r""")
def probe_priorities(spark, d):
    r = evidence.reference_counts(edges(spark, d)).withColumns({"hits": F.lit(0), "preferred": F.lit(False), "kind": F.lit("file"), "unexplored": F.col("outbound")})
    seeds = ranking.seed_priority(r).withColumnRenamed("priority", "seed")
    return ranking.probe_priority(seeds).select("node_id", "seed", F.col("priority").alias("probe"))


CALLS_SQL = f"""{TRACE_SQL}, k AS (SELECT run_id, seq, event, event_type AS node_id, coalesce(lag(event_type) OVER (PARTITION BY run_id ORDER BY seq), '') AS caller FROM t)"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy("seq")
    return trace(spark, d).select("run_id", "seq", "event", F.col("event_type").alias("node_id"), F.coalesce(F.lag("event_type").over(w), F.lit("")).alias("caller"), F.lit(1).alias("depth"))


@query(f"""WITH {CALLS_SQL}, c AS (SELECT run_id, count(*) AS events, count(*) FILTER (event = 'call') AS calls, count(*) FILTER (event = 'import') AS imports, count(DISTINCT node_id) FILTER (event = 'call') AS nodes FROM k GROUP BY 1)
SELECT run_id, events, calls, imports, nodes, CASE WHEN run_id % 11 = 0 AND events > 0 THEN 'PARTIAL_SUCCESS' WHEN run_id % 7 = 0 THEN 'CRASHED' WHEN calls > 0 THEN 'CALL_ACTIVITY' WHEN imports > 0 THEN 'IMPORT_ONLY' WHEN events = 0 THEN 'NO_OP' ELSE 'NO_CALL_ACTIVITY' END AS label FROM c""")
def run_labels(spark, d):
    c = traces.run_counters(_calls(spark, d)).drop("max_depth")
    return c.withColumn("label", traces.run_label(F.col("run_id") % 11 == 0, F.when(F.col("run_id") % 7 == 0, 1).otherwise(0), F.col("calls"), F.col("imports"), F.col("events")))


@query(f"WITH {CALLS_SQL} SELECT count(DISTINCT run_id) AS runs, count(*) AS events, count(*) FILTER (event = 'call') AS calls, count(DISTINCT node_id) FILTER (event = 'call') AS nodes, count(DISTINCT caller || '>' || node_id) FILTER (event = 'call' AND caller <> '') AS edges FROM k")
def trace_summary(spark, d):
    return traces.trace_summary(_calls(spark, d))


@query(f"WITH {CALLS_SQL} SELECT node_id AS module, count(*) AS hits FROM k WHERE event = 'call' GROUP BY 1")
def module_hits(spark, d):
    return traces.module_hits(_calls(spark, d).withColumn("module", F.col("node_id")))


@query(f"""WITH {CALLS_SQL}, r AS (SELECT c_custkey AS run_id, (['seed', 'continuation', 'import_followup', 'forced_probe', 'seed'])[c_custkey % 5 + 1] AS origin, c_custkey % 3 < 2 AS executed, c_custkey % 11 = 0 AS timed_out, (c_custkey % 7 = 0)::INT AS exit_code FROM customer),
b AS (SELECT run_id, count(*) AS events, count(*) FILTER (event = 'call') AS calls, count(*) FILTER (event = 'import') AS imports FROM k GROUP BY 1),
j AS (SELECT r.*, coalesce(events, 0) AS events, coalesce(calls, 0) AS calls, coalesce(imports, 0) AS imports FROM r LEFT JOIN b USING (run_id) WHERE executed),
l AS (SELECT *, CASE WHEN timed_out AND events > 0 THEN 'PARTIAL_SUCCESS' WHEN timed_out THEN 'TIMEOUT' WHEN exit_code <> 0 THEN 'CRASHED' WHEN calls > 0 THEN 'CALL_ACTIVITY' WHEN imports > 0 THEN 'IMPORT_ONLY' WHEN events = 0 THEN 'NO_OP' ELSE 'NO_CALL_ACTIVITY' END AS label FROM j),
h AS (SELECT DISTINCT node_id FROM k WHERE event = 'call'), o AS (SELECT DISTINCT event_type AS node_id FROM events WHERE event_id % 2000 = 0), m AS (SELECT count(*) AS nodes FROM (SELECT event_type FROM events UNION SELECT p_brand FROM part)),
c AS (SELECT (SELECT count(*) FROM h) AS hit_nodes, (SELECT count(*) FROM h WHERE node_id NOT IN (SELECT node_id FROM o)) AS new_nodes, (SELECT count(*) FROM o) AS hit_before),
a AS (SELECT count(*) AS runs, sum(calls)::BIGINT AS call_events, sum(imports)::BIGINT AS import_events, 0::BIGINT AS line_events, count(*) FILTER (timed_out) AS timeouts, count(*) FILTER (label = 'CALL_ACTIVITY') AS call_activity_runs, count(*) FILTER (label = 'IMPORT_ONLY') AS import_only_runs,
  count(*) FILTER (calls = 0 AND imports > 0) AS import_heavy_runs, count(*) FILTER (label = 'NO_OP') AS no_op_runs, count(*) FILTER (label = 'NO_CALL_ACTIVITY') AS no_call_activity_runs, count(*) FILTER (label = 'CRASHED') AS crashed_runs, count(*) FILTER (label = 'PARTIAL_SUCCESS') AS partial_success_runs,
  count(*) FILTER (label IN ('CRASHED', 'TIMEOUT')) AS failed_runs, count(*) FILTER (origin = 'seed') AS seed_runs, count(*) FILTER (origin = 'continuation') AS continuation_runs, count(*) FILTER (origin = 'import_followup') AS import_followup_runs, count(*) FILTER (origin = 'forced_probe') AS forced_probe_runs FROM l),
s AS (SELECT count(*) FILTER (origin = 'continuation') AS continuation_scheduled, count(*) FILTER (origin = 'import_followup') AS import_followup_scheduled, count(*) FILTER (origin = 'forced_probe') AS forced_probe_scheduled FROM r)
SELECT a.*, s.*, c.*, m.*, runs - failed_runs AS successful_runs, round(hit_nodes::DOUBLE / nodes, 6) AS coverage, round(hit_before::DOUBLE / nodes, 6) AS baseline_coverage, round(hit_nodes::DOUBLE / nodes - hit_before::DOUBLE / nodes, 6) AS coverage_delta,
  concat_ws(',', CASE WHEN hit_nodes <= hit_before THEN 'coverage_not_above_baseline' END, CASE WHEN failed_runs > 0 THEN 'failed_runs' END, CASE WHEN call_activity_runs = 0 THEN 'no_call_activity' END, CASE WHEN import_heavy_runs > call_activity_runs THEN 'imports_dominate' END,
    CASE WHEN partial_success_runs > 0 THEN 'partial_traces_kept' END, CASE WHEN hit_nodes::DOUBLE / nodes < 0.25 THEN 'coverage_target_missed' END) AS warnings FROM a, s, c, m""")
def runtime_summary(spark, d):
    k = F.col("c_custkey")
    origin = F.element_at(F.array(*[F.lit(x) for x in (*traces.ORIGINS, "seed")]), (k % 5 + 1).cast("int"))
    runs = table(spark, d, "customer").select(k.alias("run_id"), origin.alias("origin"), (k % 3 < 2).alias("executed"), (k % 11 == 0).alias("timed_out"), F.when(k % 7 == 0, 1).otherwise(0).alias("exit_code"))
    e = table(spark, d, "events")
    known = e.select(F.col("event_type").alias("node_id")).union(table(spark, d, "part").select("p_brand"))
    before = e.where("event_id % 2000 = 0").select(F.col("event_type").alias("node_id"))
    return traces.run_summary(_calls(spark, d), runs, known, before, 0.25).withColumn("warnings", F.array_join("warnings", ","))


def _role_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), '{'|'.join(words)}') THEN '{name}'" for name, words in P.ROLE_WORDS.items()) + " ELSE 'internal' END"


FLOW_SQL = f"""fl AS (SELECT {_path_sql('p_partkey')} AS source, {_path_sql('p_partkey * 7 + 3')} AS target, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'runtime_call ' WHEN 2 THEN 'IMPORT' END AS type FROM part)"""


@query(f"""WITH {COMPRESSED_SQL}, {FLOW_SQL}, x AS (SELECT role AS from_role, lead(role) OVER (PARTITION BY run_id ORDER BY seq) AS to_role FROM c),
u AS (SELECT from_role, to_role FROM x WHERE to_role IS NOT NULL UNION ALL SELECT {_role_sql('source')}, {_role_sql('target')} FROM fl WHERE trim(coalesce(type, '')) = '' OR upper(trim(type)) = 'RUNTIME_CALL')
SELECT from_role, to_role, count(*) AS n FROM u GROUP BY ALL""")
def flow_transitions(spark, d):
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "").when(k % 4 == 1, "runtime_call ").when(k % 4 == 2, "IMPORT")
    flow = _path_edges(spark, d, kind.alias("type")).select(F.col("source_path").alias("source"), F.col("target_path").alias("target"), "type")
    return sequence.transitions(trace(spark, d), flow)


@query("""WITH f AS (SELECT DISTINCT 'src/' || p_brand || '/' || replace(p_name, ' ', '_') || (['.py', '.tar.gz', ''])[p_partkey % 3 + 1] AS path FROM part UNION SELECT 'pkg/' || s_suppkey || '/__init__.py' FROM supplier),
s AS (SELECT path, regexp_replace(string_split(path, '/')[-1], '(.)[.][^.]*$', '\\1') AS stem FROM f), c AS (SELECT stem, count(*) AS files FROM s WHERE stem <> '__init__' GROUP BY 1 HAVING count(*) > 1)
SELECT stem, path, files FROM s JOIN c USING (stem)""")
def shared_basenames(spark, d):
    p = table(spark, d, "part")
    tail = F.element_at(F.array(F.lit(".py"), F.lit(".tar.gz"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int"))
    files = p.select(F.concat(F.lit("src/"), "p_brand", F.lit("/"), F.translate("p_name", " ", "_"), tail).alias("path"))
    return traces.shared_basenames(files.union(table(spark, d, "supplier").select(F.concat(F.lit("pkg/"), F.col("s_suppkey").cast("string"), F.lit("/__init__.py")))))


@query(f"""WITH RECURSIVE {EDGES_SQL}, {NODES_SQL}, m AS (SELECT node_id FROM n UNION SELECT 'clerk:' || o_custkey FROM orders), links AS (SELECT DISTINCT source, target FROM g WHERE source IN (SELECT node_id FROM m) AND target IN (SELECT node_id FROM m)),
st AS (SELECT 'order:' || o_orderkey AS node_id FROM orders WHERE o_orderkey % 100 = 0), w(node_id) AS (SELECT node_id FROM st UNION SELECT target FROM w JOIN links ON source = node_id),
c AS (SELECT (SELECT count(*) FROM m) AS nodes, (SELECT count(*) FROM links) AS edges, (SELECT count(*) FROM st) AS entrypoints, (SELECT count(*) FROM w) AS reachable, (SELECT count(*) FROM m WHERE node_id NOT IN (SELECT source FROM links UNION SELECT target FROM links)) AS isolated)
SELECT *, round(reachable::DOUBLE / nodes, 6) AS reachable_ratio, round(isolated::DOUBLE / nodes, 6) AS isolated_ratio, concat_ws(',', CASE WHEN reachable::DOUBLE / nodes < 0.15 THEN 'reachable_nodes_below_minimum' END, CASE WHEN isolated::DOUBLE / nodes > 0.35 THEN 'isolated_nodes_above_maximum' END) AS reasons FROM c""")
def graph_sanity(spark, d):
    starts = table(spark, d, "orders").where("o_orderkey % 100 = 0").select(_id("order", "o_orderkey").alias("node_id"))
    return traces.graph_sanity(pairs.node_universe(nodes(spark, d), _clerks(spark, d)), edges(spark, d), starts).withColumn("reasons", F.array_join("reasons", ","))


@query("""SELECT DISTINCT 'redundant_domain' AS type, 'duplicate_intent' AS source, p_brand AS key, 'src/' || p_name AS path FROM part WHERE p_size > 25
UNION SELECT DISTINCT 'redundant_domain', 'abstraction_collision', p_type, 'src/' || p_name FROM part WHERE p_size <= 25""")
def redundant_domains(spark, d):
    p = table(spark, d, "part").select("*", F.concat(F.lit(" src/"), "p_name").alias("path"))
    return rules.redundant_domains(p.where("p_size > 25").select(F.col("p_brand").alias("cluster"), "path"), p.where("p_size <= 25").select(F.col("p_type").alias("concept"), F.col("path").alias("file")))


@query(f"""WITH {COMPRESSED_SQL}, x AS (SELECT role, lead(role) OVER (PARTITION BY run_id ORDER BY seq) AS nxt FROM c), i AS (SELECT (['direct_api_to_persistence_path ', 'DIRECT_STATE_CHANGE_BYPASSES_ORCHESTRATOR', 'MISSING_API_BOUNDARY'])[event_id % 3 + 1] AS type, CASE WHEN event_id % 4 > 0 THEN event_type END AS message FROM events)
SELECT * FROM (SELECT 'layer_violation' AS type, 'causal_flow' AS source, '' AS issue_type, 'calls from the API boundary straight to what is stored' AS message, count(*) AS count FROM x WHERE role = 'api' AND nxt = 'persistence') WHERE count > 0
UNION ALL SELECT 'layer_violation', 'causal_flow_issue', upper(trim(type)), coalesce(message, 'behaviour bypasses orchestration'), count(*) FROM i WHERE upper(trim(type)) LIKE 'DIRECT%' GROUP BY ALL""")
def behaviour_violations(spark, d):
    k = F.col("event_id")
    code = F.element_at(F.array(F.lit("direct_api_to_persistence_path "), F.lit("DIRECT_STATE_CHANGE_BYPASSES_ORCHESTRATOR"), F.lit("MISSING_API_BOUNDARY")), (k % 3 + 1).cast("int"))
    issues = table(spark, d, "events").select(code.alias("type"), F.when(k % 4 > 0, F.col("event_type")).alias("message"))
    return rules.behaviour_violations(sequence.causal_score(trace(spark, d)), issues)


@query(f"""WITH {RULES_SQL} SELECT source_path, target_path, sl AS source_layer, tl AS target_layer, count(*) AS n FROM f
JOIN (VALUES ('api', 0), ('orchestration', 1), ('domain', 2), ('infra', 3)) a(sl, sr) USING (sl) JOIN (VALUES ('api', 0), ('orchestration', 1), ('domain', 2), ('infra', 3)) b(tl, tr) USING (tl) WHERE sr < tr GROUP BY ALL""")
def layer_escalations(spark, d):
    ranks = spark.createDataFrame([(x, i) for i, x in enumerate(("api", "orchestration", "domain", "infra"))], "layer string, rank int")
    return rules.layer_ranks(_path_edges(spark, d), ranks).groupBy("source_path", "target_path", "source_layer", "target_layer").agg(F.count("*").alias("n"))


def _legacy_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes with blank and repeated ids, edges of all statuses with origins, resolver edges."""
    s, o, c = table(spark, d, "supplier"), table(spark, d, "orders"), table(spark, d, "customer")
    extra = s.select(F.when(F.col("s_suppkey") % 10 == 0, " ").otherwise(F.concat(F.lit("region:"), (F.col("s_suppkey") % 7).cast("string"))).alias("node_id"))
    k = F.col("o_orderkey")
    odd = o.select(_id("order", "o_orderkey").alias("source"), F.concat(F.lit("clerk:"), (k % 7).cast("string")).alias("target"), F.when(k % 5 == 0, "").when(k % 5 == 1, "odd").otherwise(" di").alias("type"))
    origin = F.when(F.col("type") == "IMPORT", "ast").when(F.col("type") == "CONFIG", "CONFIG")
    resolver = o.where("o_orderkey % 3 < 2").select(_id("order", "o_orderkey").alias("source"), _id("customer", "o_custkey").alias("target"), F.lit("AST ").alias("origin"))
    clerk = F.when(k % 50 == 1, F.concat(F.lit("clerk:"), (k % 9).cast("string"))).otherwise(_id("customer", "o_custkey"))
    resolver = resolver.union(o.where("o_orderkey % 3 > 0").select(_id("order", "o_orderkey"), clerk, F.lit("di")))
    one = lambda rows, n: rows.select(_id("customer", "c_custkey"), _id("nation", "c_nationkey"), F.lit(n))
    resolver = resolver.union(one(c, "CONFIG")).union(one(c.where("c_custkey % 2 = 0"), "HEURISTIC")).union(one(c, "OTHER"))
    return nodes(spark, d).union(extra), edges(spark, d).union(odd).withColumn("origin", origin), resolver


LEGACY_SQL = f"""{EDGES_SQL}, {NODES_SQL}, nn AS (SELECT node_id FROM n UNION ALL SELECT CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE 'region:' || (s_suppkey % 7) END FROM supplier),
ee AS (SELECT source, target, upper(trim(type)) AS type, CASE type WHEN 'IMPORT' THEN 'AST' WHEN 'CONFIG' THEN 'CONFIG' ELSE '' END AS origin FROM (SELECT * FROM g UNION ALL SELECT 'order:' || o_orderkey, 'clerk:' || (o_orderkey % 7), CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'odd' ELSE ' di' END FROM orders)),
ju AS (SELECT *, CASE WHEN type = '' THEN 'malformed' WHEN type NOT IN ({', '.join(repr(x) for x in P.ALLOWED_EDGE_TYPES['v1'])}) THEN 'invalid_type' WHEN source NOT IN (SELECT node_id FROM nn) OR target NOT IN (SELECT node_id FROM nn) THEN 'unresolved' ELSE 'valid' END AS status FROM ee),
re AS (SELECT 'order:' || o_orderkey AS source, 'customer:' || o_custkey AS target, 'AST' AS origin FROM orders WHERE o_orderkey % 3 < 2
  UNION ALL SELECT 'order:' || o_orderkey, CASE WHEN o_orderkey % 50 = 1 THEN 'clerk:' || (o_orderkey % 9) ELSE 'customer:' || o_custkey END, 'DI' FROM orders WHERE o_orderkey % 3 > 0
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'CONFIG' FROM customer UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'HEURISTIC' FROM customer WHERE c_custkey % 2 = 0)"""


@query(f"""WITH {LEGACY_SQL}, b AS (SELECT node_id, count(*) AS k FROM nn GROUP BY 1)
SELECT * FROM (SELECT sum(k)::BIGINT AS nodes, count(*) FILTER (node_id <> '') AS valid_nodes, coalesce(sum(k) FILTER (node_id = ''), 0)::BIGINT AS malformed, coalesce(sum(k - 1) FILTER (node_id <> ''), 0)::BIGINT AS duplicates, count(*) FILTER (node_id <> '') AS bad_namespace FROM b),
(SELECT count(*) AS edges, count(*) FILTER (status = 'valid') AS valid_edges, count(*) FILTER (status = 'malformed') AS malformed_edges, count(*) FILTER (status = 'unresolved') AS unresolved_edges, count(*) FILTER (status = 'invalid_type') AS invalid_type_edges FROM ju)""")
def legacy_structure(spark, d):
    n, e, _ = _legacy_tables(spark, d)
    return legacy.node_figures(n).crossJoin(F.broadcast(legacy.edge_figures(legacy.judged_edges(n, e))))


@query(f"""WITH {LEGACY_SQL}, v AS (SELECT DISTINCT source, target, type, origin FROM ju WHERE status = 'valid'),
a AS (SELECT DISTINCT source, target FROM re WHERE origin = 'AST'), b AS (SELECT DISTINCT source, target FROM re WHERE origin = 'DI'), x AS (SELECT DISTINCT source, target FROM re WHERE origin = 'CONFIG'), y AS (SELECT DISTINCT source, target FROM re WHERE origin = 'HEURISTIC'),
z AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS nab, (SELECT count(*) FROM x) AS nx, (SELECT count(*) FROM y) AS ny, (SELECT count(*) FROM (SELECT * FROM x INTERSECT SELECT * FROM y)) AS nxy),
ends AS (SELECT source AS node_id FROM b UNION SELECT target FROM b)
SELECT (SELECT count(*) FROM re) AS resolver_edges, {', '.join(f"(SELECT count(*) FROM re WHERE origin = '{o}') AS {o.lower()}_edges, (SELECT count(*) FILTER (origin = '{o}') + count(*) FILTER (type = '{o}') FROM v) AS {o.lower()}_represented" for o in legacy.SOURCES)},
  round((na + nb - 2 * nab)::DOUBLE / (na + nb - nab) * least(1.0::DOUBLE, na::DOUBLE / nb), 3) AS divergence, nb - nab AS inferred, na + nb - 2 * nab AS apart, round(nxy::DOUBLE / least(nx, ny), 3) AS alignment,
  (SELECT count(*) FROM ends) AS di_nodes, (SELECT count(*) FROM ends WHERE node_id NOT IN (SELECT node_id FROM nn)) AS missing_di FROM z""")
def legacy_dependency(spark, d):
    n, e, r = _legacy_tables(spark, d)
    return legacy.dependency_figures(n, legacy.judged_edges(n, legacy.standing(e)), r)


def _domain_row(spark: SparkSession, found, *metrics: str) -> DataFrame:
    """A domain of the verdict as one row: its score, the metrics, and its issues with counts."""
    issues = ",".join(f"{i['type']}:{i['count']}" for i in sorted(found.issues, key=lambda i: i["type"]))
    return spark.createDataFrame([(float(found.score), *[float(found.metrics[m]) for m in metrics], issues)], f"score double, {', '.join(f'{m} double' for m in metrics)}, issues string")


def _counted_sql(*counts: str) -> str:
    """TYPE:count of the counts (named after their types) that are not zero."""
    return "concat_ws(','," + ", ".join(f"CASE WHEN {c} > 0 THEN '{c}:' || {c} END" for c in sorted(counts)) + ")"


@query(f"""WITH {LEGACY_SQL}, e AS (SELECT DISTINCT source, target, type FROM ju), k AS (SELECT *, CASE WHEN type = '' THEN 'm' WHEN type NOT IN ('CONFIG', 'DI', 'DYNAMIC', 'IMPORT') THEN 'i' WHEN source NOT IN (SELECT node_id FROM nn) OR target NOT IN (SELECT node_id FROM nn) THEN 'u' ELSE 'v' END AS st FROM e),
q AS (SELECT count(*) FILTER (st = 'm') AS MALFORMED_EDGE_SCHEMA, count(*) FILTER (st = 'i') AS INVALID_EDGE_TYPE, count(*) FILTER (st = 'u') AS UNRESOLVED_EDGE_REFERENCE, count(*) FILTER (st = 'v') AS v, count(*) AS t FROM k),
b AS (SELECT count(*) AS n, count(*) FILTER (node_id = '') AS MALFORMED_NODE_ID, count(*) FILTER (c > 1) AS DUPLICATE_NODE_ID, count(*) FILTER (node_id <> '') AS INVALID_NODE_NAMESPACE FROM (SELECT node_id, count(*) AS c FROM nn GROUP BY 1)),
r AS (SELECT *, (t - v)::DOUBLE / t AS r0, (MALFORMED_NODE_ID + INVALID_NODE_NAMESPACE)::DOUBLE / n AS r1 FROM q, b)
SELECT round(1 - least(1.0::DOUBLE, 0.8::DOUBLE * r0 + 0.2::DOUBLE * r1), 3) AS score, round(r0, 3) AS invalid_edge_ratio, round(r1, 3) AS malformed_node_ratio, v::DOUBLE AS valid_edges, (n - MALFORMED_NODE_ID)::DOUBLE AS valid_nodes,
  {_counted_sql('MALFORMED_EDGE_SCHEMA', 'INVALID_EDGE_TYPE', 'UNRESOLVED_EDGE_REFERENCE', 'MALFORMED_NODE_ID', 'DUPLICATE_NODE_ID', 'INVALID_NODE_NAMESPACE')} AS issues FROM r""")
def structural_domain(spark, d):
    n, e, _ = _legacy_tables(spark, d)
    found, _ = verify.structural_integrity(n, e.withColumn("confidence", F.lit(1.0)), keep=False)
    return _domain_row(spark, found, "invalid_edge_ratio", "malformed_node_ratio", "valid_edges", "valid_nodes")


@query(f"""WITH {LEGACY_SQL}, gd AS (SELECT DISTINCT source, target FROM ee WHERE type = 'DI'), a AS (SELECT DISTINCT source, target FROM re WHERE origin = 'AST'), b AS (SELECT DISTINCT source, target FROM re WHERE origin = 'DI'),
z AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS nab, (SELECT count(*) FROM gd) AS ng, (SELECT count(*) FROM (SELECT * FROM gd INTERSECT SELECT * FROM b)) AS ngb),
ends AS (SELECT source AS node_id FROM b UNION SELECT target FROM b), m AS (SELECT count(*) AS ends, count(*) FILTER (node_id NOT IN (SELECT node_id FROM nn)) AS missing FROM ends),
y AS (SELECT *, na + nb - nab AS u, ng + nb - ngb AS ug FROM z, m),
x AS (SELECT *, missing::DOUBLE / ends AS ratio, round((u - nab)::DOUBLE / u * (0.7::DOUBLE + 0.3::DOUBLE * least(na, nb) / u), 3) AS dv, round((ug - ngb)::DOUBLE / ug * (0.7::DOUBLE + 0.3::DOUBLE * least(ng, nb) / ug), 3) AS dr FROM y)
SELECT round(1 - least(1.0::DOUBLE, 0.65::DOUBLE * ratio + 0.2::DOUBLE * dv + 0.15::DOUBLE * dr), 3) AS score, round(ratio, 3) AS missing_di_ratio, dv AS ast_di_divergence, round(nab::DOUBLE / least(na, nb), 3) AS ast_di_overlap, dr AS graph_di_drift,
  concat_ws(',', CASE WHEN dv > 0 THEN CASE WHEN dv > 0.5 THEN 'AST_DI_DIVERGENCE_ESCALATED:' ELSE 'AST_DI_DIVERGENCE_TRACKED:' END || (u - nab) END, CASE WHEN dr > 0.35 THEN 'GRAPH_DI_DRIFT:' || round_even(dr * greatest(1, ng + nb), 0)::BIGINT END, CASE WHEN missing > 0 THEN 'MISSING_DI_NODES:' || missing END) AS issues FROM x""")
def dependency_domain(spark, d):
    n, e, r = _legacy_tables(spark, d)
    found = verify.dependency_consistency(n, e.withColumn("type", F.upper(F.trim("type"))), r)
    return _domain_row(spark, found, "missing_di_ratio", "ast_di_divergence", "ast_di_overlap", "graph_di_drift")


@query(f"WITH {CALLS_SQL} SELECT DISTINCT caller AS source, node_id AS target FROM k WHERE event = 'call' AND caller <> ''")
def flow_edges(spark, d):
    return traces.flow_edges(_calls(spark, d))


@query("""WITH o AS (SELECT s_suppkey, s_suppkey % 60 AS calls, s_suppkey % 3 AS imports, s_suppkey % 12 AS u, s_suppkey % 5 AS depth, s_suppkey % 2 AS local, s_suppkey % 400 AS nodes, s_suppkey % 9 AS hit, s_suppkey % 13 = 0 AS synthetic, s_suppkey % 4 AS ep, s_suppkey % 7 AS ex, s_suppkey % 6 AS un FROM supplier)
SELECT s_suppkey, concat_ws(',', CASE WHEN synthetic THEN 'synthetic_runtime_trace_not_allowed' END, CASE WHEN calls <= 0 AND imports > 0 THEN 'runtime_trace_contains_only_import_or_bootstrap_events' END, CASE WHEN calls < least(50, greatest(10, u)) THEN 'runtime_call_events_below_threshold' END,
  CASE WHEN u < least(10, greatest(3, ceil(0.03::DOUBLE * greatest(1, nodes)))) THEN 'runtime_unique_callee_nodes_below_threshold' END, CASE WHEN depth < 3 THEN 'runtime_call_depth_below_threshold' END, CASE WHEN local < 1 THEN 'runtime_local_call_count_below_threshold' END,
  CASE WHEN calls > 0 AND hit = 0 THEN 'runtime_calls_exist_but_no_hits_mapped_to_graph_nodes' END, CASE WHEN hit::DOUBLE / greatest(1, nodes) < 0.02 THEN 'runtime_coverage_ratio_below_threshold' END, CASE WHEN (hit + 1)::DOUBLE / greatest(1, nodes) < 0.05 THEN 'runtime_reachable_ratio_below_threshold' END,
  CASE WHEN calls > 0 AND u > 0 AND hit = 0 THEN 'runtime_static_call_overlap_is_zero' END, CASE WHEN ep > 0 AND ex = 0 THEN 'manifest_entrypoints_not_observed_in_runtime' END, CASE WHEN un > 0 AND u = 0 THEN 'runtime_identity_mapping_failed' END) AS issues FROM o""")
def runtime_gate(spark, d):
    k = F.col("s_suppkey")
    row = table(spark, d, "supplier").select(k, (k % 60).alias("calls"), (k % 3).alias("imports"), (k % 12).alias("unique"), (k % 5).alias("depth"), (k % 2).alias("local"), (k % 400).alias("nodes"), (k % 9).alias("hit_nodes"))
    row = row.withColumns({"reached": F.col("hit_nodes") + 1, "static_edges": F.col("calls"), "runtime_edges": F.col("unique"), "shared_edges": F.col("hit_nodes")})
    row = row.withColumns({"synthetic": k % 13 == 0, "entrypoints": k % 4, "executed": k % 7, "unmatched": k % 6})
    return traces.runtime_gate(row).select("s_suppkey", F.array_join("issues", ",").alias("issues"))


@query(f"""WITH {NODES_SQL}, {TRACE_SQL}, x AS (SELECT t.*, n.node_id IS NOT NULL AS known FROM t LEFT JOIN n USING (node_id))
SELECT count(*) FILTER (event = 'call') AS calls, count(DISTINCT node_id) FILTER (event = 'call' AND known) AS "unique", count(*) FILTER (event = 'call' AND NOT known) AS unmatched, count(*) FILTER (event = 'call' AND run_id % 3 > 0) AS local,
  max(seq % 9) FILTER (event = 'call') AS depth, count(DISTINCT node_id) FILTER (event = 'call' AND known) AS hit_nodes, count(*) FILTER (event = 'import') AS imports FROM x""")
def runtime_facts(spark, d):
    t = trace(spark, d).select("event", "node_id", F.when(F.col("run_id") % 3 == 0, "<frozen>").otherwise("a.py").alias("file"), (F.col("seq") % 9).alias("depth"))
    return traces.runtime_facts(t, nodes(spark, d))


@query("""WITH RECURSIVE k AS (SELECT s_suppkey AS k FROM supplier), e AS (SELECT k AS source, k * 2 AS target FROM k WHERE k % 3 > 0 UNION ALL SELECT k, k // 3 FROM k WHERE k % 5 = 0),
n AS (SELECT k AS x FROM k WHERE k % 2 = 0 UNION SELECT source FROM e UNION SELECT target FROM e), r AS (SELECT x FROM n WHERE x NOT IN (SELECT target FROM e)),
w(node_id, depth) AS (SELECT x, 0 FROM r UNION SELECT target, depth + 1 FROM w JOIN (SELECT DISTINCT source, target FROM e) ON source = node_id WHERE depth < 60)
SELECT node_id, min(depth) AS depth FROM w GROUP BY 1""")
def runtime_reach(spark, d):
    k = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    e = k.where("k % 3 > 0").select(F.col("k").alias("source"), (F.col("k") * 2).alias("target")).union(k.where("k % 5 = 0").select("k", F.expr("k div 3")))
    return traces.runtime_reachable(k.where("k % 2 = 0").select(F.col("k").alias("node_id")), e)


@query("""WITH x AS (SELECT 'pkg/m' || (p_partkey % 50) || '.py' AS path FROM part WHERE p_size < 25), y AS (SELECT 'pkg/m' || (p_partkey % 60) || '.py' AS path FROM part WHERE p_size >= 25)
SELECT DISTINCT y.path, y.path IN (SELECT path FROM x) AS executed FROM y""")
def entrypoint_evidence(spark, d):
    p = table(spark, d, "part")
    path = lambda n: F.concat(F.lit("pkg/m"), (F.col("p_partkey") % n).cast("string"), F.lit(".py"))
    kind = F.element_at(F.array(F.lit("file"), F.lit("function"), F.lit("class")), (F.col("p_partkey") % 3 + 1).cast("int"))
    seen = p.where("p_size < 25").select(C.canonical_id(kind, path(50), F.when(kind == "file", "").otherwise("run")).alias("node_id"))
    return traces.entrypoint_evidence(p.where("p_size >= 25").select(F.concat(F.lit("./"), path(60)).alias("path")), seen)


@query("""WITH p AS (SELECT page_id, string_split(replace(regexp_replace(lower(url), '[_.\\-\\\\]', '/', 'g'), ':', '/'), '/') AS w FROM pages)
SELECT page_id, CASE WHEN list_has_any(w, ['api', 'rest', 'http', 'web']) THEN 'api' WHEN list_has_any(w, ['cli', 'command', 'commands', 'cmd']) THEN 'cli' WHEN list_has_any(w, ['job', 'jobs', 'worker', 'workers', 'scheduler', 'cron', 'background', 'queue', 'queues', 'task', 'tasks']) THEN 'background' ELSE 'other' END AS domain FROM p""")
def entrypoint_domains(spark, d):
    return table(spark, d, "pages").select("page_id", traces.entrypoint_domain(F.col("url")).alias("domain"))


@query(f"""WITH {EDGES_SQL}, rev AS (SELECT DISTINCT target AS source, source AS target FROM g WHERE type = 'CALL'), o AS (SELECT source AS target, count(*) AS o FROM rev GROUP BY 1)
SELECT source, rev.target, row_number() OVER (PARTITION BY source ORDER BY coalesce(o, 0) DESC, rev.target)::INT AS rank FROM rev LEFT JOIN o USING (target) QUALIFY rank <= 8""")
def call_neighbours(spark, d):
    e = edges(spark, d)
    return traces.neighbours(e.select(F.col("target").alias("source"), F.col("source").alias("target"), "type"))


@query("SELECT p_name AS path, count(DISTINCT p_partkey) AS ids FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def identity_collisions(spark, d):
    return traces.identity_collisions(table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("path")))


@query("""WITH l AS (SELECT p_brand AS f, p_type AS t FROM part), b AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT count(*) AS n FROM l GROUP BY f, t)), x AS (SELECT sum(n * (n - 1) / 2) AS f FROM (SELECT count(*) AS n FROM l GROUP BY f)), y AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT count(*) AS n FROM l GROUP BY t)),
z AS (SELECT p::DOUBLE / f AS p, p::DOUBLE / t AS r FROM b, x, y) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM z""")
def pairwise_f1(spark, d):
    return traces.pairwise_f1(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("found"), F.col("p_type").alias("truth")))


@query("""WITH p AS (SELECT source || '/' || lang || '/' || doc_id AS path, source AS folder FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY path) AS k FROM p)
SELECT folder, count(*) AS files, string_agg(path, ',' ORDER BY path) FILTER (k <= 20) AS sample FROM f GROUP BY 1""")
def directory_coverage(spark, d):
    docs = table(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return traces.directory_coverage(docs).withColumn("sample", F.array_join("sample", ","))


@query("""WITH s AS (SELECT DISTINCT o_custkey AS id, o_orderpriority || (o_orderkey % 4) AS name FROM orders), n AS (SELECT id, count(*) AS n, string_agg(name, ' ' ORDER BY name) AS t FROM s GROUP BY 1 HAVING count(*) >= 5),
c AS (SELECT min(id) AS id, any_value(n) AS n FROM n GROUP BY t), k AS (SELECT s.* FROM s JOIN c USING (id)), p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM k x JOIN k y ON x.name = y.name AND x.id < y.id GROUP BY ALL)
SELECT a, b, shared::INT AS shared, round(shared::DOUBLE / (ca.n + cb.n - shared), 6) AS jaccard FROM p JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE shared >= 5 AND shared::DOUBLE / (ca.n + cb.n - shared) >= 0.6""")
def shared_names(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.concat(F.col("o_orderpriority"), (F.col("o_orderkey") % 4).cast("string")).alias("name"))
    return traces.shared_names(o).select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


@query("""WITH s AS (SELECT DISTINCT o_custkey AS id, o_orderpriority || (o_orderkey % 4) AS name FROM orders), n AS (SELECT id, count(*) AS n, string_agg(name, ' ' ORDER BY name) AS t FROM s GROUP BY 1 HAVING count(*) >= 5),
m AS (SELECT id, n, min(id) OVER (PARTITION BY t) AS rep, count(*) OVER (PARTITION BY t) AS same FROM n), c AS (SELECT id, n FROM m WHERE id = rep), k AS (SELECT s.* FROM s JOIN c USING (id)),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM k x JOIN k y ON x.name = y.name AND x.id < y.id GROUP BY ALL),
j AS (SELECT a, b FROM p JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE shared >= 5 AND shared::DOUBLE / (ca.n + cb.n - shared) >= 0.6),
l AS (SELECT rep, count(*) AS links FROM (SELECT a AS rep FROM j UNION ALL SELECT b FROM j) GROUP BY 1) SELECT id, rep, same, coalesce(links, 0) AS links FROM m LEFT JOIN l USING (rep)""")
def shared_name_members(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.concat(F.col("o_orderpriority"), (F.col("o_orderkey") % 4).cast("string")).alias("name"))
    return traces.shared_name_members(o)


@query("""WITH p AS (SELECT p_partkey, (['tests/a.py', 'src/x/test_b.py', 'lib/site-packages/c.py', 'scripts/cli_run.py', 'pkg/__init__.py', 'pkg/core/d.py', 'tools/e.py', 'pkg/odd/f_test.py', '<string>'])[p_partkey % 9 + 1] AS path, (['fastapi.routing', 'os', 'click', 'flask'])[p_size % 4 + 1] AS imp FROM part),
q AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM p)
SELECT p_partkey, path LIKE 'tests/%' OR name LIKE 'test\\_%' ESCAPE '\\' OR name LIKE '%\\_test.py' ESCAPE '\\' AS is_test,
  path LIKE '<%' OR path LIKE '%site-packages/%' OR path LIKE '%/\\_\\_init\\_\\_.py' ESCAPE '\\' OR path LIKE 'tests/%' OR path LIKE '%/test\\_%' ESCAPE '\\' OR path LIKE '%\\_test.py' ESCAPE '\\' AS excluded,
  imp IN ('fastapi.routing', 'flask') AS web, name LIKE '%cli%' OR path LIKE 'scripts/%' OR imp = 'click' AS cli,
  CASE path WHEN 'tests/a.py' THEN 'domain' WHEN 'tools/e.py' THEN 'tooling' WHEN 'pkg/__init__.py' THEN 'package_root' WHEN 'pkg/core/d.py' THEN 'domain' WHEN 'pkg/odd/f_test.py' THEN 'misplaced' ELSE 'orphan' END AS category FROM q""")
def path_predicates(spark, d):
    p = table(spark, d, "part")
    paths = ("tests/a.py", "src/x/test_b.py", "lib/site-packages/c.py", "scripts/cli_run.py", "pkg/__init__.py", "pkg/core/d.py", "tools/e.py", "pkg/odd/f_test.py", "<string>")
    path = F.element_at(F.array(*[F.lit(x) for x in paths]), (F.col("p_partkey") % 9 + 1).cast("int"))
    imports = F.array(F.element_at(F.array(*[F.lit(x) for x in ("fastapi.routing", "os", "click", "flask")]), F.col("p_size") % 4 + 1))
    rows = p.select("p_partkey", path.alias("path"), imports.alias("imports"))
    return rows.select("p_partkey", C.is_test(F.col("path")).alias("is_test"), C.is_excluded_seed(F.col("path")).alias("excluded"), C.is_web_router(F.col("imports")).alias("web"), C.is_cli_module(F.col("path"), F.col("imports")).alias("cli"), C.file_category(F.col("path"), "pkg", ("core",)).alias("category"))


def _probe_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts as graph nodes with degrees, hits and priorities."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("function"), F.lit("class"), F.lit("module")), (k % 3 + 1).cast("int"))
    return table(spark, d, "part").select(
        F.concat(F.lit("n"), k.cast("string")).alias("node_id"), kind.alias("kind"), F.concat(F.lit("pkg/"), "p_brand", F.lit(".py")).alias("path"), F.concat(F.when(k % 13 == 0, "_").otherwise(""), F.lit("f"), (k % 500).cast("string")).alias("name"),
        (F.col("p_size") % 4).cast("long").alias("inbound"), (k % 3).alias("outbound"), (k % 4).alias("hits"), (k % 5 == 0).alias("preferred"), F.concat("p_brand", F.lit(":"), (k % 500).cast("string")).alias("entrypoint"), F.round("p_retailprice", 2).alias("priority"),
    )


PROBES_SQL = """r AS (SELECT 'n' || p_partkey AS node_id, (['function', 'class', 'module'])[p_partkey % 3 + 1] AS kind, 'pkg/' || p_brand || '.py' AS path, CASE WHEN p_partkey % 13 = 0 THEN '_' ELSE '' END || 'f' || (p_partkey % 500) AS name,
  (p_size % 4)::BIGINT AS inbound, p_partkey % 3 AS outbound, p_partkey % 4 AS hits, p_partkey % 5 = 0 AS preferred, p_brand || ':' || (p_partkey % 500) AS entrypoint, round(p_retailprice, 2) AS priority FROM part)"""


@query(f"""WITH {PROBES_SQL} SELECT node_id, kind, path, name, round(0.5::DOUBLE * inbound + 0.2::DOUBLE * outbound + 2.0::DOUBLE * preferred::INT + 1.0::DOUBLE * (hits = 0)::INT + 0.25::DOUBLE * (kind = 'class')::INT, 3) AS priority
FROM r WHERE kind IN ('function', 'class') AND name NOT LIKE '\\_%' ESCAPE '\\' ORDER BY priority DESC, node_id LIMIT 40""")
def seed_choice(spark, d):
    return ranking.seeds(_probe_rows(spark, d))


@query(f"WITH {PROBES_SQL} SELECT path, entrypoint, priority, row_number() OVER (PARTITION BY path ORDER BY priority DESC, entrypoint)::INT AS rank FROM r QUALIFY rank <= 8")
def path_probes(spark, d):
    return ranking.path_probes(_probe_rows(spark, d))


@query(f"""WITH {PROBES_SQL}, w AS (SELECT *, CASE kind WHEN 'function' THEN 0 WHEN 'class' THEN 1 ELSE 2 END AS o FROM r WHERE (kind = 'function' AND hits = 0 AND inbound + outbound <= 2) OR (kind = 'module' AND inbound + outbound <= 2) OR (kind = 'class' AND hits = 0 AND inbound + outbound <= 1)),
x AS (SELECT *, row_number() OVER (PARTITION BY entrypoint ORDER BY o, priority DESC, kind) AS k FROM w), y AS (SELECT * FROM x WHERE k = 1 ORDER BY o, priority DESC, entrypoint LIMIT 60)
SELECT entrypoint, kind, priority, row_number() OVER (ORDER BY o, priority DESC, entrypoint)::INT AS rank FROM y""")
def forced_probes(spark, d):
    return ranking.forced_probes(_probe_rows(spark, d))


@query("""WITH a AS (SELECT p_brand AS alias, p_partkey AS node_id, p_size * 100000 + p_partkey AS place FROM part UNION ALL SELECT p_type, p_partkey, p_partkey FROM part)
SELECT alias, arg_max(node_id, place) AS node_id FROM a GROUP BY 1""")
def last_alias(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    return resolve.last_alias(p.select(F.col("p_brand").alias("alias"), k.alias("node_id"), (F.col("p_size") * 100000 + k).alias("place")).union(p.select("p_type", k, k)))


@query("""WITH e AS (SELECT DISTINCT o_orderpriority AS origin, o_custkey AS source, o_orderkey % 50 AS target FROM orders), f AS (SELECT DISTINCT o_custkey AS source, o_orderkey % 50 AS target FROM orders WHERE o_orderstatus = 'O'),
b AS (SELECT origin, count(*) AS edges, count(f.source) AS covered FROM e LEFT JOIN f USING (source, target) GROUP BY 1), c AS (SELECT *, round(covered::DOUBLE / edges, 6) AS coverage FROM b)
SELECT origin, edges, covered, coverage, round(greatest(coverage - min(coverage) OVER (), max(coverage) OVER () - coverage), 6) AS divergence FROM c""")
def source_coverage(spark, d):
    o = table(spark, d, "orders")
    e = o.select(F.col("o_orderpriority").alias("origin"), F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 50).alias("target"))
    return resolve.source_coverage(e, o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 50).alias("target")))


@query(f"WITH {RULES_SQL} SELECT sl AS layer, count(*) AS n FROM f GROUP BY 1")
def layer_counts(spark, d):
    return integrity.layer_counts(_path_edges(spark, d).select(F.col("source_path").alias("path")))


@query("""WITH g AS (SELECT DISTINCT 'a/' || p_partkey || '.py' AS path FROM part WHERE p_partkey % 3 > 0), i AS (SELECT DISTINCT 'a/' || p_partkey || '.py' AS path FROM part WHERE p_partkey % 5 > 0)
SELECT path, 'graph' AS side FROM g WHERE path NOT IN (SELECT path FROM i) UNION ALL SELECT path, 'inventory' FROM i WHERE path NOT IN (SELECT path FROM g)""")
def inventory_gaps(spark, d):
    p = table(spark, d, "part")
    path = F.concat(F.lit("./a/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path")
    return integrity.inventory_gaps(p.where("p_partkey % 3 > 0").select(path), p.where("p_partkey % 5 > 0").select(path))


def _gate_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    chain = s.select(k.alias("source"), (F.floor(k / 4) * 4 + (k + 1) % 4).alias("target"), F.when(k % 10 == 0, "").otherwise("import").alias("type"), F.when(k % 6 == 0, "di").when(k % 6 == 1, None).otherwise("ast").alias("origin"), (k % 2).alias("confidence"))
    rows = chain.union(s.where("s_suppkey % 3 = 0").select(k, (F.floor(k / 4) * 4 + (k + 1) % 4), F.lit("import"), F.lit("AST"), F.lit(1).cast("long")))
    text = lambda c: F.col(c).cast("string").alias(c)
    return s.select(k.cast("string").alias("node_id"), (F.floor(k / 3)).cast("string").alias("path")), rows.select(text("source"), text("target"), "type", "origin", "confidence")


GATE_SQL = """n AS (SELECT s_suppkey AS k, s_suppkey // 3 AS path FROM supplier),
e AS (SELECT s_suppkey AS source, s_suppkey // 4 * 4 + (s_suppkey + 1) % 4 AS target, CASE WHEN s_suppkey % 6 = 0 THEN 'DI' WHEN s_suppkey % 6 = 1 THEN '' ELSE 'AST' END AS origin FROM supplier
  UNION ALL SELECT s_suppkey, s_suppkey // 4 * 4 + (s_suppkey + 1) % 4, 'AST' FROM supplier WHERE s_suppkey % 3 = 0)"""


@query(f"""WITH {GATE_SQL}, u AS (SELECT count(*) AS unresolved FROM e WHERE source NOT IN (SELECT k FROM n) OR target NOT IN (SELECT k FROM n)),
x AS (SELECT count(*) AS underived FROM (SELECT source, target, bool_or(origin = 'AST') AS a, bool_or(origin = 'DI') AS b FROM e GROUP BY 1, 2) WHERE b AND NOT a)
SELECT unresolved, underived, CASE WHEN unresolved > 0 THEN 'UNRESOLVED_EDGE_REFERENCE' WHEN underived > 0 THEN 'DI_NOT_DERIVED_FROM_AST' ELSE '' END AS code FROM u, x""")
def edge_gate(spark, d):
    return integrity.edge_gate(*_gate_rows(spark, d))


@query("""WITH c AS (SELECT min(s_suppkey::VARCHAR) AS component, count(*) AS size, bool_or(s_suppkey % 8 = 1) AS entered FROM supplier GROUP BY s_suppkey // 4) SELECT *, component = min(component) OVER () AS "primary" FROM c""")
def graph_parts(spark, d):
    n, e = _gate_rows(spark, d)
    return integrity.components_of(n, e, n.where("node_id % 8 = 1").select("node_id"))


@query("""WITH t AS (SELECT s_suppkey, (['yes', ' TRUE', 'no', 'On', '0', '1', '', 'nan', '12.75', '-inf', '1e3', 'x7'])[s_suppkey % 12 + 1] AS v FROM supplier),
u AS (SELECT *, try_cast(trim(v) AS DOUBLE) AS x FROM t), w AS (SELECT *, CASE WHEN isfinite(x) THEN x END AS y FROM u)
SELECT s_suppkey, lower(trim(v)) IN ('true', 'yes', 'y', 'on', '1') AS flag, coalesce(y, -1.0::DOUBLE) AS number, coalesce(trunc(y)::BIGINT, 7) AS whole FROM w""")
def tolerant_casts(spark, d):
    words = ("yes", " TRUE", "no", "On", "0", "1", "", "nan", "12.75", "-inf", "1e3", "x7")
    v = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("s_suppkey") % 12 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", C.flag(v).alias("flag"), C.number(v, -1.0).alias("number"), C.whole_number(v, 7).alias("whole"))


@query("""WITH j AS (SELECT s_suppkey, '{"a":"' || (s_suppkey % 7) || '","k' || (s_suppkey % 3) || '":"' || s_name || '"}' AS t FROM supplier)
SELECT s_suppkey, t AS json, rtrim(replace(replace(to_base64(t::BLOB), '+', '-'), '/', '_'), '=') AS encoded, sha256(t) AS key FROM j""")
def json_codec(spark, d):
    k = F.col("s_suppkey")
    m = F.create_map(F.concat(F.lit("k"), (k % 3).cast("string")), F.col("s_name"), F.lit("a"), (k % 7).cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", C.sorted_json(m).alias("json"), C.encoded_json(m).alias("encoded"), C.content_key(m).alias("key"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def utc_stamps(spark, d):
    return table(spark, d, "events").select("event_id", C.utc_stamp(F.col("ts")).alias("stamp"))


@query("""WITH m AS (SELECT s_suppkey, s_suppkey % 3 AS x, s_suppkey % 4 AS y FROM supplier)
SELECT s_suppkey, CASE WHEN x = y THEN 'k' || y || '=second' ELSE array_to_string(list_sort(['k' || x || '=first', 'k' || y || '=second']), ',') END AS merged FROM m""")
def map_merge(spark, d):
    k = F.col("s_suppkey")
    one = lambda n, v: F.create_map(F.concat(F.lit("k"), (k % n).cast("string")), F.lit(v))
    entries = F.transform(F.map_entries(C.merged(one(3, "first"), one(4, "second"))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(F.array_sort(entries), ",").alias("merged"))


@query("""WITH p AS (SELECT p_partkey, (['file', 'function', 'class', 'service'])[p_partkey % 4 + 1] AS kind FROM part),
q AS (SELECT p_partkey, kind, CASE WHEN kind IN ('file', 'service') THEN 'src/m' || p_partkey || '.py' ELSE 'src/m' || p_partkey || '.py/run' END AS tail FROM p)
SELECT p_partkey, CASE WHEN kind = 'service' THEN NULL ELSE kind || ':' || CASE WHEN kind = 'file' THEN tail ELSE 'src/m' || p_partkey || '.py:run' END END AS legacy, CASE WHEN kind = 'service' THEN NULL ELSE 'canonical://' || kind || '/' || tail END AS back,
  CASE WHEN kind = 'service' THEN NULL ELSE 'src/m' || p_partkey || '.py' END AS path FROM q""")
def id_forms(spark, d):
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("file", "function", "class", "service")]), (k % 4 + 1).cast("int"))
    named = F.when(kind.isin("file", "service"), "").otherwise("run")
    file = F.concat(F.lit("src/m"), k.cast("string"), F.lit(".py"))
    node, legacy = C.canonical_id(kind, file, named), F.concat_ws(":", kind, file, F.nullif(named, F.lit("")))
    return table(spark, d, "part").select("p_partkey", C.legacy_id(node).alias("legacy"), C.canonical_of(legacy).alias("back"), C.node_path(node).alias("path"))


RAW_IDS = (
    "file:./src/m{k}.py", " Function : a\\b{k}.py : run ", "class:x{k}.py", "canonical://FILE/./././m{k}.py", "canonical://function/a/b{k}.py/run", "canonical://class/only{k}", "canonical://file", "canonical://service/x{k}",
    "plain{k}", "", "function:a:b{k}.py:f", "file:", "canonical://file/ ", "function::f{k}", "canonical://function/./ /f{k}", "CLASS:./y{k}.py:C/D", "class: z{k}.py :",
)


_RAW_IDS = ", ".join(f"'{x}'" for x in RAW_IDS)


@query(f"""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 18 = 17 THEN NULL ELSE replace(([{_RAW_IDS}])[p_partkey % 18 + 1], '{{k}}', p_partkey::VARCHAR) END AS raw FROM part),
t AS (SELECT *, trim(coalesce(raw, '')) AS x, starts_with(trim(coalesce(raw, '')), 'canonical://') AS c FROM r), u AS (SELECT *, CASE WHEN c THEN x[13:] ELSE x END AS rest, CASE WHEN c THEN '/' ELSE ':' END AS sep FROM t),
v AS (SELECT *, instr(rest, sep) AS pos, lower(trim(string_split(rest, sep)[1])) AS kind, trim(rest[instr(rest, sep) + 1:]) AS payload FROM u),
w AS (SELECT *, CASE WHEN kind = 'file' THEN payload WHEN instr(payload, sep) = 0 THEN '' ELSE payload[:length(payload) - length(string_split(payload, sep)[-1]) - 1] END AS p, CASE WHEN instr(payload, sep) > 0 THEN trim(string_split(payload, sep)[-1]) ELSE '' END AS name FROM v),
y AS (SELECT *, regexp_replace(replace(trim(p), '\\', '/'), '^(\\./)+', '') AS path FROM w),
z AS (SELECT *, CASE WHEN x = '' THEN 'blank' WHEN pos = 0 THEN 'no_kind' WHEN kind NOT IN ('file', 'function', 'class') THEN 'unknown_kind' WHEN kind <> 'file' AND name = '' THEN 'no_name' WHEN path = '' THEN 'no_path' ELSE '' END AS reason FROM y)
SELECT p_partkey, CASE WHEN reason = '' THEN CASE WHEN c THEN 'canonical://' ELSE '' END || kind || sep || path || CASE WHEN kind = 'file' THEN '' ELSE sep || name END ELSE '' END AS id, reason FROM z""")
def normalized_ids(spark, d):
    k = F.col("p_partkey")
    raw = F.replace(F.try_element_at(F.array(*[F.lit(x) for x in RAW_IDS]), (k % 18 + 1).cast("int")), F.lit("{k}"), k.cast("string"))
    return table(spark, d, "part").select("p_partkey", C.normalized_id(raw).alias("n")).select("p_partkey", "n.id", "n.reason")


ISSUE_DOMAINS = (*diagnose.CAUSE_KINDS, "other")
ISSUE_TYPES = ("UNREACHABLE_NODES", "MISSING_DI_NODES", "DUPLICATE_NODE_ID", "GRAPH_DI_DRIFT", "SOMETHING_ELSE")


def _choices_sql(column: str, choices: dict, otherwise: str) -> str:
    value = lambda v: repr(v) if isinstance(v, str) else repr(" > ".join(v))
    return f"CASE {column} {' '.join(f'WHEN {k!r} THEN {value(v)}' for k, v in choices.items() if k)} ELSE {otherwise} END"


@query(f"""WITH {EDGES_SQL}, i AS (SELECT event_id AS idx, ({list(ISSUE_DOMAINS)!r})[event_id % 8 + 1] AS domain, ({list(ISSUE_TYPES)!r})[event_id % 5 + 1] AS type, (['HIGH', 'MEDIUM', 'LOW', 'INFO'])[event_id // 8 % 4 + 1] AS severity,
  'Message  of ' || (event_id % 2) AS message, event_id % 9 AS c, CASE WHEN event_id % 3 = 0 THEN 'customer:' || user_id END AS node FROM events),
k AS (SELECT *, lower(trim(regexp_replace(message, '\\s+', ' ', 'g'))) AS key, CASE severity WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.7 WHEN 'LOW' THEN 0.4 ELSE 0.2 END::DOUBLE AS sw FROM i),
dg AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM g UNION ALL SELECT target FROM g) GROUP BY 1), top AS (SELECT max(degree) AS top FROM dg), most AS (SELECT greatest(1, max(c)) AS most FROM i),
im AS (SELECT domain, count(*)::DOUBLE / (SELECT count(*) FROM i) AS impact FROM i GROUP BY 1),
n AS (SELECT domain, type, key, node, row_number() OVER (PARTITION BY domain, type, key ORDER BY min(idx), node) AS r FROM k WHERE node IS NOT NULL GROUP BY domain, type, key, node QUALIFY r <= 25),
s AS (SELECT domain, type, key, count(*) AS seen, string_agg(node, ',' ORDER BY r) AS nodes, round(avg(coalesce(degree, 0)::DOUBLE / top), 3) AS mean FROM n LEFT JOIN dg USING (node), top GROUP BY ALL),
f AS (SELECT domain, type, key, arg_min(message, idx) AS message, max(sw) AS sw, sum(c)::BIGINT AS count FROM k GROUP BY ALL),
x AS (SELECT f.*, coalesce(seen, 0) AS seen, coalesce(nodes, '') AS nodes, round(least(1.0::DOUBLE, sw + impact * 0.25::DOUBLE) * 0.5::DOUBLE + coalesce(mean, 0.3::DOUBLE) * 0.3::DOUBLE
  + round(least(1.0::DOUBLE, greatest(1, count)::DOUBLE / most), 3) * 0.2::DOUBLE, 3) AS severity FROM f LEFT JOIN s USING (domain, type, key) LEFT JOIN im USING (domain), most),
y AS (SELECT *, round(least(1.0::DOUBLE, severity * 0.65::DOUBLE + 0.35::DOUBLE * least(1.0::DOUBLE, least(5, seen) * 0.1::DOUBLE + least(20, count) / 40.0::DOUBLE)), 3) AS confidence FROM x),
z AS (SELECT *, row_number() OVER (ORDER BY severity DESC, confidence DESC, domain, type, message)::INT AS rank FROM y)
SELECT rank, printf('rc-%02d-%s', rank, lower(type)) AS id, {_choices_sql('domain', diagnose.CAUSE_KINDS, "'SEMANTIC'")} AS kind, domain, type, severity, confidence, count, nodes,
  CASE WHEN type IN ('MISSING_DI_NODES', 'GRAPH_DI_DRIFT') THEN {' > '.join(diagnose.PROPAGATION['dependency_consistency'])!r} ELSE {_choices_sql('domain', diagnose.PROPAGATION, repr(' > '.join(diagnose.PROPAGATION[''])))} END AS path,
  {_choices_sql('type', {k: v for k, v in diagnose.ACTIONS.items() if k in ISSUE_TYPES}, 'NULL')} AS action FROM z""")
def diagnostic_causes(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(x) for x in values]), (at + 1).cast("int"))
    issues = e.select(
        k.alias("idx"), pick(ISSUE_DOMAINS, k % 8).alias("domain"), pick(ISSUE_TYPES, k % 5).alias("type"), pick(list(P.SEVERITY_RANK), F.floor(k / 8) % 4).alias("severity"),
        F.concat(F.lit("Message  of "), (k % 2).cast("string")).alias("message"), (k % 9).alias("count"), F.when(k % 3 == 0, _id("customer", "user_id")).alias("node"),
    )
    totals = issues.groupBy("domain").agg(F.count("*").alias("n"))
    impacts = totals.crossJoin(F.broadcast(totals.agg(F.sum("n").alias("all")))).select("domain", (F.col("n") / F.col("all")).alias("impact"))
    return diagnose.causes(issues, edges(spark, d), impacts).withColumns({"nodes": F.array_join("nodes", ","), "path": F.array_join("path", " > ")}).drop("message")


@query("""SELECT s_suppkey, s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 OR s_suppkey % 13 = 0 AS entrypoint FROM supplier""")
def node_flags(spark, d):
    k = F.col("s_suppkey")
    meta = F.when(k % 7 == 0, F.create_map(F.lit("is_entrypoint"), F.lit("Yes"))).otherwise(F.create_map(F.lit("other"), F.lit("1")))
    tags = F.when(k % 11 == 0, F.array(F.lit("x"), F.lit(" EntryPoint"))).otherwise(F.lit(None).cast("array<string>"))
    field, role_ = F.when(k % 5 == 0, True), F.when(k % 13 == 0, "ENTRYPOINT")
    return table(spark, d, "supplier").select("s_suppkey", C.node_flag(("entrypoint", "is_entrypoint"), field, meta, tags, role_).alias("entrypoint"))


@query(f"""WITH {TRACE_SQL}, x AS (SELECT count(DISTINCT event_type) FILTER (event = 'call') AS modules, count(DISTINCT event_type) FILTER (event = 'call' AND event_type <> 'error') AS local_modules, count(DISTINCT node_id) FILTER (event = 'call') AS functions,
  count(DISTINCT node_id) FILTER (event = 'call' AND event_type <> 'error') AS local_functions, coalesce(max(seq % 3) FILTER (event = 'call'), 0) AS max_depth, count(*) FILTER (event = 'call') AS calls, count(*) FILTER (event = 'import') AS imports FROM t)
SELECT *, concat_ws(',', CASE WHEN modules < 5 THEN 'modules_below_5' END, CASE WHEN local_modules < 3 THEN 'local_modules_below_3' END, CASE WHEN functions < 20 THEN 'functions_below_20' END, CASE WHEN local_functions < 3 THEN 'local_functions_below_3' END,
  CASE WHEN max_depth < 3 THEN 'max_depth_below_3' END, CASE WHEN calls <= imports THEN 'calls_not_above_imports' END) AS reasons FROM x""")
def runtime_meaning(spark, d):
    t = trace(spark, d).select("event", "node_id", F.col("event_type").alias("module"), (F.col("event_type") != "error").alias("local"), (F.col("seq") % 3).alias("depth"))
    return report.runtime_meaning(t).withColumn("reasons", F.array_join("reasons", ","))
