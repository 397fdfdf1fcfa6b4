"""Operators on small graphs and traces, against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkwarden.functions import columns as C
from sparkwarden.operators import components, evidence, graph, pairs, ranking, resolve, rules, sequence, similarity, traces


def random_graph(seed, n=24, m=30):
    r = random.Random(seed)
    return list(range(n)), sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})


def frames(spark, nodes, edges):
    return spark.createDataFrame([(i,) for i in nodes], "node_id long"), spark.createDataFrame(edges, "source long, target long")


def closure(nodes, edges):
    out = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for s in out.values():
                if a in s:
                    s.add(b)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_loops(spark, seed):
    nodes, edges = random_graph(seed)
    n, e = frames(spark, nodes, edges)
    reach = closure(nodes, edges)
    got = {r.node_id: r.depth for r in graph.reach(e, n.where("node_id in (0, 1)")).collect()}
    assert set(got) == reach[0] | reach[1] and got[0] == 0
    alive = set(nodes)
    while True:
        left = {b for a, b in edges if a in alive and b in alive}
        if left == alive:
            break
        alive &= left
    assert {r.node_id for r in graph.peel(n, e).collect()} == alive
    strong = {r.node_id: r.component for r in graph.strong_components(n, e).collect()}
    assert strong == {x: min(y for y in nodes if y in reach[x] and x in reach[y]) for x in nodes}
    both = edges + [(b, a) for a, b in edges]
    weak = closure(nodes, both)
    assert {r.node_id: r.component for r in graph.weak_components(n, e).collect()} == {x: min(weak[x]) for x in nodes}


def test_long_chain_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(e).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000}


def test_islands(spark):
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)], "node_id long, component long")
    of = lambda *x: spark.createDataFrame([(i,) for i in x], "node_id long")
    assert {(r.component, r.size, r.kind) for r in graph.islands(c, of(3), of(4)).collect()} == {(1, 2, "orphan_subgraph"), (3, 1, "isolated_module"), (4, 2, "cyclic_island")}


def heat_fixture(spark):
    ids = ["runtime_root", "hot_without_runtime", "call_only", "config_only", "main", "file"]
    nodes = spark.createDataFrame([(i,) for i in ids], "node_id string")
    edges = spark.createDataFrame([("main", "config_only", "CONFIG"), ("main", "call_only", "CALL"), ("main", "hot_without_runtime", "CALL"), ("file", "hot_without_runtime", "IMPORT")], "source string, target string, type string")
    trace = spark.createDataFrame([("runtime_root", "call")], "node_id string, event string")
    return nodes, edges, trace, spark.createDataFrame([("runtime_root",), ("hot_without_runtime",)], "node_id string")


def test_heat_classes(spark):
    rows = {r.node_id: r for r in evidence.heat(*heat_fixture(spark)).collect()}
    got = {k: (r.classification, r.score) for k, r in rows.items()}
    assert got["runtime_root"] == ("HOT", 0.85) and rows["runtime_root"].confidence == 0.675
    assert got["hot_without_runtime"] == ("WARM", 0.4) and rows["hot_without_runtime"].confidence == 0.5
    assert got["call_only"][0] == "COLD" and got["config_only"][0] == "COLD" and got["call_only"][1] == pytest.approx(0.102)
    assert got["main"] == ("DEAD", 0.0) and got["file"] == ("DEAD", 0.0)
    d = evidence.heat_distribution(evidence.heat(*heat_fixture(spark))).first()
    assert (d.hot, d.warm, d.cold, d.dead) == (1, 1, 2, 2)


def test_no_heat_caps_confidence(spark):
    rows = spark.createDataFrame([("a", "COLD", 0.9), ("b", "DEAD", 0.1)], "node_id string, classification string, confidence double")
    assert {r.confidence for r in evidence.cap_confidence(rows).collect()} == {0.45, 0.1}


def test_dead_probability_scales_with_coverage(spark):
    rows = spark.createDataFrame([("a", "DEAD", 0, 0, 0, 0), ("b", "DEAD", 0, 2, 0, 0)], "node_id string, classification string, hits long, inbound long, executable long, non_executable long")
    assert [tuple(r) for r in evidence.dead_candidates(rows, 0.05).collect()] == [("a", 1.0, 0.05)]


def test_edge_status_cascade(spark):
    nodes = spark.createDataFrame([("canonical://a/x",), ("canonical://b/y",)], "node_id string")
    e = [("canonical://a/x", "canonical://b/y", "IMPORT", 1.0), ("canonical://a/x", "canonical://b/y", "import ", 1.0), ("", "z", "DI", 1.0), ("canonical://a/x", "z", "CALL", None), ("canonical://a/x", "z", "DI", None), ("canonical://a/x", "z", "DI", 1.0)]
    got = sorted((r.status, r.cross_namespace) for r in pairs.edge_status(nodes, spark.createDataFrame(e, "source string, target string, type string, confidence double")).collect())
    assert got == [("invalid_type", False), ("malformed", False), ("malformed", False), ("unresolved", False), ("valid", True)]


def test_pair_measures(spark):
    f = lambda *x: spark.createDataFrame(list(x), "source int, target int")
    a, b, none = f((1, 2), (1, 3), (1, 2)), f((1, 3), (2, 2), (2, 3)), f()
    one = pairs.pair_counts(a, b, ["source", "target"]).select("*", pairs.divergence("v2").alias("d"), pairs.overlap().alias("o")).first()
    assert (one.n_a, one.n_b, one.n_both, one.n_either, one.o) == (2, 3, 1, 4, 0.5) and one.d == pytest.approx(0.638)
    empty = pairs.pair_counts(none, none, ["source", "target"]).select(pairs.divergence("v2").alias("d"), pairs.overlap().alias("o")).first()
    assert tuple(empty) == (0.0, 1.0)


def test_resolver_edges_by_profile(spark):
    f = spark.createDataFrame([("a", "b", "ast"), ("a", "b", "AST "), ("a", "c", "odd"), ("", "c", "DI")], "source string, target string, origin string")
    assert {tuple(r) for r in pairs.resolver_edges(f).collect()} == {("a", "b", "AST"), ("a", "c", "UNKNOWN")}
    assert pairs.resolver_edges(f, profile="v1").count() == 1


def test_rules_fire(spark):
    e = spark.createDataFrame([("src/domain/core.py", "src/api/routes.py"), ("app/services/user_service.py", "app/adapters/mail_adapter.py"), ("x/api/users.py", "x/db/store.py"), ("a/one.py", "b/two.py"), ("a/one.py", "b/contracts/c.py")], "source_path string, target_path string")
    got = defaultdict(int)
    for r in rules.violations(e).collect():
        got[r.rule_id] += 1
    assert got["LAYER_DIRECTION_VIOLATION"] >= 1 and got["SERVICE_IMPORTS_ADAPTER"] == 1 and got["DIRECT_STATE_CHANGE_BYPASSES_ORCHESTRATOR"] == 1 and got["OWNERSHIP_BOUNDARY_CROSSING"] == 2
    score = rules.architecture_score(e).first()
    assert score.edges == 5 and 0 <= score.score <= 1


def test_columns(spark):
    row = spark.createDataFrame([(" .\\a\\b\\__init__.py ",)], "p string").select(
        C.normalize_path(F.col("p")).alias("n"), C.module_name(F.col("p")).alias("m"), C.canonical_id(F.lit("function"), F.lit("a/b.py"), F.lit("x/y")).alias("c"),
        C.node_id(F.lit("file"), F.lit("./a.py"), F.lit(None).cast("string")).alias("i"), C.tokens(F.lit("getHTTPServerName2X the_data fooBar")).alias("t"), C.role(F.lit("do_restore")).alias("r"),
    ).first()
    assert (row.n, row.m, row.c, row.i) == ("a/b/__init__.py", "a.b", "canonical://function/a/b.py/x_y", "file:a.py")
    assert row.t == ["get", "httpserver", "name2", "foo", "bar"] and row.r == "persistence"


def test_similar_pairs_are_complete(spark):
    r = random.Random(7)
    sets = {i: sorted(r.sample([f"t{k}" for k in range(40)], r.randint(3, 14))) for i in range(80)}
    sets[80] = sets[3]
    sets[81] = [*sets[4][:-1], "zz"]
    df = spark.createDataFrame(list(sets.items()), "id long, tokens array<string>")
    reps = {}
    for i, t in sets.items():
        reps.setdefault(tuple(t), i)
    want = set()
    for x, a in reps.items():
        for y, b in reps.items():
            both = len(set(x) & set(y))
            if a < b and both >= 4 and both / (len(x) + len(y) - both) >= 0.45:
                want.add((a, b))
    assert {(p.a, p.b) for p in similarity.similar_pairs(df).collect()} == want
    got = {c.id: c.cluster for c in similarity.clusters(df).collect()}
    assert len(got) == len(sets) and got[80] == got[3]


def test_collisions(spark):
    rows = [("AuthService", "a.py"), ("AuthManager", "b.py"), ("AuthRouter", "b.py"), ("MailService", "a.py"), ("auth_helper", "c.py")]
    got = similarity.collisions(spark.createDataFrame(rows, "name string, file string")).collect()
    assert [tuple(r) for r in got] == [("auth", 3, 2)]


def test_workflows(spark):
    steps = [("r1", i, role) for i, role in enumerate(["api", "api", "orchestration", "domain_decision", "side_effect", "persistence"])] + [("r2", 0, "api"), ("r2", 1, "persistence")]
    t = spark.createDataFrame(steps, "run_id string, seq long, role string")
    assert {r.run_id: (r.steps, r.signature) for r in sequence.workflows(t).collect()} == {"r1": (5, "api -> orchestration -> domain_decision -> side_effect -> persistence"), "r2": (2, "api -> persistence")}
    assert {(r.from_role, r.to_role): r.n for r in sequence.transitions(t).collect()}[("api", "persistence")] == 1
    one = sequence.causal_score(t.where("run_id = 'r1'")).first()
    assert (one.coverage, one.direct, one.score) == (0.833, 0, 0.925)
    assert sequence.causal_score(t.limit(0)).first().score == 1.0


def test_resolution(spark):
    calls = [(1, "a.py", "run", None), (2, "a.py", "go", None), (3, "c.py", "go", "b"), (4, "a.py", "none", None), (5, "b.py", "dup", None), (6, "c.py", "go", None), (7, "d.py", "go", None), (8, "d.py", "go", "bb"), (9, "d.py", "go", "zz")]
    calls = spark.createDataFrame(calls, "call_id long, file string, name string, prefix string")
    symbols = spark.createDataFrame([("run", "function", "a.py", "n1"), ("go", "function", "a.py", "n2"), ("go", "function", "b.py", "n3"), ("dup", "class", "x.py", "n4"), ("dup", "function", "y.py", "n5")], "name string, kind string, file string, node_id string")
    imports = [("c.py", "b", "", "b.py"), ("d.py", "pkg.go", "", "a.py"), ("d.py", "b", "bb", "b.py"), ("d.py", "lost", "", None)]
    context = resolve.import_context(spark.createDataFrame(imports, "file string, module string, alias string, path string"))
    got = {r.call_id: r.target for r in resolve.resolve_calls(calls, symbols, context).collect()}
    assert got == {1: "n1", 2: "n2", 3: "n3", 4: None, 5: "n5", 6: None, 7: "n2", 8: "n3", 9: "n2"}
    names = spark.createDataFrame([(1, "a.b.c"), (2, "a.x"), (3, "z")], "id long, name string")
    index = spark.createDataFrame([("a", "a/__init__.py"), ("a.b", "a/b.py")], "module string, path string")
    assert {r.id: r.path for r in resolve.longest_prefix(names, index).collect()} == {1: "a/b.py", 2: "a/__init__.py", 3: None}


def test_issue_collapse(spark):
    rows = [(i, "d", "T", ["LOW", "HIGH"][i % 2], "Some  Message", 2, f"n{i % 40:02d}") for i in range(100)] + [(200, "d", "T", "INFO", "some message", 1, None)]
    got = ranking.collapse_issues(spark.createDataFrame(rows, "idx long, domain string, type string, severity string, message string, count long, node string")).collect()
    assert len(got) == 1 and got[0]["severity"] == "HIGH" and got[0]["count"] == 201 and got[0]["message"] == "Some  Message"
    assert got[0]["nodes"] == [f"n{i:02d}" for i in range(25)]


def test_partitioning_does_not_matter(spark):
    nodes, edges, trace, reach = heat_fixture(spark)
    want = sorted(map(tuple, evidence.heat(nodes, edges, trace, reach).collect()))
    for n in (1, 7):
        assert sorted(map(tuple, evidence.heat(nodes.repartition(n), edges.repartition(n).orderBy(F.desc("type")), trace, reach).collect())) == want


def greedy(rows, limit):
    """The stratified choice as a loop."""
    from sparkwarden import profiles as P

    rows = sorted(rows, key=lambda r: (-r[2], r[0]))
    test = lambda p: p.startswith("tests/") or p.split("/")[-1].startswith("test_")
    if len(rows) <= limit:
        return set(rows)
    out = []
    for c in P.PREFERRED_CATEGORIES:
        best = [r for r in rows if r[1] == c and not test(r[0])]
        if best and len(out) < limit:
            out.append(best[0])
    for r in rows:
        if len(out) >= limit:
            break
        if r in out or (r[1] == "script_file" and sum(x[1] == "script_file" for x in out) >= 2) or (r[1] == "test_file" and len(out) >= 3):
            continue
        out.append(r)
    return set(out)


def test_stratified_choice_is_the_greedy_one(spark):
    r = random.Random(9)
    for limit in (1, 3, 5, 9):
        kinds = ["explicit_config", "main_guard", "script_file", "test_file", "web_router", "unknown"][: r.randint(2, 6)]
        rows = [(("tests/" if k == "test_file" and i % 2 else "") + f"p{i:02d}.py", k, float(r.randint(0, 6))) for i, k in ((i, r.choice(kinds)) for i in range(14))]
        got = {tuple(x) for x in ranking.focused_entrypoints(spark.createDataFrame(rows, "path string, category string, score double"), limit).collect()}
        assert got == greedy(rows, limit)


def test_graph_loops_go_as_deep_as_the_graph(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_ROUNDS", 4)
    nodes = list(range(18))
    chain = [(i, i + 1) for i in range(8)]
    ring = [(i, i + 1) for i in range(9, 17)] + [(17, 9)]
    n, e = frames(spark, nodes, chain + ring)
    got = {r.node_id: r.depth for r in graph.reach(e, n.where("node_id in (0, 9)")).collect()}
    assert got == {i: i if i < 9 else i - 9 for i in nodes}
    assert {r.node_id for r in graph.peel(n, e).collect()} == set(range(9, 18))
    strong = {r.node_id: r.component for r in graph.strong_components(n, e).collect()}
    assert strong == {i: i if i < 9 else 9 for i in nodes}


def test_equal_sets_stay_in_the_result(spark):
    names = {"a": "pqrst", "b": "tsrqp", "c": "pqrstu", "d": "vwxyz", "e": "zyxwv", "f": "12345"}
    symbols = spark.createDataFrame([(f, n) for f, x in names.items() for n in x], "file string, name string")
    assert {(r.a, r.b) for r in traces.shared_names(symbols).collect()} == {("a", "c")}
    got = {tuple(r) for r in traces.shared_name_members(symbols).collect()}
    assert got == {("a", "a", 2, 1), ("b", "a", 2, 1), ("c", "c", 1, 1), ("d", "d", 2, 0), ("e", "d", 2, 0), ("f", "f", 1, 0)}


def deep_graph(seed):
    """Chains, trees, rings with tails, ladders, self-loops and parallel ways."""
    r = random.Random(seed)
    edges = [(i, i + 1) for i in range(30)] + [(40 + i, 40 + (i + 1) % 12) for i in range(12)] + [(45, 60), (60, 61), (61, 62), (70, 70), (70, 71), (71, 72)]
    edges += [(80, 81), (80, 82), (81, 83), (82, 83), (83, 84), (84, 85), (84, 86), (85, 87), (86, 87), (87, 88), (0, 80)]
    edges += [(100 + max(0, i - r.randint(0, 2)), 101 + i) for i in range(40)] + [(100 + max(0, i - 1), 101 + i) for i in range(0, 40, 3)]
    edges += [(r.randrange(140), r.randrange(140)) for _ in range(r.choice([0, 6]))]
    return list(range(142)), sorted(set(edges))


@pytest.mark.parametrize("seed", [1, 2])
def test_contraction_changes_no_depth(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "PLAIN_ROUNDS", 1 + seed % 2)
    nodes, edges = deep_graph(seed)
    n, e = frames(spark, nodes, edges)
    depth, frontier = {0: 0, 101: 0}, [0, 101]
    for x in frontier:
        for a, b in edges:
            if a == x and b not in depth:
                depth[b] = depth[a] + 1
                frontier.append(b)
    assert {r.node_id: r.depth for r in graph.reach(e, n.where("node_id in (0, 101)")).collect()} == depth
    alive = set(nodes)
    while (left := {b for a, b in edges if a in alive and b in alive}) != alive:
        alive &= left
    assert {r.node_id for r in graph.peel(n, e).collect()} == alive
    strict = [(a, b) for a, b in edges if a != b]
    endless = set(nodes)
    while (left := {b for a, b in strict if a in endless and b in endless}) != endless:
        endless &= left
    longest = dict.fromkeys(nodes, 0)
    for _ in nodes:
        for a, b in strict:
            if b not in endless:
                longest[b] = max(longest[b], longest[a] + 1)
    assert {r.node_id: r.depth for r in graph.longest_path(n, e).collect()} == longest | dict.fromkeys(endless, len(nodes))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "counted", lambda df, name, _real=graph.counted, **f: rounds.append(name) or _real(df, name, **f))
    size = 100_000
    e = spark.range(size).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    got = graph.reach(e, spark.createDataFrame([(0,)], "node_id long"))
    assert got.agg(F.count("*"), F.count_if(F.col("node_id") == F.col("depth"))).first() == (size + 1, size + 1)
    assert rounds.count("followers") <= 19 and len(rounds) <= 30


def simple_cycles(edges, longest):
    out = set()

    def go(path):
        for a, b in edges:
            if a == path[-1]:
                if b == path[0]:
                    out.add(tuple(path))
                elif b > path[0] and b not in path and len(path) < longest:
                    go([*path, b])

    for x in {a for a, _ in edges}:
        go([x])
    return out


@pytest.mark.parametrize("seed, longest", [(1, 8), (2, 3)])
def test_cycles_in_canonical_rotation(spark, seed, longest):
    r = random.Random(seed)
    edges = sorted({(r.randrange(14), r.randrange(14)) for _ in range(30)})
    e = frames(spark, list(range(14)), edges)[1]
    got = [(tuple(x.cycle), x.size) for x in graph.cycles(e, longest).collect()]
    assert len(got) == len(set(got)) and set(got) == {(c, len(c)) for c in simple_cycles(edges, longest)}


def test_similar_pairs_leave_tasks_only_when_similar(spark, monkeypatch):
    """Sets of few frequent tokens, in chunks that are cut small: every similar pair once, as by
    brute force, and no exchange of the plan carries candidates."""
    import itertools
    import random

    from sparkwarden.operators import similarity

    monkeypatch.setattr(similarity, "CHUNK_SETS", 60)
    draw = random.Random(7)
    sets = {i: frozenset(draw.sample([f"t{k}" for k in range(30)], draw.randint(3, 14))) for i in range(400)}
    given = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id long, tokens array<string>")
    got = similarity.similar_pairs(given, 0.5, 4)
    least: dict = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    want = set()
    for (x, a), (y, b) in itertools.combinations([(x, i) for x, i in least.items() if len(x) >= 4], 2):
        if len(x & y) >= 4 and len(x & y) / len(x | y) >= 0.5:
            want.add((min(a, b), max(a, b), len(x & y), len(x & y) / len(x | y)))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) > 20 and set(rows) == want
    # One exchange, of the sets: before, a second one carried the met pairs.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert similarity.similar_pairs(given.limit(0)).count() == 0


def test_shared_names_of_few_common_names(spark):
    """Many files with half of twenty names each: links as by brute force, and the counts take
    the pairs as they are found, without an exchange that carries them or a join of their names."""
    import random
    from itertools import combinations

    draw = random.Random(3)
    names = {i: frozenset(draw.sample(range(20), draw.randint(5, 12))) for i in range(300)}
    got = traces.shared_name_members(spark.createDataFrame([(i, f"n{k}") for i, x in names.items() for k in x], "file long, name string"))
    least = {}
    for i, x in names.items():
        least.setdefault(x, i)
    links = dict.fromkeys(least, 0)
    for x, y in combinations(least, 2):
        if len(x & y) >= 5 and len(x & y) / len(x | y) >= 0.6:
            links[x] += 1
            links[y] += 1
    assert {(r.id, r.rep, r.links) for r in got.collect()} == {(i, least[x], links[x]) for i, x in names.items()} and any(links.values())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and plan.count("MapInArrow") == 1


def test_deep_graph_loops_keep_few_links(spark, monkeypatch):
    """Most links come from nodes that nothing leads to: they are read, but no round stores them
    (or the depths of all nodes) again."""
    written = []

    def counting(df, name, **figures):
        out, seen = counted(df, name, **figures)
        written.append(out.count())
        return out, seen

    counted, stored = graph.counted, graph.stored
    monkeypatch.setattr(graph, "counted", counting)
    monkeypatch.setattr(graph, "stored", lambda df, name: (written.append((out := stored(df, name)).count()), out)[1])
    links = [(100 + i, i % 3) for i in range(300)] + [(0, 3), (1, 3), (3, 4), (900, 4)]
    e = spark.createDataFrame(links, "source long, target long")
    n = spark.createDataFrame([(i,) for i in [*range(5), *range(100, 400)]], "node_id long")
    got = {r.node_id: r.depth for r in graph.longest_path(n, e).collect()}
    assert got == dict.fromkeys(range(100, 400), 0) | {0: 1, 1: 1, 2: 1, 3: 2, 4: 3}
    assert sum(written) < 400
    written.clear()
    got = {r.node_id: r.depth for r in graph.reach(e, n.where("node_id = 100"), n).collect()}
    assert got == {100: 0, 0: 1, 3: 2, 4: 3} and sum(written) < 50


def test_edges_are_not_dealt_out_for_their_ends(spark):
    """Edges of which few ends are unknown are judged without a join that shuffles them."""
    n = spark.createDataFrame([("a",), (" b ",), (None,)], "node_id string")
    e = spark.createDataFrame([("a", "b", "import", 1.0), ("a", "x", "import", 1.0), ("y", "b", "di", 1.0), (None, "b", "di", 1.0), ("b", " a", "import", None)], "source string, target string, type string, confidence double")
    got = pairs.edge_status(n, e)
    assert {(r.source, r.target, r.status) for r in got.collect()} == {("a", "b", "valid"), ("a", "x", "unresolved"), ("y", "b", "unresolved"), ("", "b", "malformed"), ("b", "a", "malformed")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == plan.count("strategy=broadcast") == 2
    assert {r.status for r in pairs.edge_status(n, e.limit(1)).collect()} == {"valid"}
