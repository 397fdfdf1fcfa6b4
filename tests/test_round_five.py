"""Findings of the fifth round, against plain Python."""

import collections
import random

from sparkwarden import queries
from sparkwarden.operators import graph, pairs, tables, traces


def test_edges_that_stand_for_nothing_are_not_judged(spark, monkeypatch):
    """Of calls without an origin no end is looked up: only the end x of an injected edge is
    unknown.  What stands for resolver edges is counted as before, once for equal edges."""
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    e = [("a", "b", "IMPORT", "ast"), (" a", "b ", "import", "AST "), ("a", "b", "CALL", None), ("a", "y", "CALL", None), ("z", "b", "USES", ""), ("b", "c", " di", None), ("a", "x", "DI", None), ("b", "c", "HEURISTIC", "CONFIG"), ("a", "v", "", "AST"), ("a", "w", "odd", "DI")]
    r = [("a", "b", "ast"), ("a", "c", "DI"), ("b", "q", "di "), ("b", "c", "CONFIG"), ("b", "c", "other")]
    given = n, spark.createDataFrame(e, "source string, target string, type string, origin string"), spark.createDataFrame(r, "source string, target string, origin string")
    monkeypatch.setattr(queries, "_legacy_tables", lambda *_: given)
    seen = []
    monkeypatch.setattr(pairs, "counted", lambda df, name, **f: (lambda out: (seen.append(out[1]["n"]), out)[1])(tables.counted(df, name, **f)))
    got = queries.legacy_dependency(spark, "").first().asDict()
    assert seen == [1]
    assert {k: v for k, v in got.items() if k.endswith("_represented")} == {"ast_represented": 1, "di_represented": 1, "config_represented": 1, "heuristic_represented": 1}
    assert (got["resolver_edges"], got["inferred"], got["apart"], got["di_nodes"], got["missing_di"]) == (4, 2, 3, 4, 1)


def _best_targets(calls, k):
    links = {(a, b) for a, b, t in calls if t == "CALL"}
    out = collections.Counter(a for a, _ in links)
    groups = collections.defaultdict(list)
    for a, b in links:
        groups[a].append((-out[b], b))
    return {(a, b, i) for a, found in groups.items() for i, (_, b) in enumerate(sorted(found)[:k], 1)}


def test_calls_are_cut_before_they_are_dealt_out(spark, monkeypatch):
    """Ranks with repeated calls, with and without targets that call something, with sources of
    very many calls; where no target calls anything, nothing is joined, and the rows are cut
    before their only exchange."""
    draw = random.Random(7)
    flat = [(f"s{draw.randint(0, 20)}", f"t{draw.randint(0, 60)}", draw.choice(["CALL", "CALL", "IMPORT"])) for _ in range(900)] + [("s1", "t1", "CALL")] * 50
    deep = flat + [(f"t{draw.randint(0, 9)}", f"t{draw.randint(0, 60)}", "CALL") for _ in range(80)]
    for many, few in ((100_000, 100_000), (40, 100_000), (100_000, 0)):
        monkeypatch.setattr(traces, "MANY_CALLS", many)
        monkeypatch.setattr(traces, "FEW", few)
        for calls in (flat, deep):
            got = traces.neighbours(spark.createDataFrame(calls, "source string, target string, type string"), 8)
            rows = [tuple(r) for r in got.collect()]
            assert len(rows) == len(set(rows)) and set(rows) == _best_targets(calls, 8)
            if calls is flat and many > 40:
                plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
                assert "Join" not in plan and plan.count("Exchange") == 1 and plan.count("WindowGroupLimit") == 2


def test_cycles_take_few_rounds(spark, monkeypatch):
    """Chains of cycles of three in a tree, as in the query: no component is looked for."""
    monkeypatch.setattr(graph, "strong_components", None)
    e = {(k, k // 2) for k in range(2, 600)} | {(k // 4, k) for k in range(65, 600, 64)}
    got = [tuple(r.cycle) for r in graph.cycles(spark.createDataFrame(sorted(e), "source long, target long")).collect()]
    assert sorted(got) == [(16 * j, 64 * j + 1, 32 * j) for j in range(1, 10)]


def test_cycles_of_graphs_with_many_ways(spark, monkeypatch):
    """Where the ways are too many, strong components are looked for first: the same cycles."""
    draw = random.Random(8)
    e = spark.createDataFrame(sorted({(draw.randint(0, 11), draw.randint(0, 11)) for _ in range(40)}), "source long, target long")
    rows = lambda longest: sorted(tuple(r.cycle) for r in graph.cycles(e, longest).collect())
    plain = rows(5)
    asked, found = [], graph.strong_components
    monkeypatch.setattr(graph, "strong_components", lambda *a: (asked.append(1), found(*a))[1])
    monkeypatch.setattr(graph, "FEW_WAYS", 0)
    monkeypatch.setattr(graph, "WAYS_PER_LINK", 1)
    assert rows(5) == plain and len(set(plain)) == len(plain) > 20 and asked
