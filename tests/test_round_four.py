"""Findings of the fourth round, against plain Python."""

import collections
import itertools
import random

import pyarrow as pa
from pyspark.sql import functions as F

from sparkwarden.operators import pairs, similarity, tables
from sparkwarden.plans import legacy


def _brute_links(names, min_shared, likeness):
    least = {}
    for i, x in sorted(names.items()):
        least.setdefault(x, i)
    return {(a, b, len(x & y)) for (x, a), (y, b) in itertools.combinations(sorted(least.items(), key=lambda e: e[1]), 2) if len(x & y) >= min_shared and len(x & y) / len(x | y) >= likeness}, least


def _alike(names, likeness):
    return [(a, b) for (a, x), (b, y) in itertools.combinations(names.items(), 2) if len(x & y) >= 5 and len(x & y) / len(x | y) >= likeness]


def test_linked_members_send_counts_only(spark, monkeypatch):
    """Nearly all of 400 files are alike in pairs: a row a file and cell leaves the tasks, not one
    a pair, over several chunks too."""
    monkeypatch.setattr(similarity, "CHUNK_SETS", 90)
    draw = random.Random(5)
    names = {i: frozenset(draw.sample(range(40), draw.randint(28, 36))) for i in range(400)}
    given = spark.createDataFrame([(i, sorted(map(str, x))) for i, x in names.items()], "id long, tokens array<string>")
    _, classes = similarity.set_classes(given, 5)
    counts = similarity._met_by_cells(classes, 0.6, 5, True)
    want, least = _brute_links(names, 5, 0.6)
    assert len(want) > 20_000 and counts.count() < 8_000
    links = collections.Counter(e for a, b, _ in want for e in (a, b))
    got = {(r.id, r.rep, r.links) for r in similarity.linked_members(given, 0.6, 5).collect()}
    assert got == {(i, least[x], links[least[x]]) for i, x in names.items()}


def test_small_vocabularies_are_compared_as_bits(spark):
    """Sets over 20 and over 90 (three words of bits) tokens: every pair as by brute force, and
    none set by set."""
    draw = random.Random(6)
    for size, low, high in ((20, 5, 14), (90, 30, 60)):
        names = {i: frozenset(draw.sample(range(size), draw.randint(low, high))) for i in range(700)}
        given = spark.createDataFrame([(i, sorted(map(str, x))) for i, x in names.items()], "id long, tokens array<string>")
        want, _ = _brute_links(names, 5, 0.5)
        got = [tuple(r) for r in similarity.similar_pairs(given, 0.5, 5).select("a", "b", "shared").collect()]
        assert len(got) == len(want) > 100 and set(got) == want
        ids = [sorted(x) for x in names.values()]
        batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array([len(x) for x in ids], pa.int32()), pa.array(ids, pa.list_(pa.int32()))], ["rep", "size", "ids"])
        held = similarity._Held([batch])
        assert held.dense and sum(len(a) for a, _, _ in held.like(batch, 0.5, 5, 0)) == len(_alike(names, 0.5))


def test_names_are_taken_apart_once(spark):
    """The words of a name are in the plan of collisions once, and not within a condition on every
    word; the same name in the same file goes through it once."""
    rows = [("OrderRouter", "a"), ("orderService", "b"), ("Order_Manager", "b"), ("Order", "c"), ("Service", "c"), (None, "d")] * 3
    got = similarity.collisions(spark.createDataFrame(rows, "name string, file string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    assert [tuple(r) for r in got.collect()] == [("order", 3, 2)]


def test_ends_of_faulty_edges_are_not_looked_up(spark, monkeypatch):
    """Of an edge without a type, or of none that is allowed, no end is counted as unknown."""
    seen = []
    monkeypatch.setattr(pairs, "counted", lambda df, name, **f: (lambda out: (seen.append(out[1]["n"]), out)[1])(tables.counted(df, name, **f)))
    n = spark.createDataFrame([("a",), ("b",)], "node_id string")
    e = spark.createDataFrame([("a", "b", "IMPORT"), ("a", "x", "DI"), ("y", "z", "CALL"), ("u", "v", "")], "source string, target string, type string").withColumn("confidence", F.lit(1.0))
    assert sorted(r.status for r in pairs.edge_status(n, e).collect()) == ["invalid_type", "malformed", "unresolved", "valid"] and seen == [1]
    bad = e.withColumn("type", F.when(F.col("type") == "CALL", "odd").otherwise(F.col("type"))).withColumn("origin", F.lit("AST"))
    assert sorted(r.status for r in legacy.judged_edges(n, bad).collect()) == ["invalid_type", "malformed", "unresolved", "valid"] and seen == [1, 1]
