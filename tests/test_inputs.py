"""Readers that no input stops: odd JSON lines, sources that the parser refuses, odd keys."""

import json
import random

import pytest

from sparkwarden.operators import similarity
from sparkwarden.plans import diagnose
from sparkwarden.sources import pyast, scan

LINES = [
    '{"a": 1, "b": "x"}', "{}", '{"z": 3}', '{"a": null, "b": null}', '[{"a": 5}]', '{"a": 1, "a": 2}', '{"a": "text", "b": 7}', "", "  ", '  {"b": {"c": [1, null]}}', "{'a': 1}",
    '{"a": 1} x', '{"a": 1}{"a": 2}', '{"a": 3}, {"a": 4}', '{"a": 1', '{"a": 1,}', "5", "null", '"x"', "[]", "broken",
]


def test_json_lines_keep_every_object(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(LINES))
    got = [tuple(r) for r in scan.read_json_lines(spark, f"file://{tmp_path}/x.jsonl", "a int, b string").collect()]
    assert sorted(got, key=repr) == sorted([(1, "x"), (None, None), (None, None), (None, None), (2, None), (None, "7"), (None, '{"c":[1,null]}')], key=repr)
    assert scan.read_json_lines(spark, f"file://{tmp_path}/x.jsonl", "a int, b string").columns == ["a", "b"]


HEAD = b"""import os, sys as s
from .a import (b as c,
    d)
@wrap(1)
class K(base()):
    async def m(self, x=default()):
        y = s.go(open('cfg.json'), 1); z = (s.open("other.txt"), f"{q()}")
        def inner(): return g()

if __name__ == '__main__':
    f()
"""


@pytest.mark.parametrize("deep", [b"x = " + b"-" * 100_000 + b"1\n", b"y = " + b"+".join([b"1"] * 100_000) + b"\n", b"z = a" + b".b" * 100_000 + b"\n"])
def test_deep_sources_give_the_same_facts(deep):
    text = HEAD.replace(b'f"{q()}"', b"q()")
    for facts in (pyast._module_facts, pyast._tree_facts):
        plain, got = facts(text), facts(text + deep)
        assert plain.pop("ast_error") == "" and got.pop("ast_error") == "too_deep"
        assert got == plain


def test_one_deep_source_does_not_stop_a_scan(spark):
    rows = [("a.py", b"import os\n"), ("deep.py", b"import sys\nx = " + b"-" * 100_000 + b"1\n"), ("odd.py", b"def f(:\n"), ("guard.py", b"if " + b"(" * 90 + b"__name__ == '__main__'" + b")" * 90 + b": pass\n")]
    files = spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, size long, content binary")
    got = {r.path: (r.imports, r.ast_error) for r in scan.build_manifest(files).collect()}
    assert got["a.py"] == (["os"], "") and got["deep.py"] == (["sys"], "too_deep") and got["odd.py"][1].startswith("syntax_error:1:")
    assert {r.file_path for r in pyast.analyze(files).collect()} == {p for p, _ in rows}
    assert pyast._module_facts(rows[3][1])["main_guard"]


def test_keys_with_dots_and_quotes_stay_apart(spark):
    leaves = lambda x: diagnose.json_leaves(spark.createDataFrame([(1, x)], "id long, json string"))
    changed = lambda x, y, *m: {r.path: (r.left, r.right) for r in diagnose.differences(leaves(x), leaves(y), m).collect()}
    assert changed('{"a.b": 1, "a": {"b": 2}}', '{"a.b": 2, "a": {"b": 2}}') == {"$['a.b']": ("1", "2")}
    assert changed('{"a": {"0": 1}}', '{"a": [1]}') == {"$['a']['0']": ("1", None), "$['a'][0]": (None, "1")}
    assert changed('{"x\']": 1, "y\\\\": 2}', '{"x\']": 2, "y\\\\": 2}') == {"$['x\\']']": ("1", "2")}
    assert changed('{"a": 1, "a": 2}', '{"a": 2}') == {} and changed('{"a": null}', "{}") == {"$": (None, "{}"), "$['a']": ("null", None)}
    assert changed('{"at": [{"b": 1}], "a.at": 1}', '{"at": [{"b": 2}], "a.at": 2}', "b") == {"$['a.at']": ("1", "2")}
    whole = diagnose.json_leaves(spark.createDataFrame([(1, json.dumps({"a": [1, {"b": 2}]}))], "id long, json string"), whole_lists=True)
    assert [(r.path, json.loads(r.value)) for r in whole.collect()] == [("$['a']", [1, {"b": 2}])]


def test_kind_of_abstraction_stands_anywhere(spark):
    names = ["PaymentServiceFactory", "PaymentRouterFactory", "PaymentStoreFactory", "PaymentEngineFactory"]
    rows = [(n, f"{i}.py") for i, n in enumerate(names)] + [("ServiceMailService", "a.py"), ("mail_router", "b.py"), ("MailMailStore", "c.py"), ("one_two_big_four_store", "a.py"), ("OneTwoBigFiveRouter", "b.py"), ("one_big", "c.py"), ("Service", "a.py"), ("OneTwoBigManagerSix", "b.py")]
    got = {tuple(r) for r in similarity.collisions(spark.createDataFrame(rows, "name string, file string")).collect()}
    assert got == {("payment_factory", 4, 4), ("mail", 3, 3), ("one_two_big", 3, 2)}


@pytest.mark.parametrize("t, least", [(0.3, 1), (0.45, 4), (0.8, 2), (0.95, 1)])
def test_similar_sets_at_any_likeness(spark, t, least):
    """Sizes far apart and equal, copies, sets below the least size, tokens that all have."""
    r = random.Random(int(100 * t))
    base = [[f"t{k}" for k in r.sample(range(60), n)] for n in (3, 5, 8, 20, 40)]
    sets = {}
    for i in range(120):
        b = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            b[r.randrange(len(b))] = f"t{r.randint(0, 70)}"
        sets[i] = sorted({*b, *(["all"] if r.random() < 0.8 else [])})[: r.choice([100, 100, 12])]
    sets |= {200: [], 201: ["all"], 202: sets[0], 203: sets[0][::-1]}
    df = spark.createDataFrame(list(sets.items()), "id long, tokens array<string>")
    reps = {}
    for i, s in sorted(sets.items()):
        if len(s) >= least:
            reps.setdefault(frozenset(s), i)
    want = {(a, b): n for x, a in reps.items() for y, b in reps.items() if a < b and (n := len(x & y)) >= least and n / len(x | y) >= t}
    pairs, members = similarity.similar_sets(df, t, least)
    assert {(p.a, p.b): p.shared for p in pairs.collect()} == want
    assert {m.id: m.rep for m in members.collect()} == {i: reps[frozenset(s)] for i, s in sets.items() if len(s) >= least}
