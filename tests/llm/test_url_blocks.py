"""Contexts that the tasks have no room for still count in every URL's score."""

import random

import pytest

from sparkwarden.llm import url_filter as U


def _pages(n):
    r = random.Random(3)
    hosts = ["alpha.example", "beta.example", "gamma", "delta.shop", "m.epsilon"]
    return [f"http{r.choice(['', 's'])}://{r.choice(hosts)}.{r.choice(['com', 'net', 'org', 'com'])}/{r.choice(['en', 'de', 'fr', 'es'])}/{r.choice(['', 'é', 'x\n'])}{r.randint(1, 999)}" for _ in range(n)]


@pytest.mark.parametrize("block", [700, 1 << 19])
def test_scores_do_not_depend_on_the_room_for_counts(spark, monkeypatch, block):
    """With room for one byte of context, or three, the scores and verdicts are those of all five,
    over many blocks and with one, with null and repeated rows and ids."""
    monkeypatch.setattr(U, "BLOCK_BYTES", block)
    rows = [*enumerate(_pages(300)), (None, "http://a.org/1"), (3, "http://a.org/1"), (3, "http://a.org/1"), (2**60 + 1, None), (None, None), (7, "")]
    df = spark.createDataFrame([(i, u, "<html>", 1.0) for i, u in rows], "page_id long, url string, html string, score double")
    got = []
    for most in (U.MAX_GRAMS, 3_000, 1):
        monkeypatch.setattr(U, "MAX_GRAMS", most)
        got.append(sorted((tuple(r) for r in U.url_filter(df).collect()), key=repr))
    assert len(got[0]) == len(rows) and {r[4] for r in got[0] if r[3] is None} == {"allow", "block"}
    for few in got[1:]:
        assert [r[:5] for r in few] == [r[:5] for r in got[0]]
        assert [r[5] for r in few] == pytest.approx([r[5] for r in got[0]], abs=1e-12)
