"""Findings of the fourth round in the training-data operators."""

import math

import numpy as np
from pyspark.sql import functions as F

from sparkwarden.llm import toxicity as T
from sparkwarden.llm import url_filter as U


def test_url_models_count_every_labelled_url(spark, monkeypatch):
    """Over 4,000 URLs of a verdict, and long ones, are all counted; a smaller bound on counts
    shortens contexts and leaves no URL out."""
    urls = spark.range(10_000).select(F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"), F.when(F.col("id") % 2 == 0, "allow").otherwise("block").alias("verdict"))
    urls = urls.union(spark.range(1).select(F.concat(F.lit("http://h/"), F.repeat(F.lit("x"), 3000)), F.lit("allow")))
    learnt = {v: [r["url"] for r in U.labelled_sample(urls).where((F.col("verdict") == v) & ~F.col("calibration")).collect()] for v in ("allow", "block")}
    assert min(map(len, learnt.values())) > 3_500
    for most in (U.MAX_GRAMS, 1_000):
        monkeypatch.setattr(U, "MAX_GRAMS", most)
        judge = U.fit(urls)
        for v, model in (("allow", judge.accepted), ("block", judge.rejected)):
            assert model.contexts[b""][0] == sum(len(u) + 1 for u in learnt[v])
        longest = max(map(len, judge.accepted.contexts))
        assert longest == U.ORDER if most > 1_000 else longest < U.ORDER
        assert math.isfinite(judge.threshold)


def test_cut_over_bins_is_that_over_scores():
    r = np.random.default_rng(4)
    for _ in range(20):
        s, y = r.normal(size=60).round(2), r.random(60) < 0.4
        low = np.unique(s)
        bins = [np.array([(y[s == x] == v).sum() for x in low], float) for v in (True, False)]
        assert U.best_cut(low, low, *bins) == U.calibrated(s, y)
    assert U.best_cut(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0)) == math.inf


def test_vectors_sort_by_bytes_as_by_tuples():
    r = np.random.default_rng(8)
    rows = [(np.sort(r.choice(300, n, replace=False)), r.integers(0, 4, n) / 4) for n in r.integers(0, 4, 300)]
    rows += [(t, v[::-1]) for t, v in rows]
    by = lambda key: [(t.tolist(), v.tolist()) for t, v in sorted(rows, key=key)]
    assert by(lambda x: T.in_order(*x)) == by(lambda x: (tuple(x[0].tolist()), tuple(x[1].tolist())))
