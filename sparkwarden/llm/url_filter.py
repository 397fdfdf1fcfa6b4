"""URL filter: rules by host and path, and for the rest a ratio of two character models.

Two variable-order Markov models over the UTF-8 bytes of a URL, one of URLs that rules
accept and one of those they reject, give the log-likelihood of every byte from the longest
context that the model has seen, smoothed with all shorter ones (Witten and Bell 1991).  A URL
is blocked if the difference of the two log-likelihoods, divided by the number of bytes, is
above a threshold that is calibrated on labelled URLs that the models have not learnt from.

The models learn from all distinct URLs that rules judge, and the threshold counts all that are
kept for it.  N-grams are counted by Spark, and of the counts the orders that ``MAX_GRAMS`` has
room for are sent to the tasks.  Longer contexts stay in a table: URLs are dealt to blocks, and a
block gets the ratios of those of its own contexts that the table has, so every score is that of
the whole models.  Every URL is judged on its own: while all counts have room, only the labelled
URLs are shuffled, to be distinct; no hot host.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import dealt, forget, ship, stored

#: (verdict, rule): a rule is a host and the beginning of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Bytes of the longest context.
ORDER = 5
#: One in CALIBRATION of the labelled URLs, by hash, serves the threshold instead of the models.
CALIBRATION = 4
#: Counts that a task holds at most (contexts of one byte have 132,000 at most); those of longer
#: contexts are joined.
MAX_GRAMS = 400_000
#: Bytes of a block of URLs, which has as many contexts at most.
BLOCK_BYTES = 1 << 19
#: Parts of one that a score is rounded to where scores are counted for the threshold.
STEPS = 4096
#: Bytes and the end of a URL.
ALPHABET = 257
#: Kept log-ratios of a worker.
KEPT = 1 << 18


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for
    null and where there is no ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A(?:(?!://).)*+://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What stands after the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A(?:(?!://).)*+://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (null where none fits); of equally long ones
    the first in order.  A rule fits its host and all hosts below it."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The longest is asked first, so it is wrapped around last.
    for what, text in sorted(rules, key=lambda x: (-len(x[1]), x[1]), reverse=True):
        at, slash, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


@dataclass
class Markov:
    """Contexts of up to ORDER bytes -> (occurrences, distinct followers, followers)."""

    contexts: dict[bytes, tuple[int, int, dict[int, int]]] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: list[tuple[bytes, int, int]]) -> Markov:
        """From (context, next byte, how often)."""
        followers: dict[bytes, dict[int, int]] = {}
        for context, c, n in counts:
            followers.setdefault(context, {})[c] = n
        return cls({x: (sum(f.values()), len(f), f) for x, f in followers.items()})

    def probability(self, context: bytes, c: int) -> float:
        """Of c after the context: each order's counts beside the estimate of the next shorter
        one, which weighs as much as there are distinct followers."""
        p = 1 / ALPHABET
        for k in range(len(context) + 1):
            seen = self.contexts.get(context[len(context) - k :])
            if seen is None:
                break
            n, distinct, followers = seen
            p = (followers.get(c, 0) + distinct * p) / (n + distinct)
        return p


@dataclass
class Judge:
    """Both models and the threshold; without URLs of a verdict nothing is blocked."""

    accepted: Markov
    rejected: Markov
    threshold: float = math.inf
    kept: dict[tuple[bytes, int], float] = field(default_factory=dict)
    #: Ratios of contexts that are longer than the models hold.
    longer: dict[tuple[bytes, int], float] = field(default_factory=dict)

    def both(self, context: bytes, c: int) -> tuple[float, float]:
        """The probabilities of c after the context among rejected and accepted URLs."""
        return self.rejected.probability(context, c), self.accepted.probability(context, c)

    def score(self, url: str | None) -> float:
        """(log P(url | rejected) - log P(url | accepted)) / symbols, the end being one."""
        symbols = [*(text := (url or "").encode("utf-8", "replace")), ALPHABET - 1]
        total, kept, longer = 0.0, self.kept, self.longer
        for i, c in enumerate(symbols):
            key = (text[max(0, i - ORDER) : i], c)
            ratio = longer.get(key)
            if ratio is None:
                ratio = kept.get(key)
            if ratio is None:
                rejected, accepted = self.both(*key)
                ratio = math.log(rejected) - math.log(accepted)
                if len(kept) >= KEPT:
                    kept.clear()
                kept[key] = ratio
            total += ratio
        return total / len(symbols)


def calibrated(scores: np.ndarray, rejected: np.ndarray) -> float:
    """The threshold with the least sum of both classes' shares of errors, midway between the
    scores it parts; of equally good ones the nearest to 0.  Infinite without both classes."""
    s, at = np.unique(scores, return_inverse=True)
    return best_cut(s, s, np.bincount(at, rejected, len(s)), np.bincount(at, ~rejected.astype(bool), len(s)))


def best_cut(low: np.ndarray, high: np.ndarray, rejected: np.ndarray, accepted: np.ndarray) -> float:
    """calibrated() over ascending bins of scores: their least and greatest score, and how many
    of each class they have."""
    if not rejected.sum() or not accepted.sum():
        return math.inf
    # A cut at k blocks what stands from k on.
    missed, wrong = np.append(0, np.cumsum(rejected)) / rejected.sum(), 1 - np.append(0, np.cumsum(accepted)) / accepted.sum()
    edges = np.concatenate([[low[0] - 1e-6], (high[:-1] + low[1:]) / 2, [high[-1] + 1e-6]])
    loss = missed + wrong
    best = np.flatnonzero(np.isclose(loss, loss.min(), rtol=0, atol=1e-12))
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def labelled_sample(urls: DataFrame, limit: int | None = None) -> DataFrame:
    """urls (url, verdict) -> url, verdict, calibration: all distinct URLs that have a verdict; with
    a limit, at most so many of each, by least hash."""
    few = urls.where("url is not null and verdict in ('allow', 'block')").select("url", "verdict").distinct()
    if limit is not None:
        of = lambda v: few.where(F.col("verdict") == v).orderBy(F.xxhash64("url"), "url").limit(limit)
        few = of("allow").union(of("block"))
    return few.withColumn("calibration", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(CALIBRATION)) == 0)


def _symbols(urls: DataFrame, *columns: str) -> DataFrame:
    """urls (url, columns) -> columns, b (its bytes), i and next: of each place the byte there, or
    the end."""
    raw, size = F.col("url").cast("binary"), F.octet_length("url")
    at = urls.select(*columns, raw.alias("b"), size.alias("size"), F.explode(F.sequence(F.lit(0), size)).alias("i"))
    byte = F.conv(F.hex(F.substring("b", F.col("i") + 1, F.lit(1))), 16, 10).cast("int")
    return at.select(*columns, "b", "i", F.when(F.col("i") == F.col("size"), ALPHABET - 1).otherwise(byte).alias("next"))


def _before(k: Column) -> Column:
    """The k bytes before a place (see _symbols)."""
    return F.substring("b", F.col("i") - k + 1, k).alias("context")


def gram_counts(urls: DataFrame) -> DataFrame:
    """urls (url, verdict) -> verdict, context, next, n for contexts of 0 to ORDER bytes; next
    is a byte or the end."""
    deep = _symbols(urls, "verdict").select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(ORDER), F.col("i")))).alias("k"))
    return deep.groupBy("verdict", _before(F.col("k")), "next").agg(F.count("*").alias("n"))


def _scores(spark: SparkSession, judge: Judge) -> Callable[[str], Column]:
    """The judge's score as a function of a column."""
    shared = spark.sparkContext.broadcast(judge)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            yield pd.Series([shared.value.score(u) for u in urls], dtype="float64")

    return score


def _ratios(grams: DataFrame, judge: Judge, counts: DataFrame, longest: int) -> DataFrame:
    """grams (context, next: distinct) -> context, next, ratio: those of which the counts have a
    context longer than the judge's models hold (longest), with the ratio of the whole models."""
    shared = grams.sparkSession.sparkContext.broadcast(judge)

    @F.pandas_udf("rejected double, accepted double")
    def held(contexts: pd.Series, nexts: pd.Series) -> pd.DataFrame:
        both = [shared.value.both(bytes(x), c) for x, c in zip(contexts, nexts)]
        return pd.DataFrame(both, columns=["rejected", "accepted"], dtype="float64")

    of = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0))
    each = counts.where(F.length("context") > longest).groupBy(F.col("context").alias("ending"), "next").agg(of("block").alias("block"), of("allow").alias("allow"))
    all_of = [F.sum(v).alias(f"{v}_n") for v in ("block", "allow")] + [F.count_if(F.col(v) > 0).alias(f"{v}_distinct") for v in ("block", "allow")]
    size = F.length("context")
    endings = grams.where(size > longest).select("context", "next", F.explode(F.sequence(F.lit(longest + 1), size)).alias("k"))
    endings = endings.withColumn("ending", F.substring("context", F.length("context") - F.col("k") + 1, F.col("k")))
    seen = endings.join(each.groupBy("ending").agg(*all_of), "ending").join(each, ["ending", "next"], "left")
    step = F.struct("k", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("block", "allow")], "block_n", "allow_n", "block_distinct", "allow_distinct")
    steps = seen.groupBy("context", "next").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    # Each longer context's counts beside the estimate so far; one that a model has not seen has none.
    on = lambda v: lambda p, s: F.when(s[f"{v}_n"] > 0, (s[v] + s[f"{v}_distinct"] * p) / (s[f"{v}_n"] + s[f"{v}_distinct"])).otherwise(p)
    rows = steps.withColumn("held", held("context", "next"))
    return rows.select("context", "next", (F.log(F.aggregate("steps", F.col("held.rejected"), on("block"))) - F.log(F.aggregate("steps", F.col("held.accepted"), on("allow")))).alias("ratio"))


def scored(rows: DataFrame, judge: Judge, counts: DataFrame, longest: int, *by: str) -> DataFrame:
    """rows (url and any columns but score) with score: the judge's, with the contexts of counts
    that are longer than longest.  by: columns that deal rows to blocks."""
    spark = rows.sparkSession
    if longest >= ORDER:
        return rows.withColumn("score", _scores(spark, judge)("url"))
    columns = rows.columns
    size = rows.agg(F.sum(F.octet_length("url").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt_rows = rows.withColumn("#block", F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int"))
    grams = _symbols(dealt_rows.select(F.col("#block").alias("block"), "url").where("url is not null"), "block")
    grams = stored(grams.select("block", _before(F.least(F.lit(ORDER), F.col("i"))), "next").where(F.length("context") > longest).distinct(), "url-grams")
    slices = stored(grams.join(_ratios(grams.select("context", "next").distinct(), judge, counts, longest), ["context", "next"]), "url-ratios")
    forget(grams)
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    first = slices.select(F.col("block").alias("#block"), F.lit(0).alias("#kind"), F.col("context").alias("#context"), F.col("next").alias("#next"), F.col("ratio").alias("#ratio"), *map(none, columns))
    rest = dealt_rows.select("#block", F.lit(1), F.lit(None).cast("binary"), F.lit(None).cast("int"), F.lit(None).cast("double"), *columns)
    shared = spark.sparkContext.broadcast(judge)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition by block: the ratios of its longer contexts, then its URLs."""
        judge, here = shared.value, None
        for batch in batches:
            block, kind = batch.column("#block").to_numpy(), batch.column("#kind").to_numpy()
            cuts = (np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist()
            for x, y in zip([0, *cuts], [*cuts, len(block)]):
                if x == y:
                    continue
                part = batch.slice(x, y - x)
                if block[x] != here:
                    here = block[x]
                    judge.longer.clear()
                if kind[x] == 0:
                    judge.longer.update(zip(zip(*(part.column(c).to_pylist() for c in ("#context", "#next"))), part.column("#ratio").to_pylist()))
                    continue
                scores = pa.array([judge.score(u) for u in part.column("url").to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), scores], [*columns, "score"])

    parts = first.union(rest).repartitionById(blocks, "#block").sortWithinPartitions("#block", "#kind")
    return parts.mapInArrow(score, StructType([*rows.schema, StructField("score", DoubleType())]))


def _learnt(urls: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame, Judge, int]:
    """The labelled URLs, the counts of those that are learnt from, a judge of the orders that
    MAX_GRAMS has room for, without a threshold, and the last of them."""
    few = stored(labelled_sample(urls, limit), "urls")
    counts = stored(gram_counts(few.where("not calibration")), "grams")
    order = F.length("context")
    sizes = dict(counts.groupBy(order.alias("k")).agg(F.count("*")).collect())
    longest = max((k for k in range(1, ORDER + 1) if sum(sizes.get(j, 0) for j in range(k + 1)) <= MAX_GRAMS), default=1)
    held = counts.where(order <= longest).toPandas()
    model = lambda v: Markov.of([(bytes(c), x, n) for c, x, n in held.loc[held["verdict"] == v, ["context", "next", "n"]].itertuples(index=False)])
    return few, counts, Judge(model("allow"), model("block")), longest


def _threshold(tests: DataFrame) -> float:
    """tests (verdict, score) -> the threshold.  A row for each 1/STEPS that some scores have comes
    to the driver."""
    of = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    bins = tests.groupBy(F.floor(F.col("score") * STEPS).alias("bin")).agg(F.min("score").alias("low"), F.max("score").alias("high"), of("block"), of("allow")).toPandas().sort_values("bin")
    return best_cut(*(bins[c].to_numpy(float) for c in ("low", "high", "block", "allow")))


def fit(urls: DataFrame, limit: int | None = None) -> Judge:
    """A judge that needs no table: of urls (url, verdict: allow, block or null), from all of them
    or from a sample (limit, see labelled_sample).  Its contexts are as long as MAX_GRAMS has room
    for; url_filter takes the longer ones too."""
    few, counts, judge, _ = _learnt(urls, limit)
    if judge.accepted.contexts and judge.rejected.contexts:
        judge.threshold = _threshold(scored(few.where("calibration").select("verdict", "url"), judge, counts, ORDER, "url"))
    forget(few, counts)
    return judge


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, limit: int | None = None) -> DataFrame:
    """Every page's verdict: page_id, host, path, rule, verdict, score.

    pages: page_id, url (other columns are ignored).  Where no rule fits, rule is null and the
    models judge: block if score (see Judge) is above the calibrated threshold.  A null url is
    an empty one; without labelled URLs of both verdicts to learn from and to calibrate on
    nothing more is blocked; repeated rows and null ids pass through; an empty table gives an
    empty result.
    """
    ship(pages.sparkSession)
    parsed = dealt(pages, "page_id", "url").select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.select("*", rule.alias("rule"), verdict.alias("given"))
    few, counts, judge, longest = _learnt(judged.select("url", F.col("given").alias("verdict")), limit)
    if judge.accepted.contexts and judge.rejected.contexts:
        judge.threshold = _threshold(scored(few.where("calibration").select("verdict", "url"), judge, counts, longest, "url"))
    out = scored(judged, judge, counts, longest, "page_id", "url")
    forget(few, counts)
    own = F.when(F.col("score") > judge.threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", own).alias("verdict"), "score")
