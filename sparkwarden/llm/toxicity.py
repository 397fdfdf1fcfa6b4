"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Labelled training rows, up to a stated number of each class, are the examples.  All their
words are terms.  A term's weight is its inverse document frequency over all documents times
its relevance, the size of its log odds between toxic and clean examples (supervised term
weighting, Debole and Sebastiani 2003): without it the invented or rare words of a text
outweigh the few that the label is about.  The examples' unit vectors form an inverted index
in blocks of similar examples, with each term's greatest weight in a block.  A query visits
blocks in order of their upper bounds and stops when no unvisited block can still hold one of
its nearest neighbours, so the neighbours are exact.  Their votes, weighted by cosine, are
calibrated on the examples themselves, each left out of its own search.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dealt, forget, ship, stored, text_of

#: Most labelled example texts of each class that the index holds (those of least hash), and
#: most characters of them together in a class: the bound on the model's size.
MAX_EXAMPLES, MAX_CHARS = 2000, 16_000_000
#: Neighbours that vote, and examples in a block of the index.
NEIGHBOURS, BLOCK = 16, 64
#: A term in more than one of so many examples is a common one of the index.
COMMON = 32
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> Counter:
    """Words in lower case, with their counts."""
    return Counter(_WORD.findall(text.lower()))


def term_counts(text: str, terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The text's terms, ascending, and their counts."""
    found = _WORD.findall(text.lower())
    at = np.fromiter(map(terms.get, found, repeat(-1)), np.int64, len(found))
    at.sort()
    at = at[np.searchsorted(at, 0) :]
    edges = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True]))) if len(at) else np.zeros(1, np.int64)
    return at[edges[:-1]], np.diff(edges)


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, one range after another, and the ranges' sizes."""
    n = stop - start
    return np.repeat(start - (n.cumsum() - n), n) + np.arange(n.sum()), n


@dataclass
class Index:
    """Block-max inverted index over unit vectors of examples.

    A rare term has a list of postings, first[t] to first[t + 1]: example and value.  A common
    term (in one example of COMMON or more) has its values by block instead, and the greatest
    of each block.  A query adds up its rare terms' postings; with the common terms' greatest
    values they bound every block from above.
    """

    weights: np.ndarray
    size: int
    first: np.ndarray
    row: np.ndarray
    value: np.ndarray
    common: np.ndarray  # by term: its place among the common ones, or -1
    top: np.ndarray  # by common term and block
    cells: np.ndarray  # by block, common term and example of the block

    @classmethod
    def of(cls, weights: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> Index:
        """vectors: terms and values of each example, in the order of the blocks."""
        size = len(vectors)
        blocks = size // BLOCK + 1
        term = np.concatenate([t for t, _ in vectors]) if size else np.empty(0, np.int64)
        value = np.concatenate([v for _, v in vectors]).astype(np.float32) if size else np.empty(0, np.float32)
        row = np.repeat(np.arange(size), [len(t) for t, _ in vectors])
        n = np.bincount(term, minlength=len(weights))
        often = np.flatnonzero(n >= max(BLOCK // 2, size // COMMON))
        common = np.full(len(weights), -1)
        common[often] = np.arange(len(often))
        here = common[term] >= 0
        cells = np.zeros((blocks, len(often), BLOCK), np.float32)
        cells[row[here] // BLOCK, common[term[here]], row[here] % BLOCK] = value[here]
        term, row, value = term[~here], row[~here], value[~here]
        order = np.lexsort((row, term))
        first = np.searchsorted(term[order], np.arange(len(weights) + 1))
        return cls(weights, size, first, row[order].astype(np.int32), value[order], common, cells.max(axis=2).T.copy(), cells)

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A unit vector's values: (1 + ln tf) times the term's weight, to length 1."""
        v = (1 + np.log(counts)) * self.weights[terms]
        return v / max(np.sqrt(v @ v), 1e-12)

    def nearest(self, terms: np.ndarray, v: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Exact top k by cosine, ties to the example that stands first: examples and cosines."""
        posting, n = _ranges(self.first[terms], self.first[terms + 1])
        blocks = len(self.cells)
        rare = np.bincount(self.row[posting], np.repeat(v, n) * self.value[posting], blocks * BLOCK).reshape(blocks, BLOCK)
        often = self.common[terms]
        w = v[often >= 0].astype(np.float32)
        often = often[often >= 0]
        bounds = rare.max(axis=1) + w @ self.top[often]
        order = np.argsort(-bounds, kind="stable")
        rows, found = np.empty(0, np.int64), np.empty(0)
        at, step = 0, 4
        while at < blocks:
            least = found[-1] - 1e-5 if len(found) == k else 0.0
            now = order[at : at + step]
            now = now[(bounds[now] > 0) & (bounds[now] >= least)]
            if not len(now):
                break
            scores = (rare[now] + w @ self.cells[now[:, None], often]).ravel()
            hit = np.flatnonzero((scores > 0) & (scores >= least))
            places = (now[:, None] * BLOCK + np.arange(BLOCK)).ravel()[hit]
            rows, found = np.concatenate((rows, places)), np.concatenate((found, scores[hit]))
            rows, found = rows[rows != but], found[rows != but]
            best = np.lexsort((rows, -found))[:k]
            rows, found = rows[best], found[best]
            at, step = at + step, blocks
        return rows, found


@dataclass
class Model:
    """Terms, index, votes and calibration; bounded by the examples."""

    terms: dict[str, int]
    index: Index
    ids: list
    labels: np.ndarray
    votes: np.ndarray  # how many labelled texts an example stands for, about one on average
    prior: float
    slope: float = 1.0
    offset: float = 0.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The text's terms and their values; words that no example has are no terms."""
        terms, counts = term_counts(text, self.terms)
        return terms, self.index.unit(terms, counts)

    def signal(self, terms: np.ndarray, v: np.ndarray, but: int = -1) -> tuple[float, list[tuple[int, float]]]:
        """Log odds of the distance-weighted vote (the nearest neighbour has weight one, and
        so has the prior), and the neighbours."""
        toxic = every = 0.0
        near: list[tuple[int, float]] = []
        if len(terms):
            rows, cos = self.index.nearest(terms, v, but=but)
            if len(rows):
                weight = cos / cos[0] * self.votes[rows]
                toxic, every = float(weight @ self.labels[rows]), float(weight.sum())
                near = [(self.ids[r], c) for r, c in zip(rows.tolist(), cos.tolist())]
        p = (toxic + self.prior) / (every + 1)
        return float(np.log(p / (1 - p))), near

    def score(self, text: str) -> tuple[float, list[tuple[int, float]]]:
        s, near = self.signal(*self.vector(text))
        return float(1 / (1 + np.exp(-np.clip(self.slope * s + self.offset, -30, 30)))), near


def platt(signals: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit (Newton steps with a little ridge)."""
    x = np.stack((signals, np.ones_like(signals)))
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -30, 30)))
        g = x @ (weights * (labels - p)) - 1e-2 * (b - [1.0, 0.0])
        h = (x * (weights * p * (1 - p))) @ x.T + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (float(b[0]), float(b[1])) if b[0] > 0 else (1.0, 0.0)


def held_out(column: str = "doc_id") -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def _examples(docs: DataFrame, labels: DataFrame, limit: int, chars: int) -> tuple[DataFrame, dict[bool, int]]:
    """The bounded sample (doc_id, toxic, text) and the classes' sizes.

    Equal texts are one example (toxic if most of their labels are); limits are on texts.
    """
    rows = dealt(docs, "doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", text_of().alias("text"))
    marks = dealt(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("toxic"))
    # Digests, not texts, are shuffled.
    labelled = rows.select("doc_id", F.sha2("text", 256).alias("digest"), F.char_length("text").cast("long").alias("chars")).join(marks, "doc_id")
    texts = labelled.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("chars").alias("chars"), (F.avg("toxic") > 0.5).alias("toxic"))
    texts = stored(texts.withColumn("draw", F.xxhash64(F.lit("toxicity"), "digest")), "toxicity-labelled")
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = None
    for toxic, n in sizes.items():
        # Only the hashes that can be among the least ones come to the task that sorts them:
        # about limit rows of all tasks together, however many there are.
        share = min(1.0, (limit + 8 * limit**0.5 + 64) / n)
        near = texts.where((F.col("toxic") == toxic) & (F.col("draw") <= F.lit(int(-(2.0**63) + share * (2.0**64 - 2048)))))
        few = near.orderBy("draw", "digest").limit(limit)
        upto = Window.orderBy("draw", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        few = few.withColumn("upto", F.sum("chars").over(upto)).where(F.col("upto") <= chars).select("doc_id", "digest", "toxic")
        picked = few if picked is None else picked.union(few)
    if picked is None:
        return rows.select("doc_id", F.lit(True).alias("toxic"), "text").limit(0), sizes
    # At most 2 * limit rows of three short columns.
    few = rows.join(F.broadcast(picked), "doc_id").where(F.sha2("text", 256) == F.col("digest")).dropDuplicates(["digest"]).select("doc_id", "toxic", "text")
    few = stored(few, "toxicity-examples")
    forget(texts)
    return few, sizes


def _document_frequencies(docs: DataFrame, terms: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, total = shared.value, 0
        n = np.zeros(len(known) + 1, np.int64)  # the last: all that are no terms
        for texts in batches:
            for t in texts["text"]:
                found = set(_WORD.findall(t.lower()))
                n[np.fromiter(map(known.get, found, repeat(-1)), np.int64, len(found))] += 1
            total += len(texts)
        n = n[:-1]
        at = np.flatnonzero(n)
        yield pd.DataFrame({"term": np.append(at, -1), "n": np.append(n[at], total)})

    # One row a term and task, then one a term: as many as the examples have.
    found = dealt(docs, "text").select(text_of().alias("text")).mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.ones(max(1, len(terms)))
    some = found["term"].to_numpy() >= 0
    df[found["term"].to_numpy()[some]] = np.maximum(1, found["n"].to_numpy()[some])
    return df, int(found["n"].to_numpy()[~some].sum())


def in_order(t: np.ndarray, v: np.ndarray) -> tuple[bytes, bytes]:
    """Bytes that sort as the tuples of terms and of weights (neither is negative) would."""
    return t.astype(">u8").tobytes(), v.astype(">f8").tobytes()


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_EXAMPLES, chars: int = MAX_CHARS) -> Model | None:
    """The model; None without a toxic training example.

    The examples, at most limit texts of each class and chars characters of them, are all
    that comes to the driver.
    """
    ship(docs.sparkSession)
    few, sizes = _examples(docs, labels, limit, chars)
    if not sizes.get(True):
        return None
    # The examples are read twice: their words are held as arrays, not as a table of each text.
    found: set[str] = set()
    for r in few.toLocalIterator():
        found.update(words(r["text"]))
    terms = {w: i for i, w in enumerate(sorted(found))}
    del found
    rows = []
    for r in few.toLocalIterator():
        c = words(r["text"])
        t = np.fromiter((terms[w] for w in c), np.int64, len(c))
        by = np.argsort(t)
        rows.append((r["doc_id"], bool(r["toxic"]), t[by], np.fromiter(c.values(), float, len(c))[by]))
    forget(few)
    df, total = _document_frequencies(docs, terms)
    seen = np.zeros((2, len(df)))
    for _, toxic, t, _ in rows:
        seen[int(toxic), t] += 1
    marks = np.array([x[1] for x in rows], float)
    n_toxic, n_clean = marks.sum(), len(marks) - marks.sum()
    relevance = np.abs(np.log((seen[1] + 0.5) / (n_toxic + 1)) - np.log((seen[0] + 0.5) / (n_clean + 1)))
    weights = np.log(1 + total / df) * relevance
    # Blocks of similar examples: by their heaviest terms.  No label, no identifier.
    vectors = []
    blank = Index.of(weights, [])
    for doc_id, toxic, t, n in rows:
        v = blank.unit(t, n)
        heaviest = t[np.lexsort((t, -v))[:4]].tolist()
        vectors.append((heaviest, *in_order(t, v), doc_id, float(toxic), t, v))
    del rows
    vectors.sort(key=lambda x: x[:4])
    labels_ = np.array([x[4] for x in vectors])
    share = np.array([sizes.get(False, 0) / max(1, n_clean), sizes[True] / max(1, n_toxic)])
    votes = share[labels_.astype(int)]
    votes = votes / votes.mean()
    prior = sizes[True] / (sizes[True] + sizes.get(False, 0) + 1)
    model = Model(terms, Index.of(weights, [x[5:] for x in vectors]), [x[3] for x in vectors], labels_, votes, prior)
    signals = np.array([model.signal(x[5], x[6], but=i)[0] for i, x in enumerate(vectors)])
    model.slope, model.offset = platt(signals, labels_, votes)
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, limit: int = MAX_EXAMPLES, threshold: float = THRESHOLD) -> DataFrame:
    """Every whole text's score: doc_id, held_out, score, predicted, evidence.

    Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1; evidence
    lists the nearest examples (doc_id, cosine).  Null and empty texts, and texts without a
    term, score the calibrated share of toxic examples without any evidence; of equally near
    examples those whose vectors sort first vote; repeated rows and null ids pass through;
    without toxic training rows every score is 0; an empty table gives no rows.  No shuffle
    of texts.
    """
    model = fit(docs, labels, limit)
    rows = dealt(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), text_of().alias("text"))
    named = rows.schema["doc_id"].dataType.simpleString()
    evidence = f"array<struct<doc_id: {named}, cosine: double>>"
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast(evidence).alias("evidence"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            found = [score(t) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *[len(near) for _, near in found]])
            flat = [x for _, near in found for x in near]
            pairs = pa.StructArray.from_arrays([pa.array([i for i, _ in flat], batch.schema.field("doc_id").type), pa.array([c for _, c in flat], pa.float64())], ["doc_id", "cosine"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([s for s, _ in found], pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
                ["doc_id", "held_out", "score", "evidence"],
            )

    out = rows.mapInArrow(scored, f"doc_id {named}, held_out boolean, score double, evidence {evidence}")
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "evidence")


def toxicity_filter(docs: DataFrame, labels: DataFrame, limit: int = MAX_EXAMPLES, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score under threshold.  No shuffle of texts."""
    model = fit(docs, labels, limit)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = shared.value.score
        for texts in batches:
            yield pd.Series([score(t)[0] < threshold for t in texts], dtype=bool)

    return docs.where(clean(text_of()))
