"""Hard-negative mining: product quantisation with residual norms, then an exact rerank.

Every vector is cut into short subvectors; each becomes the number of its nearest centroid,
and the length of what is left over is stored beside it.  An anchor's scores against a block
of vectors come from look-up tables (anchor times centroid), and by Cauchy and Schwarz the
true score lies within the sum of |anchor part| * |residual part| of that.  What these bounds
cannot rule out is scored exactly on the integer vectors, so the codebook, which is fitted on
a bounded sample, changes the work and never a result.

Anchors are a stated query set (ids divisible by ``every``).  They go in chunks to all blocks
of rows; a pair of chunk and block is one task's work and gives at most ``k`` rows an anchor
(or window), so neither a hot label nor copies of one vector make more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dealt, forget, ship, stored

#: Dimensions of a subvector, centroids of a subspace (a code is a byte).
PART, CENTROIDS = 2, 256
#: Rows (of least id hash) that the codebook is fitted on, and rounds of the fit.
SAMPLE, ROUNDS = 4096, 8
#: Rows of a block, anchors of a chunk, anchors scored together.
BLOCK, CHUNK, TOGETHER = 4096, 4096, 64
#: Components are held within this size, so that scores of up to 128 dimensions fit a long.
LARGEST = 1 << 28


def usable_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v (array of int): floor(scale * x) of each component, of the rows that
    take part: no null id, label, vector or component, no infinite one.  Of repeated ids the
    least (label, v) stays."""
    x = F.col("embedding")
    fit = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = dealt(vectors, "vec_id", "embedding", "label").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(F.forall(x, fit))
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    one = F.min(F.struct("label", v.alias("v"))).alias("r")
    return rows.groupBy("vec_id").agg(one).select("vec_id", "r.label", "r.v")


class Codebook:
    """Integer centroids of every subspace: array [subspace, centroid, PART]."""

    def __init__(self, sample: np.ndarray, dims: int):
        self.parts = max(1, -(-dims // PART))
        self.dims = self.parts * PART
        cut = self.padded(sample).reshape(-1, self.parts, PART)
        self.centroids = np.stack([self._centroids(cut[:, j].astype(float)) for j in range(self.parts)])
        self.longest = float(np.sqrt((self.centroids.astype(float) ** 2).sum(2).max(1).sum()))

    def padded(self, v: np.ndarray) -> np.ndarray:
        return np.pad(v, ((0, 0), (0, self.dims - v.shape[1])))

    @staticmethod
    def _centroids(x: np.ndarray) -> np.ndarray:
        """Lloyd's rounds from evenly spaced sample rows in sorted order."""
        if not len(x):
            return np.zeros((CENTROIDS, PART), np.int64)
        x = x[np.lexsort(x.T)]
        c = x[np.linspace(0, len(x) - 1, CENTROIDS).astype(int)]
        for _ in range(ROUNDS):
            near = _nearest(x, c)
            n = np.bincount(near, minlength=CENTROIDS)
            total = np.stack([np.bincount(near, x[:, i], CENTROIDS) for i in range(PART)], 1)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        return np.rint(c).astype(np.int64)

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """codes (uint8) and residual norms (float32, rounded up), a column a subspace."""
        cut = self.padded(v).reshape(len(v), self.parts, PART)
        codes = np.stack([_nearest(cut[:, j].astype(float), self.centroids[j].astype(float)) for j in range(self.parts)], 1)
        left = cut - self.centroids[np.arange(self.parts), codes]
        norms = np.sqrt((left.astype(float) ** 2).sum(2))
        return codes.astype(np.uint8), np.nextafter(norms.astype(np.float32), np.float32(np.inf))

    def bounds(self, q: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that every row (a column) can have with every
        anchor of q (a row)."""
        cut = self.padded(q).reshape(len(q), self.parts, PART).astype(float)
        tables = np.einsum("ajd,jcd->jac", cut, self.centroids.astype(float))
        score = np.zeros((len(q), len(codes)))
        for j in range(self.parts):
            score += tables[j][:, codes[:, j]]
        lengths = np.sqrt((cut**2).sum(2))
        off = lengths @ norms.T.astype(float)
        # Rounding of the sums themselves.
        off += off * 1e-9 + 1e-9 * self.longest * np.sqrt((cut**2).sum((1, 2)))[:, None] + 1e-6
        return score - off, score + off


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of the centroid nearest to each row; a slice of rows at a time."""
    half = (c**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 1024] @ c.T - half, 1) for i in range(0, max(1, len(x)), 1024)])


def fit_codebook(rows: DataFrame, dims: int) -> Codebook:
    """A codebook from SAMPLE rows at most, which are all that comes to the driver."""
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()
    return Codebook(_matrix(few["v"], dims), dims)


def _matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _encoded(rows: DataFrame, book: Codebook, dims: int) -> DataFrame:
    """vec_id, label, codes, norms, ints: the vectors as bytes beside their codes."""
    shared = rows.sparkSession.sparkContext.broadcast(book)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = _matrix(b["v"], dims)
            codes, norms = shared.value.encode(v)
            held = [[r.tobytes() for r in x] for x in (codes, norms, v.astype(np.int32))]
            yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "codes": held[0], "norms": held[1], "ints": held[2]})

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    return rows.mapInPandas(encode, f"{kinds}, codes binary, norms binary, ints binary")


def _from_bytes(column, kind, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), n)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _floor_of_best(lower: np.ndarray, k: int) -> float:
    """The k-th greatest of the lower bounds: what the first k reach at least."""
    return np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) >= k else -np.inf


def _met(rows: DataFrame, anchors: DataFrame, chunks: int, blocks: int, work, kind: str) -> DataFrame:
    """work(block of rows, chunk of anchors) for all pairs of a block and a chunk."""
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("block", deal(blocks, 0)).withColumn("chunk", every(chunks))
    right = anchors.withColumn("chunk", deal(chunks, 1)).withColumn("block", every(blocks))
    return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInPandas(work, kind)


def _first(found: DataFrame, keys: tuple[str, ...], score: str, tie: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """The first negatives of each anchor and positive within the window of scores.

    rows: see usable_vectors.  Anchors are the rows whose id is divisible by ``every``, their
    positives the first ``positives`` other rows of the same label by inner product (ties: the
    smaller id).  Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score: the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    Vectors of unequal length: missing components count as zero.  An anchor without another
    row of its label has no positive and gives no row, nor does a window without a row; an
    empty table gives an empty result.
    """
    spark = rows.sparkSession
    ship(spark)
    usable = stored(rows, "vectors")
    dims, n, n_anchors = usable.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    dims, blocks, chunks = max(1, dims), max(1, -(-n // BLOCK)), max(1, -(-n_anchors // CHUNK))
    book = fit_codebook(usable, dims)
    table = stored(_encoded(usable, book, dims), "codes")
    forget(usable)
    anchors = table.where(F.col("vec_id") % every == 0).select("vec_id", "label", "ints")
    shared = spark.sparkContext.broadcast(book)

    def opened(block: pd.DataFrame, chunk: pd.DataFrame):
        """Per anchor: its place in the chunk, integer vector, and the bounds of all rows."""
        book = shared.value
        codes, norms = _from_bytes(block["codes"], np.uint8, book.parts), _from_bytes(block["norms"], np.float32, book.parts)
        q = _from_bytes(chunk["ints"], np.int32, dims).astype(np.int64)
        for i in range(0, len(q) if len(codes) else 0, TOGETHER):
            lower, upper = book.bounds(q[i : i + TOGETHER], codes, norms)
            yield from zip(range(i, i + TOGETHER), q[i : i + TOGETHER], lower, upper)

    def near(block: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        ids, labels, v = block["vec_id"].to_numpy(), block["label"].to_numpy(), _from_bytes(block["ints"], np.int32, dims)
        out = []
        for i, q, lower, upper in opened(block, chunk):
            own = np.flatnonzero((labels == chunk["label"].iat[i]) & (ids != chunk["vec_id"].iat[i]))
            own = own[upper[own] >= _floor_of_best(lower[own], positives)]
            exact = v[own].astype(np.int64) @ q
            best = _best(ids[own], exact, positives)
            out += zip([chunk["vec_id"].iat[i]] * len(best), ids[own][best].tolist(), exact[best].tolist())
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"])

    def hard(block: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        ids, labels, v = block["vec_id"].to_numpy(), block["label"].to_numpy(), _from_bytes(block["ints"], np.int32, dims)
        out = []
        for i, q, lower, upper in opened(block, chunk):
            other = labels != chunk["label"].iat[i]
            for p in chunk["positives"].iat[i]:
                top, least = high * p["score"], low * p["score"]
                # Certainly within the window: what they reach, the first ones reach.
                sure = other & (100 * lower >= least) & (100 * upper <= top)
                may = other & (100 * upper >= least) & (100 * lower <= top) & (upper >= _floor_of_best(lower[sure], negatives))
                at = np.flatnonzero(may)
                exact = v[at].astype(np.int64) @ q
                inside = (100 * exact >= least) & (100 * exact <= top)
                at, exact = at[inside], exact[inside]
                best = _best(ids[at], exact, negatives)
                out += [(chunk["vec_id"].iat[i], p["id"], p["score"], a, s) for a, s in zip(ids[at][best].tolist(), exact[best].tolist())]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    found = _met(table, anchors, chunks, blocks, near, "anchor_id long, positive_id long, positive_score long")
    pairs = stored(_first(found, ("anchor_id",), "positive_score", "positive_id", positives), "positives")
    wanted = pairs.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("positive_score").alias("score"), F.col("positive_id").alias("id")))).alias("positives"))
    asked = stored(anchors.join(wanted, "vec_id"), "windows")
    windows = _met(table, asked, chunks, blocks, hard, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    out = _first(windows, ("anchor_id", "positive_id"), "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted(label: Column, vec_id: Column) -> Column:
    """The label of the stated query: a seventh of the rows is counted to the next class."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


HARD_NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""
