"""Document fingerprints by one-permutation MinHash.

Each five-word shingle is hashed once; the hash's top bits name a bin and every
bin keeps its least hash.  Empty bins are filled by optimal densification (each
draws bins from a fixed random sequence until a filled one comes up).  A bin is
stored as its low-order bits; the likeness of two fingerprints corrects for bins
that agree by chance.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, ship, text_of

WORDS, BINS, BITS = 5, 256, 4
#: Word hashes kept per Python worker, and the longest word kept: bounds on memory, not on texts.
KEPT, KEPT_BYTES = 200_000, 64
ROUNDS = 64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the text's word shingles (fewer words: of the whole sequence)."""
    found = text.encode("utf-8", "replace").lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, found), np.uint64, n)
    k = min(words, n)
    with np.errstate(over="ignore"):
        h = w[: n - k + 1].copy()
        for j in range(1, k):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += w[j : n - k + 1 + j]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


class Binner:
    """Fingerprints of one shape: words a shingle, bins, stored bits a bin (1, 2, 4 or 8)."""

    def __init__(self, words: int = WORDS, bins: int = BINS, bits: int = BITS):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins: a power of two; bits: 1, 2, 4 or 8")
        self.words, self.bins, self.bits = words, bins, bits
        self.shift = np.uint64(64 - (bins.bit_length() - 1))
        self.edges = np.arange(bins, dtype=np.uint64) << self.shift
        self.draw = np.random.default_rng(20240229)
        self.draws = [self._more()]

    def _more(self) -> np.ndarray:
        return self.draw.integers(0, self.bins, (ROUNDS, self.bins))

    def bin_values(self, hashes: np.ndarray) -> np.ndarray | None:
        """Every bin's stored bits, or None for no shingles at all."""
        n = len(hashes)
        if not n:
            return None
        h = np.sort(hashes)
        at = np.searchsorted(h, self.edges)
        got = h[np.minimum(at, n - 1)]
        filled = (at < n) & (got >> self.shift == self.edges >> self.shift)
        values = got.astype(np.uint8) & np.uint8((1 << self.bits) - 1)
        empty = np.flatnonzero(~filled)
        for r in range(1 << 20):
            if not len(empty):
                break
            if r == len(self.draws):
                self.draws.append(self._more())
            drawn = self.draws[r][:, empty]
            hit = filled[drawn]
            first = hit.argmax(axis=0)
            ok = hit[first, np.arange(len(empty))]
            values[empty[ok]] = values[drawn[first, np.arange(len(empty))][ok]]
            empty = empty[~ok]
        return values

    def values(self, text: str) -> np.ndarray | None:
        return self.bin_values(shingle_hashes(text, self.words))

    def packed(self, values: np.ndarray | None) -> str:
        """Hexadecimal digits; the empty string for a text without words."""
        if values is None:
            return ""
        bits = np.unpackbits(values[:, None], axis=1)[:, 8 - self.bits :]
        return np.packbits(bits.ravel()).tobytes().hex()

    def unpacked(self, fingerprint: str) -> np.ndarray | None:
        if not fingerprint:
            return None
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), np.uint8)).reshape(self.bins, self.bits)
        return np.packbits(np.pad(bits, ((0, 0), (8 - self.bits, 0))), axis=1).ravel()

    def likeness(self, a: np.ndarray | None, b: np.ndarray | None) -> float:
        """Estimated Jaccard likeness, 0 to 1; two texts without words are alike."""
        if a is None or b is None:
            return float(a is None and b is None)
        by_chance = 2.0**-self.bits
        return float(max(0.0, (np.count_nonzero(a == b) / self.bins - by_chance) / (1 - by_chance)))


def fingerprints(docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id, text -> doc_id, fingerprint (string).  No shuffle.

    A null text is the empty text; texts without words have the empty fingerprint;
    equal texts have equal fingerprints; repeated rows and null ids pass through.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        b = Binner(words, bins, bits)
        for texts in batches:
            yield pd.Series([b.packed(b.values(t)) for t in texts], dtype="object")

    return dealt(docs, "doc_id", "text").select("doc_id", of(text_of()).alias("fingerprint"))


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Rows in ascending doc_id, in partitions that also hold the row that follows.

    Ranges of ids are cut at ids that occur, so the first row of each range is known
    and is copied into the range before; the first row of all is copied into the
    last one.  Returns bucket, role (0: a row of the range, 1: the row after it),
    doc_id, text, sorted within partitions; one shuffle.  Rows of equal ids are in the
    order of their texts.  Null ids come last, in the order of their texts' hashes, which
    are cut into ranges too, so that any number of them is spread.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    missing = F.col("doc_id").isNull()
    cuts, least, nulls = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n), F.min("doc_id"), F.count_if(missing)).first()
    cuts = sorted({c for c in cuts or [] if c > least})
    within = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    # The number of cuts up to the id: first every step-th cut is looked at, then a step of them.
    step = max(1, math.isqrt(len(cuts)))
    upto = lambda some: F.size(F.filter(some, lambda c: c <= F.col("doc_id")))
    coarse = upto(F.array(*[F.lit(c).cast("long") for c in cuts[::step]])) if cuts else F.lit(0)
    of_id = F.when(coarse == 0, 0).otherwise((coarse - 1) * step + upto(F.slice(within, (coarse - 1) * step + 1, F.lit(step))))
    hashed = F.when(missing, F.xxhash64("text"))
    of_hash = F.floor((hashed / 2.0**64 + 0.5) * n).cast("int")
    # The least hash of each range of hashes that has rows: at most n.
    firsts = dict(rows.where(missing).groupBy(of_hash).agg(F.min(hashed)).collect()) if nulls else {}
    ranges = sorted(firsts)
    base = len(cuts) + 1 if least is not None else 0
    last = base + len(ranges) - 1
    number = F.array_position(F.array(*[F.lit(r) for r in ranges]), of_hash).cast("int") - 1 if ranges else F.lit(0)
    leads = (F.element_at(F.array(*[F.lit(firsts[r]).cast("long") for r in ranges]), number + 1) == hashed) if ranges else F.lit(False)
    rows = rows.withColumns({"hashed": hashed, "own": F.when(missing, base + number).otherwise(of_id)})
    first_of_range = F.when(missing, leads).otherwise((F.col("own") > 0) & (F.get(within, F.col("own") - 1) == F.col("doc_id")))
    first_of_all = F.col("doc_id").eqNullSafe(F.lit(least)) & F.lit(least is not None)
    place = lambda b, role: F.struct(b.cast("int").alias("bucket"), F.lit(role).alias("role"))
    # What comes first of all follows the last; without an id that is the first range of hashes.
    places = F.array_compact(
        F.array(
            place(F.col("own"), 0),
            F.when(first_of_range, place(F.when(F.col("own") == 0, last).otherwise(F.col("own") - 1), 1)),
            F.when(first_of_all, place(F.lit(last), 1)),
        )
    )
    rows = rows.select(F.explode(places).alias("at"), "doc_id", "text", "hashed").select("at.*", "doc_id", "text", "hashed")
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "role", F.asc_nulls_last("doc_id"), "hashed", "text").drop("hashed")


def edited_likeness(docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likenesses.

    The edited text: the last floor(n_chars/4) code points are replaced by the first
    as many (or all) of the next document in ascending doc_id (after the last: the
    first).  Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  Null texts are empty; a single document is its own next;
    repeated ids follow each other, ordered by text; null ids come last, ordered by the hashes
    of their texts; ids are whole numbers, or texts of them; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = Binner(words, bins, bits)
        held = None
        for rows in batches:
            out = []
            for bucket, role, doc_id, text in zip(rows["bucket"], rows["role"], rows["doc_id"], rows["text"]):
                same = held is not None and held[0] == bucket
                if role and not same:
                    continue  # the range's last row has met its follower
                values = b.values(text)
                if same:
                    _, i, t, v = held
                    n = len(t)
                    edited = t[: n - n // 4] + text[: n // 4]
                    w = b.values(edited)
                    out.append((i, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), b.packed(v), b.packed(w), b.likeness(v, w), b.likeness(v, values)))
                held = None if role else (bucket, doc_id, text, values)
            made = pd.DataFrame(out, columns=names)
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    return with_neighbours(docs).mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
