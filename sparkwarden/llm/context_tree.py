"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each at a node of the byte's code tree; each such node
has a context tree over the preceding bytes, down to DEPTH of them.  A context's counts
of zeros and ones give its Krichevsky-Trofimov estimate; the weighted probability of a
context is half its own estimate and half the product of its children's.  A decision is
predicted by mixing the estimates of all depths along its context, each with the weight
that the training data have given it, and the code length of a text is the sum over its
decisions.

Texts are token sequences: the words in lower case, one space between, closed by an end
byte.  The corpus is cut into blocks of documents.  A block gives its distinct byte
windows (context and byte) with their counts; windows are counted over all blocks, the
trees are built and evaluated in groups by the last two context bytes, and each block gets
back just the windows that occur in it.  A group holds distinct windows, never texts.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, ship, stored, text_of

#: Context bytes.  At most 6, as a window is one 64-bit integer.
DEPTH = 4
#: Context bytes that name a group of trees.
GROUP = 2
END, GAP = 0x0A, 0x20
#: Characters of text in a block of documents, on average.
BLOCK_CHARS = 48_000_000


def tokens(text: str) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split()


def spelled(words: list[bytes]) -> np.ndarray:
    """The token sequence as bytes; DEPTH end bytes stand before it as the first context."""
    return np.frombuffer(bytes([END]) * DEPTH + b" ".join(words) + bytes([END]), np.uint8)


def windows(data: np.ndarray) -> np.ndarray:
    """For every byte after the first context: its DEPTH context bytes, oldest first, and itself."""
    n = len(data) - DEPTH
    w = np.zeros(n, np.int64)
    for j in range(DEPTH + 1):
        w <<= 8
        w |= data[j : n + j]
    return w


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - np.log(np.pi) - _lgamma(zeros + ones + 1.0)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5: Stirling's series after shifting the argument up."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift = shift + np.where(small, np.log(np.where(small, y, 1.0)), 0.0)
        y = np.where(small, y + 1, y)
    i = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / y - shift


def decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight code-tree nodes (1 to 255) of each byte, and the bit taken at each."""
    k = np.arange(8)
    node = (1 << k)[None, :] | (byte[:, None].astype(np.int64) >> (8 - k)[None, :])
    return node, (byte[:, None].astype(np.int64) >> (7 - k)[None, :]) & 1


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, each row's place among them, and the values' sums."""
    distinct, place = np.unique(key, return_inverse=True)
    return distinct, place, [np.bincount(place, v, len(distinct)) for v in values]


class Trees:
    """Context trees of one group of windows that share their GROUP newest context bytes.

    Levels run from DEPTH down to GROUP context bytes.  A level's keys are context and
    code-tree node; weighted holds ln of the weighted probability, ratio ln of own
    estimate against the children's product.
    """

    def __init__(self, window: np.ndarray, count: np.ndarray):
        seen = count > 0
        node, bit = decisions(window[seen] & 0xFF)
        context = window[seen] >> 8
        weight = np.repeat(count[seen], 8).astype(float)
        key = (np.repeat(context, 8) << 8) | node.ravel()
        key, _, (n, ones) = _sums(key, weight, weight * bit.ravel())
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]] = []
        zeros = n - ones
        weighted = kt_log(zeros, ones)
        self.levels.append((key, zeros, ones, None))
        for depth in range(DEPTH - 1, GROUP - 1, -1):
            # Dropping the oldest context byte leads to the parent context.
            shorter = ((key >> 8) & ((1 << 8 * depth) - 1)) << 8 | (key & 0xFF)
            key, _, (zeros, ones, below) = _sums(shorter, zeros, ones, weighted)
            own = kt_log(zeros, ones)
            weighted = np.logaddexp(own, below) - np.log(2)
            self.levels.append((key, zeros, ones, own - below))
        self.top = (key, zeros, ones, weighted)

    def predict(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every window's eight decisions the probability of the bit taken, from
        DEPTH context bytes down to GROUP, and the code-tree node."""
        node, bit = decisions(window & 0xFF)
        p = np.full(node.shape, 0.5)
        for depth, (key, zeros, ones, ratio) in zip(range(DEPTH, GROUP - 1, -1), self.levels):
            want = (((window >> 8) & ((1 << 8 * depth) - 1))[:, None] << 8) | node
            p = _mixed(p, want, bit, key, zeros, ones, ratio)
        return p, node


def _mixed(p: np.ndarray, want: np.ndarray, bit: np.ndarray, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, ratio: np.ndarray | None) -> np.ndarray:
    """One level's step: its own estimate and the deeper prediction p by their weights.
    Where the level has not seen the context, the estimates of no data all say one half."""
    if not len(key):
        return p
    at = np.minimum(np.searchsorted(key, want), len(key) - 1)
    known = key[at] == want
    own = (np.where(bit == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
    if ratio is None:
        return np.where(known, own, 0.5)
    share = 1 / (1 + np.exp(-np.clip(ratio[at], -700, 700)))
    return np.where(known, share * own + (1 - share) * p, p)


class Roots:
    """The levels of fewer than GROUP context bytes: at most 256 * 255 + 255 entries."""

    def __init__(self, rows: pd.DataFrame):
        self.levels = {}
        for depth in range(GROUP - 1, -1, -1):
            r = rows[rows["depth"] == depth].sort_values("key")
            self.levels[depth] = tuple(r[c].to_numpy() for c in ("key", "zeros", "ones", "ratio"))

    def finish(self, window: np.ndarray, node: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 of each window's byte given its context."""
        bit = decisions(window & 0xFF)[1]
        for depth in range(GROUP - 1, -1, -1):
            want = (((window >> 8) & ((1 << 8 * depth) - 1))[:, None] << 8) | node
            p = _mixed(p, want, bit, *self.levels[depth])
        return np.log10(p).sum(axis=1)


def learnt(column: str = "doc_id"):
    """Rows that the model learns from: crc32(doc_id as text) mod 7 is not 2 (null ids too)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 7 != 2, F.lit(True))


def _roots(tops: DataFrame) -> pd.DataFrame:
    """From the groups' tops (key with GROUP context bytes) the levels above them.

    The keys have at most GROUP - 1 context bytes and a node, so at most 65,535 rows.
    """
    levels = []
    below = tops
    for depth in range(GROUP - 1, -1, -1):
        mask = (1 << 8 * depth) - 1
        key = F.shiftleft(F.shiftright("key", 8).bitwiseAND(F.lit(mask)), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))
        sums = below.groupBy(key.alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        rows = sums.toPandas()
        own = kt_log(rows["zeros"].to_numpy(), rows["ones"].to_numpy())
        rows["ratio"] = own - rows["below"].to_numpy()
        rows["weighted"] = np.logaddexp(own, rows["below"].to_numpy()) - np.log(2)
        rows["depth"] = depth
        levels.append(rows)
        below = tops.sparkSession.createDataFrame(rows[["key", "zeros", "ones", "weighted"]]) if len(rows) else below.limit(0)
    return pd.concat(levels)


#: Documents of one block and scan task, compressed together.
PACK = "block int, pack binary"
PACK_BYTES = 2 << 20


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[int, list] = {}
    sizes: Counter = Counter()
    press = zstandard.ZstdCompressor(level=3)
    pack = lambda rows: press.compress(pickle.dumps(rows, 5))
    for batch in batches:
        out = []
        for block, doc_id, text, learn in zip(batch["block"].tolist(), batch["doc_id"], batch["text"], batch["learnt"].tolist()):
            held.setdefault(block, []).append((None if pd.isna(doc_id) else int(doc_id), learn, text))
            sizes[block] += len(text)
            if sizes[block] > PACK_BYTES:
                out.append((block, pack(held.pop(block))))
                del sizes[block]
        if out:
            yield pd.DataFrame(out, columns=["block", "pack"])
    if held:
        yield pd.DataFrame([(b, pack(r)) for b, r in held.items()], columns=["block", "pack"])


def _unpacked(pack: bytes) -> list[tuple[int | None, bool, str]]:
    return pickle.loads(zstandard.decompress(pack))


def _gathered(grams: dict[int, tuple], recent: dict[int, tuple[list, list]]) -> None:
    """Adds recent windows to each block's distinct windows and training counts."""
    for block, (learn, rest) in recent.items():
        a = np.sort(np.concatenate(learn)) if learn else np.empty(0, np.int64)
        keys, counts = np.unique(a, return_counts=True)
        parts = [(keys, counts)]
        if rest:
            b = np.unique(np.concatenate(rest))
            parts.append((b, np.zeros(len(b), np.int64)))
        if block in grams:
            parts.append(grams[block])
        if len(parts) > 1:
            every = np.concatenate([p[0] for p in parts])
            order = np.argsort(every, kind="stable")
            every, n = every[order], np.concatenate([p[1] for p in parts])[order]
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            keys, counts = every[first], np.add.reduceat(n, first)
        grams[block] = (keys, counts)
    recent.clear()


def context_tree_scores(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every whole text's score under the model learnt from the training documents.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes, bits_per_byte.  Tokens are the words and one end; base_score is the add-one
    unigram estimate, score the context trees', both log10 of the token sequence's
    probability.  Null texts are empty (one token, the end); repeated rows and null ids
    count as documents of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = dealt(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    chars = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    # A block is a hash of the row, so it is the same whenever a lost task runs again.
    rows = rows.select(F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(blocks)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text", learnt().alias("learnt"))
    packs = rows.mapInPandas(_packed, PACK)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each block's distinct words and windows, with their counts in training texts."""
        words: dict[int, Counter] = {}
        grams: dict[int, tuple] = {}
        recent: dict[int, tuple[list, list]] = {}
        held = 0
        for batch in batches:
            for block, pack in zip(batch["block"].tolist(), batch["pack"]):
                c = words.setdefault(block, Counter())
                for _, learn, text in _unpacked(pack):
                    found = tokens(text)
                    w = windows(spelled(found))
                    found.append(b"")  # the end token
                    if learn:
                        c.update(found)
                    else:
                        for t in found:
                            c[t] += 0
                    recent.setdefault(block, ([], []))[0 if learn else 1].append(w)
                    held += len(w)
                    if held > 4_000_000:
                        _gathered(grams, recent)
                        held = 0
        _gathered(grams, recent)
        for block, (keys, counts) in grams.items():
            for at in range(0, len(keys), 200_000):
                yield pd.DataFrame({"block": block, "word": None, "gram": keys[at : at + 200_000], "n": counts[at : at + 200_000]}).astype({"gram": "Int64"})
        for block, c in words.items():
            items = list(c.items())
            for at in range(0, len(items), 100_000):
                part = items[at : at + 100_000]
                yield pd.DataFrame({"block": block, "word": [w for w, _ in part], "gram": None, "n": [n for _, n in part]}).astype({"gram": "Int64"})

    seen = stored(packs.select("block", "pack").repartitionById(blocks, "block").mapInPandas(gather, "block int, word binary, gram long, n long"), "ctw-seen")

    # Words: counts over all training documents.
    per_word = seen.where("word is not null").groupBy("word").agg(F.sum("n").alias("c"))
    per_word = stored(per_word, "ctw-words")
    n_all, v_all = per_word.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = seen.where("word is not null").select("block", "word").join(per_word, "word").select("block", "word", "c")

    # Windows: counts over all training documents, trees by group.
    per_gram = stored(seen.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("c")).withColumn("part", F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * GROUP) - 1)).cast("int")), "ctw-windows")

    def tops(group: pd.DataFrame) -> pd.DataFrame:
        key, zeros, ones, weighted = Trees(group["gram"].to_numpy(), group["c"].to_numpy()).top
        return pd.DataFrame({"key": key, "zeros": zeros, "ones": ones, "weighted": weighted})

    top = per_gram.groupBy("part").applyInPandas(tops, "key long, zeros double, ones double, weighted double")
    roots = spark.sparkContext.broadcast(Roots(_roots(stored(top, "ctw-tops"))))

    def logs(group: pd.DataFrame) -> pd.DataFrame:
        window = group["gram"].to_numpy()
        trees = Trees(window, group["c"].to_numpy())
        out = np.empty(len(window))
        for at in range(0, len(window), 1 << 17):
            w = window[at : at + (1 << 17)]
            p, node = trees.predict(w)
            out[at : at + (1 << 17)] = roots.value.finish(w, node, p)
        return pd.DataFrame({"gram": window, "log": out})

    log = per_gram.groupBy("part").applyInPandas(logs, "gram long, log double")
    grams = seen.where("gram is not null").select("block", "gram").join(log, "gram")

    # Each block's own slice of words and windows meets the block's documents.
    base = float(np.log10(n_all + v_all + 1.0))
    none = F.lit(None)
    slices = words.select("block", F.lit(0).alias("kind"), "word", F.col("c").alias("n"), none.cast("double").alias("log"))
    slices = slices.union(grams.select("block", F.lit(1), none.cast("binary"), "gram", "log"))
    texts = packs.select("block", F.lit(2).alias("kind"), F.col("pack").alias("word"), none.cast("long").alias("n"), none.cast("double").alias("log"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a partition by block: the block's words, its windows, its documents."""
        block, logs, keys, values = None, {}, [], []
        ready = None
        for batch in batches:
            out = []
            for b, part in batch.groupby("block", sort=True):
                if b != block:
                    block, logs, keys, values, ready = b, {}, [], [], None
                kind = part["kind"].to_numpy()
                w, g, d = part[kind == 0], part[kind == 1], part[kind == 2]
                logs.update(zip(w["word"], (np.log10(w["n"].to_numpy("float64") + 1) - base).tolist()))
                if len(g):
                    keys.append(g["n"].to_numpy("int64"))
                    values.append(g["log"].to_numpy(float))
                if not len(d):
                    continue
                if ready is None:
                    k, v = np.concatenate(keys), np.concatenate(values)
                    order = np.argsort(k)
                    ready = Lookup(k[order], v[order])
                    keys, values = [], []
                for doc_id, learn, text in (row for pack in d["word"] for row in _unpacked(pack)):
                    found = tokens(text)
                    data = spelled(found)
                    s = float(ready.of(windows(data)).sum())
                    n = len(data) - DEPTH
                    found.append(b"")  # the end
                    each = [logs[t] for t in found]
                    known, total = len(each) - each.count(-base), math.fsum(each)
                    out.append((doc_id, not learn, len(found), known, n_all, total, s, n, -s / n / np.log10(2.0)))
            yield pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]).astype({"doc_id": "Int64"})

    parts = slices.union(texts).repartitionById(blocks, "block").sortWithinPartitions("block", "kind")
    return parts.mapInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")


class Lookup:
    """Values by integer key, vectorised: a table of key hashes with a few probes, then search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(8, int(len(keys) * 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, np.int32)
        self.table[self._hash(keys)[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys that all occur."""
        at = self.table[self._hash(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        if len(missed):
            at[missed] = np.searchsorted(self.keys, keys[missed])
        return self.values[at]
