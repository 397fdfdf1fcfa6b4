"""SimHash near-duplicates by anchor-point covering.

Fingerprints are compared through a covering code instead of with each other.  The
perfect binary Golay code covers 23 bits with radius 3: every 23-bit word has just
one codeword (its home) within 3 bits.  Two such blocks of a fingerprint name an
anchor, a pair of codewords.  A fingerprint y that differs from x in t bits, e1 and
e2 of them in the two blocks, lies within 3 + e1 and 3 + e2 bits of x's home; so y
is replicated to every anchor within covering radius plus threshold, the excess
over the radius shared between the blocks, and each anchor compares its own
fingerprints with what has been replicated to it.  No link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import connected_components
from .common import dealt, forget, ship, stored, text_of
from .fingerprint import shingle_hashes

SEED = 42
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101
LENGTH, CHECKS, RADIUS = 23, 11, 3
#: Pairs compared at once in a task: a bound on memory, not on pairs.
AT_ONCE = 4_000_000


def shingle_simhash(text: str, words: int = 3) -> int:
    """64 bits: one where over half of the shingles' XXH64 have it set."""
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    k, h64 = min(words, len(found)), xxhash.xxh64_intdigest
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(found) - k + 1
    h = np.fromiter([h64(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist())], np.uint64, n)
    return majority(h)


def majority(h: np.ndarray, weights: np.ndarray | None = None) -> int:
    """The bits set in over half of the hashes (by weight)."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # whole long texts, in bounded memory
        bits = np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64) if weights is None else weights[at : at + (1 << 16)] @ bits
    whole = len(h) if weights is None else int(weights.sum())
    return int.from_bytes(np.packbits(2 * total > whole, bitorder="little").tobytes(), "little")


def word_simhash(text: str) -> int:
    """64 bits over single words by their counts: edits of a few words in a hundred move few bits."""
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    counts: dict[bytes, int] = {}
    for w in found:
        counts[w] = counts.get(w, 0) + 1
    h = np.fromiter([xxhash.xxh64_intdigest(w, SEED) for w in counts], np.uint64, len(counts))
    return majority(h, np.fromiter(counts.values(), np.int64, len(counts)))


def _remainder(x: np.ndarray) -> np.ndarray:
    """Syndromes: remainders by the generator polynomial."""
    x = x.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        x = np.where(x >> bit & 1, x ^ (GOLAY << (bit - CHECKS)), x)
    return x


class Covering:
    """Anchors around 23-bit words, by syndrome and by excess over the radius."""

    def __init__(self, threshold: int):
        self.threshold = threshold
        patterns = np.array([sum(1 << i for i in c) for w in range(RADIUS + threshold + 1) for c in combinations(range(LENGTH), w)], np.int64)
        excess = np.maximum(0, np.bitwise_count(patterns).astype(np.int64) - RADIUS)
        syndrome = _remainder(patterns)
        order = np.lexsort((patterns, excess, syndrome))
        self.patterns, self.excess = patterns[order], excess[order]
        self.start = np.searchsorted(syndrome[order], np.arange(1 << CHECKS))
        counts = np.zeros((1 << CHECKS, threshold + 1), np.int64)
        np.add.at(counts, (syndrome, excess), 1)
        self.within = counts.cumsum(axis=1)
        high = np.arange(1 << (LENGTH - CHECKS), dtype=np.int64) << CHECKS
        self.high = _remainder(high)

    def around(self, x: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word every codeword within radius plus room: row, codeword, excess used."""
        syndrome = self.high[x >> CHECKS] ^ (x & ((1 << CHECKS) - 1))
        n = self.within[syndrome, room]
        row = np.repeat(np.arange(len(x)), n)
        at = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(self.start[syndrome], n)
        return row, x[row] ^ self.patterns[at], self.excess[at]


@lru_cache(maxsize=4)
def covering(threshold: int) -> Covering:
    return Covering(threshold)


def anchors(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor and whether the anchor is the fingerprint's home."""
    c = covering(threshold)
    low = (1 << LENGTH) - 1
    one = (prints & np.uint64(low)).astype(np.int64)
    two = (prints >> np.uint64(LENGTH) & np.uint64(low)).astype(np.int64)
    row, word, used = c.around(one, np.full(len(prints), threshold))
    again, word2, used2 = c.around(two[row], threshold - used)
    row, used = row[again], used[again] + used2
    # A codeword's leading 12 bits tell it from all others.
    anchor = (word[again] >> CHECKS) << (LENGTH - CHECKS) | word2 >> CHECKS
    return row, anchor.astype(np.int32), used == 0


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links: as connected, without all pairs of a group."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _linked(anchor: np.ndarray, prints: np.ndarray, home: np.ndarray, node: np.ndarray, check: np.ndarray, threshold: int, check_bits: int) -> pd.DataFrame:
    """Links within whole anchor groups; rows are sorted by anchor."""
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.append(first, len(anchor)))
    group = np.repeat(np.arange(len(first)), size)
    homes = np.flatnonzero(home & (size[group] > 1))
    out: list[tuple[int, int]] = []
    n = size[group[homes]]
    total = n.cumsum()
    at = 0
    while at < len(homes):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
        h, m = homes[at:stop], n[at:stop]
        left = np.repeat(h, m)
        right = np.arange(m.sum()) - np.repeat(m.cumsum() - m, m) + np.repeat(first[group[h]], m)
        near = (np.bitwise_count(prints[left] ^ prints[right]) <= threshold) & (node[left] != node[right])
        left, right = left[near], right[near]
        if check_bits < 64:
            near = np.bitwise_count(check[left] ^ check[right]) <= check_bits
            left, right = left[near], right[near]
        out += _forest(node[left], node[right])
        at = stop
    return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])


def links(prints: DataFrame, threshold: int, check_bits: int = 64) -> DataFrame:
    """Distinct rows (node, fingerprint, check: long) -> a, b: links that join all nodes
    which chains of differences of at most threshold bits connect (and, with check_bits
    under 64, of at most so many bits in the second fingerprint).

    Within an anchor's group a spanning forest stands for all pairs.
    """
    spark = prints.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    checked = check_bits < 64
    columns = ["anchor", "fingerprint", "home"] + (["node", "check"] if checked else [])

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 4096):
                part = rows.iloc[at : at + 4096]
                p = part["fingerprint"].to_numpy(np.int64)
                row, anchor, home = anchors(p.view(np.uint64), threshold)
                out = {"anchor": anchor, "fingerprint": p[row], "home": home}
                if checked:
                    out |= {c: part[c].to_numpy(np.int64)[row] for c in ("node", "check")}
                yield pd.DataFrame(out)

    def linked(part: list[np.ndarray]) -> pd.DataFrame:
        anchor, p, home, *more = part
        node, check = more or (p.view(np.int64), p)
        return _linked(anchor, p, home, node, check.view(np.uint64), threshold, check_bits)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in batches:
            if not len(rows):
                continue
            part = [rows[c].to_numpy() for c in columns]
            part[1] = part[1].astype(np.int64).view(np.uint64)
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part)]
            cut = int(np.searchsorted(part[0], part[0][-1]))
            held = [x[cut:] for x in part]
            if cut:
                yield linked([x[:cut] for x in part])
        if held is not None:
            yield linked(held)

    given = prints.select("fingerprint", "node", "check") if checked else prints.select("fingerprint")
    spread = given.mapInPandas(replicate, "anchor int, fingerprint long, home boolean" + ", node long, check long" * checked)
    return spread.repartition(n, "anchor").sortWithinPartitions("anchor").mapInPandas(compare, "a long, b long")


def simhashes(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text -> doc_id, fingerprint (long).  A null text is empty; no words: zero.  No shuffle."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([shingle_simhash(t, words) for t in texts], np.uint64).view(np.int64))

    return dealt(docs, "doc_id", "text").select("doc_id", of(text_of()).alias("fingerprint"))


def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 2) -> DataFrame:
    """Every document's SimHash and the component it reaches over links of at most
    threshold differing bits.

    Returns doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest
    doc_id reachable).  Documents without words have fingerprint zero and are linked
    like any other; repeated rows and ids share a component; a component whose ids
    are all null has none; an empty table gives no rows.
    """
    prints = stored(simhashes(docs, words), "simhash")
    firsts = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    groups = connected_components(links(firsts, threshold))
    joined = firsts.join(groups.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("component"))
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    known = joined.join(least, "component").select("fingerprint", "component_id")
    return prints.join(known, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


#: The filter's shingles and likeness, its bits over single words, and the bits over
#: shingles beyond which the first pass does not link a pair.
FILTER_WORDS, LIKENESS, FILTER_BITS, CHECK_BITS = 5, 0.8, 2, 14
#: Shingles whose hash is less than this (three in eight) are counted first.
SAMPLE = np.uint64(3 << 61)


def _node(text: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(text.encode("utf-8", "replace").lower().split()))).astype(np.int64))


def _least_shared(size: Column, likeness: float) -> Column:
    """The fewest elements that a set of this size shares with any set so much like it."""
    return F.ceil(F.lit(likeness) * size - 1e-6)


#: Sampled shingles that a task compares before it sends on: a bound on memory, not on shingles.
TOGETHER = 1_000_000
#: Stands for the sets that a task has already found to share a shingle.
SEVERAL = 0


def _alike(token: np.ndarray) -> np.ndarray:
    """Whether an equal element stands beside each element of a sorted array."""
    same = token[1:] == token[:-1]
    found = np.zeros(len(token), bool)
    found[1:] |= same
    found[:-1] |= same
    return found


def _with_company(nodes: DataFrame, likeness: float) -> DataFrame:
    """nodes (node, size, sample) -> node: all that can have a near copy.

    A set lacks at most size - least shared of its shingles in its near copy, so of its
    sampled ones all but so many occur in another set too.  A task counts what its own sets
    share at once and sends each shingle on once, so a shingle that very many sets have
    comes to a task as often as there are tasks before it.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counted(node: np.ndarray) -> pd.DataFrame:
        """A row a set: within a task a set is whole."""
        which, count = np.unique(node, return_counts=True)
        return pd.DataFrame({"token": 0, "node": which, "met": count})

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows with met: shingles that a set shares within the task; without: shingles to compare."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> Iterator[pd.DataFrame]:
            token, node = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(token, kind="stable")
            token, node = token[order], node[order]
            found = _alike(token)
            yield counted(node[found])
            first = np.concatenate(([True], token[1:] != token[:-1]))
            yield pd.DataFrame({"token": token[first], "node": np.where(found[first], SEVERAL, node[first]), "met": 0})

        for rows in batches:
            for node, sample in zip(rows["node"].tolist(), rows["sample"]):
                held.append((np.asarray(sample, np.int64), np.full(len(sample), node, np.int64)))
                size += len(sample)
                if size > TOGETHER:
                    yield from sent()
                    size = 0
        if held:
            yield from sent()

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row a shingle and set; the sets' other shingles are in other tasks."""
        parts = [(rows["token"].to_numpy(np.int64), rows["node"].to_numpy(np.int64)) for rows in batches if len(rows)]
        if not parts:
            return
        token, node = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(token, kind="stable")
        node = node[order][_alike(token[order])]
        node = node[node != SEVERAL]
        for at in range(0, len(node), 100_000):
            yield pd.DataFrame({"token": 0, "node": node[at : at + 100_000], "met": 1})

    kind = "token long, node long, met long"
    own = stored(nodes.select("node", "sample").mapInPandas(within, kind), "near-sample")
    others = own.where("met = 0").select("token", "node").repartition(n, "token").mapInPandas(across, kind)
    counts = own.where("met > 0").select("node", "met").union(others.select("node", "met")).groupBy("node").agg(F.sum("met").alias("met"))
    joined = nodes.select("node", "size", F.size("sample").alias("sampled")).where("size > 0").join(counts, "node", "left")
    some = joined.where(F.coalesce("met", F.lit(0)) >= F.col("sampled") - (F.col("size") - _least_shared(F.col("size"), likeness))).select("node")
    some = stored(some, "near-some")
    forget(own)
    return some


def _prefixes(sets: DataFrame, likeness: float) -> DataFrame:
    """sets (node, s) -> node, size, token, after, alone: of each set's shingles from rare to
    frequent the first size - least shared + 1, without those that no other set has.  Two
    sets of the likeness share one of them; after is the number of shingles behind it, alone
    how many of the set's shingles no other set has."""
    listed = sets.select("node", F.size("s").alias("size"), F.explode("s").alias("token"))
    often = listed.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    met = listed.join(often, "token")
    own = Window.partitionBy("node")
    alone = F.col("size") - F.count("*").over(own)
    placed = met.withColumn("alone", alone).withColumn("place", F.col("alone") + F.row_number().over(own.orderBy("n", "token")))
    kept = placed.where(F.col("place") <= F.col("size") - _least_shared(F.col("size"), likeness) + 1)
    return stored(kept.select("node", "size", "token", (F.col("size") - F.col("place")).alias("after"), "alone"), "near-prefixes")


def _relabelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """rows whose component in the column has the label (old -> new) that it was merged into."""
    return rows.join(labels.withColumnRenamed("old", column), column, "left").withColumn(column, F.coalesce("new", column)).drop("new")


def _merged(labels: DataFrame, pairs: DataFrame, of: DataFrame) -> DataFrame:
    """labels (old -> new), after pairs (a, b) of nodes have joined their components; of: node,
    component.  Only the components that pairs join are gone through, not their members."""
    end = lambda x: of.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")).distinct()
    joined = pairs.join(end("a"), "a").join(end("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b")
    more = connected_components(joined).select(F.col("node").alias("old"), F.col("component").alias("new"))
    before = labels.join(more.select(F.col("old").alias("new"), F.col("new").alias("newer")), "new", "left").select("old", F.coalesce("newer", "new").alias("new"))
    return stored(before.union(more.join(labels.select("old"), "old", "left_anti").select("old", "new")), "near-labels")


def _mains(rows: DataFrame, turn: int) -> DataFrame:
    """token, main, hub, hub_size, members, inside: of each shingle whose members are in several
    components, the largest of them, how many members it has, and one that stands for it.

    At first that is the member with the fewest shingles of its own, as an original has
    beside its edited copies; in later turns another one each time.
    """
    rank = F.struct(F.col("alone") if turn == 0 else F.xxhash64(F.lit(turn), "node").alias("alone"), "node", "size")
    parts = rows.groupBy("token", "component").agg(F.count("*").alias("k"), F.min(rank).alias("hub"))
    mains = parts.groupBy("token").agg(F.max(F.struct("k", "component", "hub")).alias("m"), F.count("*").alias("groups"), F.sum("k").alias("members")).where("groups > 1")
    return stored(mains.select("token", F.col("m.component").alias("main"), F.col("m.hub.node").alias("hub"), F.col("m.hub.size").alias("hub_size"), "members", F.col("m.k").alias("inside")), "near-mains")


def _to_hubs(rows: DataFrame, mains: DataFrame, likeness: float) -> DataFrame:
    """Pairs a, b of a shingle's members outside its main component with the main one's hub."""
    like = (F.col("size") >= likeness * F.col("hub_size") - 1e-6) & (F.col("hub_size") >= likeness * F.col("size") - 1e-6)
    met = rows.join(mains, "token").where((F.col("component") != F.col("main")) & like)
    return stored(met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "near-candidates")


def _across(rows: DataFrame, mains: DataFrame, likeness: float) -> DataFrame:
    """Every pair a, b of nodes in different components that share a prefix shingle and can
    have the likeness.  A shingle's main component meets only the members of others."""
    rows = rows.join(mains.select("token", "main"), "token")
    side = lambda x: [F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("after").alias(f"l{x}"), F.col("component").alias(f"c{x}")]
    a = rows.where("component <> main").select("token", *side("a"))
    b = rows.select("token", (F.col("component") == F.col("main")).alias("in_main"), *side("b"))
    # Behind the first shingle that two sets share lie all the others.
    enough = 1 + F.least("la", "lb") >= F.lit(likeness / (1 + likeness)) * (F.col("na") + F.col("nb")) - 1e-6
    like = (F.col("na") >= likeness * F.col("nb") - 1e-6) & (F.col("nb") >= likeness * F.col("na") - 1e-6)
    met = a.join(b, "token").where((F.col("in_main") | (F.col("a") < F.col("b"))) & (F.col("ca") != F.col("cb")) & like & enough)
    return stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-candidates")


#: Turns in which members meet one of the main component each, and how many members outside
#: it a shingle must have for that.
HUB_TURNS, HEAVY = 6, 32


def near_duplicate_filter(docs: DataFrame, words: int = FILTER_WORDS, likeness: float = LIKENESS) -> DataFrame:
    """docs without near copies: of each group the row of least doc_id stays.

    Groups are those that chains of pairs with at least the likeness (Jaccard, of the
    word-shingle sets) connect, without exception.  First come links between texts whose
    SimHashes over word counts differ in at most FILTER_BITS bits, found at covering
    anchors, each checked exactly; then a prefix filter over the shingle sets gives every
    other pair that can have the likeness and is not yet in one group, checked likewise.
    Texts with the same words are copies at once.  Texts without words are copies of
    each other; rows that repeat an id and its text stay once; null ids come last.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("node long, size int, sample array<long>")
    def samples_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                s = np.unique(shingle_hashes(t, words))
                rows.append((_node(t), len(s), s[s < SAMPLE].view(np.int64)))
            yield pd.DataFrame(rows, columns=["node", "size", "sample"])

    @F.pandas_udf("node long, fingerprint long, check long, s array<long>")
    def sets_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        signed = lambda x: np.uint64(x).astype(np.int64)
        for texts in batches:
            rows = []
            for t in texts:
                h = shingle_hashes(t, words)
                rows.append((_node(t), signed(word_simhash(t)), signed(majority(h)), np.unique(h).view(np.int64)))
            yield pd.DataFrame(rows, columns=["node", "fingerprint", "check", "s"])

    # A row is known by its id and its text's hash; the hash alone decides nothing.
    known_text = F.xxhash64(text_of()).alias("tid")
    rows = dealt(docs, "doc_id", "text").select("doc_id", known_text, samples_of(text_of()).alias("p")).select("doc_id", "tid", "p.*")
    rows = stored(rows, "near-rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("head")
    nodes = stored(rows.groupBy("node").agg(least, F.first("size").alias("size"), F.first("sample").alias("sample"), F.count("*").alias("n")), "near-nodes")
    some = _with_company(nodes, likeness)
    holders = nodes.join(some, "node").select("head.tid", F.col("node").alias("held"))
    texts = dealt(docs, "text").select(text_of().alias("text"), known_text).join(holders, "tid").select("held", sets_of("text").alias("p"))
    sets = stored(texts.where("p.node = held").select("p.*").dropDuplicates(["node"]), "near-sets")

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs that have the likeness.  Only the sets of a pair's two ends move."""
        ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "a", "b"), F.struct(F.col("b").alias("node"), "a", "b"))).alias("e")).select("e.*")
        both = sets.select("node", "s").join(_small(ends), "node").groupBy("a", "b")
        both = both.agg(F.max(F.when(F.col("node") == F.col("a"), F.col("s"))).alias("sa"), F.max(F.when(F.col("node") == F.col("b"), F.col("s"))).alias("sb"))
        shared = F.size(F.array_intersect("sa", "sb"))
        return both.where(shared >= likeness * (F.size("sa") + F.size("sb") - shared)).select("a", "b")

    near = stored(links(sets.select("node", "fingerprint", "check"), FILTER_BITS, CHECK_BITS).distinct(), "near-candidates")
    close = stored(checked(near), "near-close")
    prefixes = _prefixes(sets.select("node", "s"), likeness)
    # A large family first joins its main component through one member at a time; then every
    # pair across the components that are left is looked at, so no link is lost.
    first = stored(connected_components(close), "near-groups")
    labels = stored(first.select(F.col("node").alias("old"), F.col("component").alias("new")), "near-labels")
    members = stored(_relabelled(prefixes.withColumn("component", F.col("node")), labels, "component"), "near-members")
    mains = _mains(members, 0)
    heavy = stored(members.join(mains.where(F.col("members") - F.col("inside") > HEAVY).select("token"), "token", "left_semi"), "near-heavy")
    for turn in range(HUB_TURNS):
        hubs = _mains(heavy, turn)
        candidates = _to_hubs(heavy, hubs, likeness)
        found = stored(checked(candidates), "near-found")
        forget(hubs, candidates)
        if found.isEmpty():
            forget(found)
            break
        merged = _merged(labels, found, heavy.select("node", "component"))
        again = stored(_relabelled(heavy, merged, "component"), "near-heavy")
        forget(labels, heavy, found)
        labels, heavy = merged, again
    forget(mains, heavy)
    now = stored(_relabelled(members, labels, "component"), "near-members")
    mains = _mains(now, 0)
    far = _across(now, mains, likeness)
    found = stored(checked(far), "near-found")
    labels, before = _merged(labels, found, now.select("node", "component")), labels
    forget(before, members, now, mains, far, found)
    groups = labels.select(F.col("old").alias("node"), F.col("new").alias("component"))
    of = nodes.select("node", "head", "n").join(groups, "node", "left").select("node", "head", "n", F.coalesce("component", "node").alias("component"))
    # Of a group the row of the least id stays; rows without an id come last.
    heads = of.groupBy("component").agg(F.min("head").alias("head"), F.sum("n").alias("rows")).where("rows > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("tid") == F.col("head.tid"))
    losers = rows.select("doc_id", "tid", "node").join(of.select("node", "component").join(heads, "component").select("node", "head"), "node").where(~stays)
    losers = stored(losers.select(F.col("doc_id").alias("lost"), F.col("tid").alias("lost_tid")).distinct(), "near-lost")
    again = not rows.groupBy("doc_id", "tid").count().where("count > 1").isEmpty()
    forget(rows, nodes, some, sets, near, close, first, prefixes, labels)
    name = "__tid"
    while name in docs.columns:
        name += "_"
    kept = docs.withColumn(name, known_text)
    kept = kept.join(losers, kept["doc_id"].eqNullSafe(losers["lost"]) & (kept[name] == losers["lost_tid"]), "left_anti")
    if again:
        kept = kept.dropDuplicates(["doc_id", name])
    return kept.drop(name)


#: Pairs that are sent to every task; more are dealt out by a shuffle of the sets.
SENT_PAIRS = 200_000


def _small(ends: DataFrame) -> DataFrame:
    """Broadcast, if the (stored, thus countable) pairs are few."""
    return F.broadcast(ends) if ends.count() <= 2 * SENT_PAIRS else ends
