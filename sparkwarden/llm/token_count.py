"""Token counts by heap-and-linked-list byte-pair merging.

A pretoken's symbols form a doubly linked list; the adjacent pair of lowest rank
is popped from a heap again and again; each pop merges two symbols.  The count
is the number of initial symbols minus the number of merges: no identifiers are
made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, ship, text_of
from .vocab import merges, spelled

#: Fixed value: the pretoken pattern of the byte-level vocabulary.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Unicode white space without the separators U+001C to U+001F, which that pattern's \s leaves out.
WHITE = "\t-\r \x85\xa0  -     　"
#: White space with the stretch that follows it.  No pretoken crosses the end of such a unit.
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Results kept per Python worker and table, and the longest text that is kept: bounds on
#: memory, not on texts (a full table starts anew).
KEPT, KEPT_CHARS = 250_000, 64


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left once no adjacent pair has a rank."""
    n = left = len(symbols)
    get = ranks.get
    # A heap entry is rank and place in one integer: of equal ranks the leftmost is popped first.
    heap = [r << 32 | i for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := get(pair)) is not None]
    if not heap:
        return n
    heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    text: list[str | None] = list(symbols)
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFF
        a, j = text[i], after[i]
        # An entry is stale if its pair has changed since it was pushed.
        if a is None or j >= n or get((a, text[j])) != top >> 32:
            continue
        text[i] = c = a + text[j]
        text[j] = None
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := get((c, text[k]))) is not None:
                heappush(heap, r << 32 | i)
        if (h := before[i]) >= 0 and (r := get((text[h], c))) is not None:
            heappush(heap, r << 32 | h)
    return left


class _Kept(dict):
    """A table that computes what it misses and starts anew when full."""

    def __init__(self, compute, most: int = KEPT):
        self.compute, self.most = compute, most

    def __missing__(self, key: str):
        value = self.compute(key)
        if len(key) <= KEPT_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


@lru_cache(maxsize=4)
def _unit_counts(path: str) -> _Kept:
    table = merges(path)
    pretokens = _Kept(lambda p: merged_count(table.symbols(spelled(p)), table.ranks))
    return _Kept(lambda unit: sum([pretokens[p] for p in PRETOKEN.findall(unit)]))


def counter(path: str):
    """A function from text to its number of tokens under the vocabulary file."""
    table = merges(path)
    added = re.compile("(" + "|".join(map(re.escape, sorted(table.added, key=len, reverse=True))) + ")") if table.added else None
    get, units, marks = _unit_counts(path).__getitem__, UNIT.findall, tuple(table.added)

    def count(text: str) -> int:
        if added is not None and any(m in text for m in marks):
            parts = added.split(text)
            return len(parts) // 2 + sum(sum(map(get, units(p))) for p in parts[::2])
        return sum(map(get, units(text)))

    return count


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """Number of tokens of every whole text.

    docs: doc_id, text (other columns are ignored).  Returns doc_id, n_bytes,
    n_tokens (long), over_limit.  A null or empty text has no bytes and no
    tokens; a null doc_id stays null; repeated rows give repeated results; an
    empty table gives an empty result.  Counts depend on the row alone: no shuffle.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(vocabulary)
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    rows = dealt(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n_tokens("text").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
