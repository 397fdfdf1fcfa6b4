"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a pretoken exactly one last token is possible: the token
whose own encoding is itself and that is *compatible* with the last token of
what stands before it.  An automaton over the vocabulary lists the tokens that
end at each position; the table of last tokens is filled left to right, and
following it backwards from the end gives the ids.

Two tokens are compatible if merging their joint spelling never merges across
their border.  Only the symbols along the border matter: the right spine of the
left token's merge tree and the left spine of the right token's.  They are
climbed in order of merge rank, and at each pair that exists together the border
merge must come later than the next climb.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, ship, text_of
from .token_count import WHITE, _Kept
from .vocab import Merges, merges, spelled

#: Fixed value: the pretoken pattern of the word-end vocabulary.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
NOT_WHITE = re.compile(f"[^{WHITE}]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Encoded stretches kept per Python worker beside other stages' memory: a bound, not on texts.
KEPT_IDS = 100_000
NEVER = 1 << 60


def merge_tree(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[tuple]:
    """The roots that are left after merging; a node is (text, rank, left, right)."""
    nodes: list[tuple] = [(s, -1, None, None) for s in symbols]
    while len(nodes) > 1:
        best, at = min((ranks.get((nodes[i][0], nodes[i + 1][0]), NEVER), i) for i in range(len(nodes) - 1))
        if best == NEVER:
            break
        a, b = nodes[at], nodes[at + 1]
        nodes[at : at + 2] = [(a[0] + b[0], best, a, b)]
    return nodes


def spine(root: tuple, side: int) -> list[tuple[str, int]]:
    """From the border leaf up to the root: each symbol and the rank at which it
    is merged into the next one (the root: never).  side 2 is left, 3 is right."""
    out, node, above = [], root, NEVER
    while node is not None:
        out.append((node[0], above))
        node, above = node[side], node[1]
    return out[::-1]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, table: Merges):
        self.table = table
        self.end = table.end
        self.automaton = ahocorasick.Automaton()
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        self.size: dict[int, int] = {}
        self.text = {i: s for s, i in table.ids.items()} | {i: s for s, i in table.added.items()}
        for token, i in table.ids.items():
            final = bool(self.end) and token.endswith(self.end)
            letters = token[: -len(self.end)] if final else token
            if not letters:
                continue
            symbols = list(letters)
            if final:
                symbols[-1] += self.end
            roots = merge_tree(symbols, table.ranks)
            if len(roots) > 1:
                continue  # no text is ever encoded with it
            self.right[i], self.left[i] = spine(roots[0], 3), spine(roots[0], 2)
            # The word end is written as one letter, so that it matches only at the end.
            key = letters + "\0" if final else letters
            self.size[i] = len(key)
            self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()
        self._fits = lru_cache(maxsize=1 << 17)(self._compatible)

    def _compatible(self, a: int, b: int) -> bool:
        xs, ys, rank = self.right[a], self.left[b], self.table.ranks
        i = j = 0
        while True:
            (x, up_x), (y, up_y) = xs[i], ys[j]
            r = rank.get((x, y), NEVER)
            # Of equal ranks the leftmost pair is merged first.
            if r < up_x and r <= up_y and r != NEVER:
                return False
            if up_x == up_y == NEVER:
                return True
            if up_x <= up_y:
                i += 1
            else:
                j += 1

    def encode_word(self, letters: str) -> list[int]:
        """Ids of one spelled pretoken."""
        if self.end:
            letters += "\0"
        n = len(letters)
        last = [-1] * n  # of the prefix that ends here, inclusive
        fits, done = self._fits, -1
        for at, (token, length) in self.automaton.iter(letters):
            if at != done:
                before = at - length
                if before == -1 or ((p := last[before]) >= 0 and fits(p, token)):
                    last[at] = token
                    done = at
        out, size, at = [], self.size, n - 1
        while at >= 0:
            token = last[at]
            out.append(token)
            at -= size[token]
        return out[::-1]

    def normal(self, text: str) -> str:
        """NFC, then lower case letter by letter (no final-sigma rule)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                return "".join([c.lower() for c in text])
        return text.lower()

    def stretches(self, text: str) -> list[str]:
        """Normalised stretches without white space."""
        text = self.normal(text)
        return NOT_WHITE.findall(text) if ODD_SPACE.search(text) else text.split()

    def pretokens(self, stretch: str) -> list[str]:
        return [stretch] if stretch.isalpha() else PRETOKEN.findall(stretch)

    def encode_stretch(self, stretch: str) -> list[int]:
        return [i for p in self.pretokens(stretch) for i in self.encode_word(spelled(p))]

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """The text cut at added tokens: whether a part is one, and the part."""
        marks = self.table.added
        if not any(m in text for m in marks):
            yield False, text
            return
        cut = re.compile("(" + "|".join(map(re.escape, sorted(marks, key=len, reverse=True))) + ")")
        for k, p in enumerate(cut.split(text)):
            yield bool(k % 2), p

    def encode(self, text: str) -> list[int]:
        """Exact ids of a whole text."""
        out: list[int] = []
        for special, part in self.parts(text):
            if special:
                out.append(self.table.added[part])
            else:
                for s in self.stretches(part):
                    out += self.encode_stretch(s)
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's texts of the ids, one space between (the file names no decoder)."""
        return " ".join([self.text[i] for i in ids])


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per vocabulary file and worker."""
    return Codec(merges(path))


@lru_cache(maxsize=4)
def _written(path: str) -> _Kept:
    """Stretch to its ids in decimals and its decoded text; pretokens are kept apart,
    as "word" and "word," share one."""
    c = codec(path)

    def pretoken(p: str) -> tuple[str, str]:
        ids = c.encode_word(spelled(p))
        return " ".join(map(str, ids)), c.decode(ids)

    words = _Kept(pretoken)

    def stretch(s: str) -> tuple[str, str]:
        found = c.pretokens(s)
        if len(found) == 1:
            return words[found[0]]
        ids, back = zip(*[words[p] for p in found])
        return " ".join(ids), " ".join(back)

    return _Kept(stretch)


@lru_cache(maxsize=4)
def _known_ids(path: str) -> _Kept:
    """Stretch to its ids; pretokens are kept apart."""
    c = codec(path)
    words = _Kept(lambda p: tuple(c.encode_word(spelled(p))), KEPT_IDS)

    def stretch(s: str) -> tuple[int, ...]:
        found = c.pretokens(s)
        return words[found[0]] if len(found) == 1 else tuple([i for p in found for i in words[p]])

    return _Kept(stretch, KEPT_IDS)


def bpe_encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Every whole text's ids: doc_id, ids (array of int).

    A null or empty text has no ids; nulls in other columns and repeated rows pass
    through; an empty table gives an empty result.  No shuffle.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(vocabulary)
        get = _known_ids(vocabulary).__getitem__
        for texts in batches:
            out = []
            for t in texts:
                row: list[int] = []
                for special, part in c.parts(t):
                    if special:
                        row.append(c.table.added[part])
                    else:
                        for found in map(get, c.stretches(part)):
                            row += found
                out.append(np.array(row, np.int32))
            yield pd.Series(out)

    return dealt(docs, "doc_id", "text").select("doc_id", ids(text_of()).alias("ids"))


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Texts of id arrays: doc_id, ids -> doc_id, text.  Null ids give the empty text."""
    ship(encoded.sparkSession)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(vocabulary)
        for rows in batches:
            yield pd.Series(["" if r is None else c.decode([int(i) for i in r]) for r in rows], dtype="object")

    return dealt(encoded, "doc_id", "ids").select("doc_id", text("ids").alias("text"))


def bpe_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of every whole text's ids and of their decoded text.

    Returns doc_id, n_tokens (long), ids_sha256, decoded_sha256.  The same edge
    cases as bpe_encode; the digests of an empty text are those of no bytes.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary)
        get = _written(vocabulary).__getitem__
        for texts in batches:
            out = []
            for t in texts:
                found: list[tuple[str, str]] = []
                for special, part in c.parts(t):
                    if special:
                        found.append((str(c.table.added[part]), part))
                    else:
                        found += map(get, c.stretches(part))
                ids = " ".join([f[0] for f in found]).encode()
                back = " ".join([f[1] for f in found]).encode()
                out.append((ids.count(b" ") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return dealt(docs, "doc_id", "text").select("doc_id", digests(text_of()).alias("d")).select("doc_id", "d.*")
