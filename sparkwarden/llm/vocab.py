"""Reading of public tokenizer files into plain merge tables."""

from __future__ import annotations

import json
from functools import lru_cache


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte value.

    Printable bytes stand for themselves; the rest take code points from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    table = {b: chr(b) for b in shown}
    return [table[b] if b in table else chr(next(spare)) for b in range(256)]


def spelled(token: str) -> str:
    """A pretoken's UTF-8 bytes in byte letters."""
    letters = byte_letters()
    return "".join([letters[b] for b in token.encode("utf-8", "surrogatepass")])


class Merges:
    """Vocabulary, merge ranks and added tokens of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        model = doc["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks: dict[tuple[str, str], int] = {p: i for i, p in enumerate(pairs)}
        self.added: dict[str, int] = {a["content"]: a["id"] for a in doc["added_tokens"]}

    def symbols(self, letters: str) -> list[str]:
        """A spelled pretoken's initial symbols; the last carries the word end."""
        out = list(letters)
        if out:
            out[-1] += self.end
        return out


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    """One table per file and worker."""
    return Merges(path)
