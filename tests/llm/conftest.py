import random

import pytest

#: Names that operators use inside; as extra columns they must not clash.
EXTRA = ("size", "taken", "block", "words", "fingerprint", "node", "component", "shard", "own", "digest", "n", "score")


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text[, source]) as a documents table with clashing extra columns."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", 7) + ("x",) * len(EXTRA) for r in rows]
        schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def corpus():
    """Texts with near copies, copies, empty, null, accents, very long ones; repeated and null ids."""
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "éclair", "über", "the", "of", "and", "zeta", "Eta", "THETA", "iota,", "x#y", "12"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randint(0, 120)), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "s0") for i in range(5)]
    long = text(4000)
    rows += [(200, long, "s1"), (201, long + " tail", "s1"), (202, "", None), (203, None, "s2"), (None, "no id here", "s2"), (5, rows[5][1], "s1"), (204, "\n \t\x0b", "s0"), (205, "one", "s0"), (206, "<|endoftext|> mid <|startoftext|>", "s1"), (207, "Licensed under CC BY. All rights reserved. cc-by cc by", "s1")]
    return rows
