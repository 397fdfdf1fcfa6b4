"""Quality rules as a short-circuit cascade.

A figure is a column expression over the text and its words; a rule compares a few figures.
On a bounded sample each rule's cost (seconds beyond those of a rule that looks at nothing)
and selectivity (share it rejects) are measured; rules run in the order of rejections per
second of cost, and a text that one rule rejects reaches no later rule.  The order changes
the cost, never the verdict: a text is kept if no rule rejects it.  DataFrame functions only.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, dealt, forget, stored, text_of

#: Words that a text must have, and the share (in %) of words in repeated windows it may have.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Symbols in 100 words, duplicate lines in 100 lines, and mean letters a word that a text may have.
MAX_SYMBOLS, MAX_DUP_LINES, WORD_LETTERS = 10, 60, (2, 20)
#: Bulleted lines and lines that end in an ellipsis in 100 lines that a text may have, and
#: words with a letter in 100 words that it must have.
MAX_BULLETS, MAX_ELLIPSES, MIN_LETTER_WORDS = 90, 30, 60
#: Rows of the sample on which costs and selectivities are estimated, how often a timed job
#: goes over them, and how often it is timed.
SAMPLE_ROWS, TURNS, TIMES = 512, 4, 3
SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+`."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def symbols_of(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \t-\r]"))


def dup_lines_of(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sort by hash, keep what has an
    equal neighbour, add up the union of the windows by start.  n log n for any text."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        return F.array_compact(F.transform(s, lambda x, k: F.when(same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), x["i"])))

    def union(p: Column) -> Column:
        first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(F.sort_array(p), first, lambda a, x: F.struct(x.alias("last"), (a["total"] + F.least(F.lit(3), x - a["last"])).alias("total")), lambda a: a["total"])

    return let(placed, lambda s: union(starts(s)))


def repeat_words_of(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more (windows by 64-bit hash)."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 4, 0).otherwise(let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_covered(w))))


def letter_words_of(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.rlike(r"\p{L}")))


#: Figures by name, from (text, words).
FIGURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words),
    "word_chars": lambda text, words: F.char_length(F.array_join(words, "")),
    "n_symbols": lambda text, words: symbols_of(text),
    "n_lines": lambda text, words: F.size(lines_of(text)),
    "n_dup_lines": lambda text, words: dup_lines_of(text),
    "n_repeat_words": lambda text, words: repeat_words_of(words),
    "n_bullets": lambda text, words: F.size(F.filter(lines_of(text), lambda x: x.rlike(r"^[ \t]*[-*•]"))),
    "n_ellipses": lambda text, words: F.size(F.filter(lines_of(text), lambda x: x.rlike(r"(\.\.\.|…)[ \t\r]*$"))),
    "n_letter_words": lambda text, words: letter_words_of(words),
}


@dataclass(frozen=True)
class Rule:
    """rejects: from the named figures to whether the text is rejected (never null)."""

    name: str
    figures: tuple[str, ...]
    rejects: Callable[..., Column]

    def of_text(self, text: Column, words: Column) -> Column:
        """The rule over figures of its own."""
        return self.rejects(*[FIGURES[f](text, words) for f in self.figures])


RULES = (
    Rule("short", ("n_words",), lambda n: n < MIN_WORDS),
    Rule("repeats", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > MAX_REPEATED * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 100 * s > MAX_SYMBOLS * n),
    Rule("dup_lines", ("n_dup_lines", "n_lines"), lambda d, n: 100 * d > MAX_DUP_LINES * n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < n * WORD_LETTERS[0]) | (c > n * WORD_LETTERS[1])),
    Rule("bullets", ("n_bullets", "n_lines"), lambda b, n: 100 * b > MAX_BULLETS * n),
    Rule("ellipses", ("n_ellipses", "n_lines"), lambda e, n: 100 * e > MAX_ELLIPSES * n),
    Rule("letters", ("n_letter_words", "n_words"), lambda w, n: 100 * w < MIN_LETTER_WORDS * n),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    cost: float
    rejected: float

    @property
    def worth(self) -> float:
        """Rejections per second."""
        return self.rejected / max(self.cost, 1e-4)


def ordered(estimates: list[Estimate]) -> list[Estimate]:
    """Best worth first; of equals the cheaper one, then by name."""
    return sorted(estimates, key=lambda e: (-e.worth, e.cost, e.rule.name))


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Each rule's cost and selectivity on the sample (the rows of least id hash), best first.

    Only rows whose hash can be among the least ones are sorted, so about sample_rows texts
    come together, however many tasks read the table.
    """
    rows = dealt(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    share = min(1.0, (sample_rows + 8 * sample_rows**0.5 + 64) / max(1, rows.count()))
    draw = F.xxhash64(F.lit("quality"), F.coalesce(F.col("doc_id").cast("string"), F.monotonically_increasing_id().cast("string")))
    near = rows.withColumn("draw", draw).where(F.col("draw") <= F.lit(int(-(2.0**63) + share * (2.0**64 - 2048))))
    near = near.orderBy("draw", "doc_id").limit(sample_rows).select("text", words_of(F.col("text")).alias("words"))
    sample = stored(near, "quality-sample")
    turns = sample.select("text", "words", F.explode(F.sequence(F.lit(1), F.lit(TURNS))).alias("turn"))

    def timed(verdict: Column) -> tuple[float, float]:
        """Least seconds of a job over the sample, and the share of true verdicts."""
        job, took = turns.agg(F.count("*"), F.count_if(verdict)), []
        for _ in range(TIMES):  # the first also compiles
            began = time.perf_counter()
            n, rejected = job.first()
            took.append(time.perf_counter() - began)
        return min(took), rejected / n if n else 0.0

    text, words = F.col("text"), F.col("words")
    idle, _ = timed((F.octet_length(text) < 0) | (F.size(words) < 0))
    out = [Estimate(rule, max(0.0, cost - idle), rejected) for rule in rules for cost, rejected in [timed(rule.of_text(text, words))]]
    forget(sample)
    return ordered(out)


def cascade(order: list[Rule], rejects: Callable[[Rule], Column]) -> Column:
    """The name of the first rule in this order that rejects the text, else null."""
    out = F.when(rejects(order[0]), order[0].name)
    for rule in order[1:]:
        out = out.when(rejects(rule), rule.name)
    return out


def quality_metrics(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Base figures and verdict of every whole text: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept.

    Most figures are asked for of every text, so the cascade has only those of other rules
    left to skip; quality_filter skips them all.  A null text has no words and fails; repeated
    rows and null ids pass through; an empty table gives no rows.  No shuffle of texts.
    """
    order = [e.rule for e in estimate(docs, rules)]
    given = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    text, words = F.col("text"), F.col("words")
    rows = dealt(docs, "doc_id", "text").select("doc_id", text_of().alias("text")).withColumn("words", words_of(text))
    rows = rows.select("doc_id", "text", "words", *[FIGURES[f](text, words).cast("long").alias(f) for f in given])
    figure = lambda f: F.col(f) if f in given else FIGURES[f](text, words)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & cascade(order, lambda r: r.rejects(*map(figure, r.figures))).isNull()
    return rows.select("doc_id", *given, "base_failed", kept.alias("kept"))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns.

    Rules run as a cascade in the estimated order: a text's figures are computed rule by
    rule, until one rejects it.  Null texts count as empty.
    """
    order = [e.rule for e in estimate(docs, rules)]
    text = text_of()
    # Bound within the expression: as a column of its own the split would be copied into
    # every use when the filter is pushed down.
    return docs.where(let(words_of(text), lambda words: cascade(order, lambda r: r.of_text(text, words))).isNull())


#: DuckDB SQL for quality_metrics over the documents table.
QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w,
         row_number() OVER () AS r
  FROM documents
), win AS (
  SELECT r, i, list_slice(w, i, i + 2) AS g FROM d, unnest(generate_series(1, len(w) - 2)) AS s(i)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup,
         count(*) FILTER (regexp_matches(l, '^[ \t]*[-*\x{2022}]')) AS bullets,
         count(*) FILTER (regexp_matches(l, '(\.\.\.|\x{2026})[ \t\r]*$')) AS ellipses
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ \t-\r]') GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lines.n, 0) AS n_lines, coalesce(bullets, 0) AS bullets, coalesce(ellipses, 0) AS ellipses,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS letters
  FROM d LEFT JOIN cov USING (r) LEFT JOIN lines USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 60 * n_lines
         OR word_chars < 2 * n_words OR word_chars > 20 * n_words
         OR 100 * bullets > 90 * n_lines OR 100 * ellipses > 30 * n_lines OR 100 * letters < 60 * n_words) AS kept
FROM f
"""
