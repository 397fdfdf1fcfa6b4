"""License scans by diagonal voting.

Rolling hashes of all word k-grams of the texts are joined to the positions of the
same hashes in license templates.  A match of text position p with template position
t votes for the diagonal p - t; votes are gathered by diagonal, neighbouring diagonals
(words put in or left out) are merged, and a span is verified: its votes in text order must
cover the template's share of words in template order, and the words that tell the template
from its relatives (its version, its variant) must stand in the text one after another, as
they do in the template.  Short phrases must match in full on one diagonal, so each of their
places counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dealt, ship, text_of

#: Word k-gram sizes, and the most words of a template that uses the short ones.
SHORT, LONG, SHORT_WORDS = 2, 4, 8
#: Diagonals of a long template that are at most this far apart are one span.
DRIFT = 4
#: Share of a long template's words that a span must cover.
SHARE = 0.6
#: Templates are small fixed texts; their k-gram table is broadcast only below this many rows.
MAX_TEMPLATE_GRAMS = 200_000
#: Texts whose hashes a task holds at a time: a bound on memory.
TEXTS_AT_ONCE = 128
#: Word hashes kept per Python worker: a bound on memory, not on texts.
KEPT = 500_000


@dataclass(frozen=True)
class Template:
    """base: a phrase whose exact places count; else a text found by share, in which must
    (a part of the text) stands word by word."""

    label: str
    text: str
    base: bool = False
    must: str = ""


#: The base phrases.
BASE = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)

#: Wordings of well-known public licenses and notices.
LICENSES = (
    Template("mit", "released under the mit license", must="mit license"),
    Template("mit", "licensed under the mit license", must="mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    Template("apache-2.0", "licensed under the apache license version 2 0", must="apache license version 2 0"),
    Template("apache-1.1", "licensed under the apache license version 1 1", must="apache license version 1 1"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("apache-2.0", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", must="gnu general public license version 3"),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", must="gnu general public license version 2"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "licensed under the gnu lesser general public license", must="gnu lesser general public license"),
    Template("lgpl", "licensed under the gnu library general public license", must="gnu library general public license"),
    Template("agpl", "licensed under the gnu affero general public license", must="gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", must="mozilla public license v 2 0"),
    Template("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", must="mozilla public license version 1 1"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", must="cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", must="cc by sa 4 0"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", must="cc by nd 4 0"),
    Template("cc-by-nc-sa", "licensed under cc by nc sa 4 0", must="cc by nc sa 4 0"),
    Template("cc-by-nc-nd", "licensed under cc by nc nd 4 0", must="cc by nc nd 4 0"),
    Template("cc-by", "creative commons attribution 4 0 international license", must="attribution 4 0"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license", must="attribution sharealike 4 0"),
    Template("cc-by-nd", "creative commons attribution noderivatives 4 0 international license", must="attribution noderivatives 4 0"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", must="attribution noncommercial 4 0"),
    Template("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 4 0 international license", must="attribution noncommercial sharealike 4 0"),
    Template("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives 4 0 international license", must="attribution noncommercial noderivatives 4 0"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)

#: ASCII letters in lower case and digits stand for themselves, other ASCII is a space,
#: bytes of other letters stand for themselves.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= KEPT:
            self.clear()
        self[word] = h
        return h


_hashes = _Hashes()


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash a word `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case."""
    words = text.encode("utf-8", "replace").translate(_FOLD).split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def rolling(w: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for every k consecutive words (of k itself too), as signed integers."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = w[:n] + np.uint64(k)
        for j in range(1, k):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += w[j : n + j]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h.view(np.int64)


def _words(text: str) -> list[str]:
    return text.encode().translate(_FOLD).decode().split()


def _size(t: Template) -> int:
    """The template's k-gram size."""
    return SHORT if t.base or len(_words(t.text)) <= SHORT_WORDS else LONG


def _must(t: Template) -> list[int]:
    """The k-gram positions of the words that have to stand together."""
    words, part, k = _words(t.text), _words(t.must), _size(t)
    if not part:
        return []
    at = next((i for i in range(len(words)) if words[i : i + len(part)] == part), None)
    if at is None or len(part) < k:
        raise ValueError(f"not {k} words or more of the template: {t.must!r}")
    return list(range(at, at + len(part) - k + 1))


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """gram, template, at: every k-gram position of every template."""
    rows = []
    for i, t in enumerate(templates):
        w = word_hashes(t.text)
        if len(w) < _size(t):
            raise ValueError(f"template of fewer than {_size(t)} words: {t.text!r}")
        rows += [(int(g), i, at) for at, g in enumerate(rolling(w, _size(t)))]
    if len(rows) > MAX_TEMPLATE_GRAMS:
        raise ValueError("too many template k-grams to broadcast")
    return spark.createDataFrame(rows, "gram long, template int, at int")


def template_facts(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """template, label, base, k, size, must: a row a template."""
    rows = [(i, t.label, t.base, _size(t), len(_words(t.text)), _must(t)) for i, t in enumerate(templates)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, k int, size int, must array<int>")


def _in_order(votes: Column, k: Column) -> Column:
    """Template words that votes (pos, at; by pos) cover, each vote behind the one before it
    in the template too."""
    first = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("stop"), F.lit(0).alias("n"))

    def add(s: Column, x: Column) -> Column:
        more = F.struct(x["at"].alias("last"), (x["at"] + k).alias("stop"), (s["n"] + F.least(k, x["at"] + k - s["stop"])).alias("n"))
        return F.when(x["at"] > s["last"], more).otherwise(s)

    return F.aggregate(votes, first, add, lambda s: s["n"])


def spans(docs: DataFrame, templates: tuple[Template, ...] = BASE + LICENSES) -> DataFrame:
    """doc_id, n_words and spans: array of (label, base, start, stop, score).

    start and stop are word positions (stop exclusive).  Null texts have no words; rows
    without a span have an empty array; repeated rows come out as often as they came in;
    an empty table gives no rows.  One shuffle, of the matches alone.
    """
    spark = docs.sparkSession
    ship(spark)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text's k-gram hashes; the place before them stands for the text itself."""
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                w = [word_hashes(t) for t in part.column("text").to_pylist()]
                values = [np.concatenate(([0], rolling(x, SHORT), rolling(x, LONG))) for x in w]
                offsets = np.concatenate(([0], np.cumsum([len(v) for v in values])))
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array([len(x) for x in w], pa.int64()), listed], ["doc_id", "digest", "n_words", "grams"])

    rows = dealt(docs, "doc_id", "text").select("doc_id", text_of().alias("text")).withColumn("digest", F.xxhash64("text"))
    rows = rows.mapInArrow(grams, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest long, n_words long, grams array<long>")
    grams_at = rows.select("doc_id", "digest", "n_words", F.posexplode("grams").alias("i", "gram"))
    # Every rolling hash meets the template positions of the same hash.
    known = F.broadcast(template_grams(spark, templates).withColumnRenamed("gram", "template_gram"))
    hits = grams_at.join(known, (F.col("gram") == F.col("template_gram")) & (F.col("i") > 0), "left").where("template is not null or i = 0")
    facts = F.broadcast(template_facts(spark, templates))
    # All that follows groups by document first, so one exchange of the matches serves it.
    hits = hits.select("doc_id", "digest", "n_words", "i", "template", "at").repartition(F.col("doc_id"), F.col("digest"))
    shorts = F.greatest(F.col("n_words") - (SHORT - 1), F.lit(0))
    place = F.col("i") - 1 - F.when(F.col("k") == LONG, shorts).otherwise(0)
    hits = hits.join(facts, "template", "left").withColumn("diagonal", place - F.col("at"))
    kept = ("doc_id", "digest", "n_words", "template", "label", "base", "k", "size", "must")
    # A diagonal has at most as many votes as its template has words.
    diagonals = hits.groupBy(*kept, "diagonal").agg(F.collect_set("at").alias("ats"), F.count("*").alias("copies"))
    diagonals = diagonals.where(F.col("template").isNull() | ~F.col("base") | (F.size("ats") == F.col("size") - F.col("k") + 1))
    # Neighbouring diagonals of a long template are one span.
    w = Window.partitionBy("doc_id", "digest", "template").orderBy("diagonal")
    before = F.lag("diagonal").over(w)
    step = F.when(F.col("base") | before.isNull() | (F.col("diagonal") - before > DRIFT), 1).otherwise(0)
    merged = (
        diagonals.withColumn("step", step)
        .withColumn("span", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*kept, "span")
        .agg(
            F.min(F.col("diagonal") + F.array_min("ats")).alias("start"),
            F.max(F.col("diagonal") + F.array_max("ats") + F.col("k")).alias("stop"),
            F.collect_list(F.struct("diagonal", "ats")).alias("diagonals"),
            F.max("copies").alias("copies"),
        )
    )
    # Verification: words covered in the order of text and template, and words that stand together.
    votes = F.array_sort(F.flatten(F.transform("diagonals", lambda d: F.transform(d["ats"], lambda a: F.struct((d["diagonal"] + a).alias("pos"), a.alias("at"))))))
    together = F.exists("diagonals", lambda d: F.size(F.array_except("must", d["ats"])) == 0)
    merged = merged.withColumn("score", _in_order(votes, F.col("k")) / F.col("size"))
    itself = F.col("template").isNull()
    merged = merged.where(itself | F.col("base") | ((F.col("score") >= SHARE) & together))
    span = F.struct("label", "base", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "score")
    out = merged.groupBy("doc_id", "digest", "n_words").agg(F.max(F.when(itself, F.col("copies"))).alias("copies"), F.collect_list(F.when(~itself, span)).alias("spans"))
    return out.select("doc_id", "n_words", "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + LICENSES) -> DataFrame:
    """Labels of every whole text: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    n_base counts all places of base phrases, first_word and last_word are their least
    and greatest start (null without any); labels are distinct, sorted and comma-joined
    (the empty string without any); score is the greatest covered share of a template.
    """
    out = spans(docs, templates)
    all_spans = F.col("spans")
    base = F.filter(all_spans, lambda s: s["base"])

    def joined(a: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s["label"]))), ",")

    starts = F.transform(base, lambda s: s["start"])
    return out.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(all_spans).alias("labels"),
        F.coalesce(F.array_max(F.transform(all_spans, lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
