"""Each stage of the pipeline on a small corpus, against plain Python."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    r = np.random.default_rng(11)
    plain, bad = [f"word{i}" for i in range(500)], ["grolt", "snarv", "blick", "frump"]
    rows, marks, kind = [], [], {}
    for i in range(240):
        w = list(r.choice(plain, 90))
        kind[i] = "clean"
        if i % 8 == 0:
            kind[i] = "toxic"
            for at in r.integers(0, 90, 6):
                w[at] = str(r.choice(bad))
        if i % 8 == 1:
            kind[i] = "junk"
            w = [x + "###" for x in w]
        if i % 8 == 2:
            kind[i] = "short"
            w = w[:20]
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 0))
        marks.append((i, 1, int(kind[i] == "toxic")))
    for i in (3, 4, 5):
        rows.append((1000 + i, rows[i][1], "en", "s1", 0))
        kind[1000 + i] = "copy"
        w = rows[i][1].split()
        w[0] = "changed"
        rows.append((2000 + i, " ".join(w), "en", "s2", 0))
        kind[2000 + i] = "near"
    rows += [(3000, None, None, None, None), (3001, "", "en", None, 0)]
    return rows, marks, kind


def test_stages(spark, tmp_path):
    rows, marks, kind = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert docs.columns == COLUMNS
        kept[name] = docs.collect()
    by = {name: Counter(r["doc_id"] for r in out) for name, out in kept.items()}
    assert set(by["quality_rules"]) == {i for i, x in kind.items() if x not in ("junk", "short")}
    assert set(by["toxicity"]) == {i for i in by["quality_rules"] if kind[i] != "toxic"}
    assert set(by["simhash_near_duplicates"]) == {i for i in by["toxicity"] if kind[i] == "clean"}
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in kept["simhash_near_duplicates"]}
    source = {r["doc_id"]: r["source"] for r in kept["simhash_near_duplicates"]}
    total, taken = Counter(), Counter()
    for i, n in size.items():
        total[source[i]] += n
    for i, n in by["mixing"].items():
        assert n <= 3
        taken[source[i]] += n * size[i]
    weights = dict(zip(sorted(total), (1, 2, 3, 1)))
    for s, w in weights.items():
        assert abs(taken[s] - min(3 * total[s], sum(total.values()) * w / 7)) <= 200
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r["doc_id"]: r["text"] for r in kept["simhash_near_duplicates"]}
    assert by["bpe_encoding"] == by["mixing"]
    for r in kept["bpe_encoding"]:
        assert r["ids"] == library.encode(text[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
