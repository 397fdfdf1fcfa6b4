"""Every operator against a brute-force version, on texts with all the edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from sparkwarden.llm import bpe_codec, context_tree, fingerprint, license_scan, mixing, quality_rules, simhash, token_count, toxicity, warc

WORD_FILE, BYTE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def words(text):
    return (text or "").encode().split()


def lower(text):
    return (text or "").encode().lower().split()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


def test_bpe_matches_the_library(make, corpus):
    t = Tokenizer.from_file(WORD_FILE)
    got = sorted(rows_of(bpe_codec.bpe_round_trip(make(corpus), WORD_FILE)), key=key)
    want = []
    for i, text, *_ in corpus:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want.append({"doc_id": i, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), "decoded_sha256": hashlib.sha256(back.encode()).hexdigest()})
    assert got == sorted(want, key=key)


def test_bpe_encode_then_decode(make, corpus):
    t = Tokenizer.from_file(WORD_FILE)
    encoded = bpe_codec.bpe_encode(make(corpus[:20]), WORD_FILE)
    got = {r["doc_id"]: r["text"] for r in rows_of(bpe_codec.bpe_decode(encoded, WORD_FILE))}
    for i, text, *_ in corpus[:20]:
        assert got[i] == t.decode(t.encode(text or "", add_special_tokens=False).ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["aaaaaaaaaaaaaaaaaaaaaaaa", "ΑΣ Σ ς", "İstanbul ß ﬁ", "a\x1cb\x85c　d", "x" * 700, "１２½²", "don't you'll'd", "\r\n \r\n", "👍🏽 ok", "a  b   c\n\n d \n"])
def test_tokenizers_on_odd_texts(text):
    c, n = bpe_codec.codec(WORD_FILE), token_count.counter(BYTE_FILE)
    assert c.encode(text) == Tokenizer.from_file(WORD_FILE).encode(text, add_special_tokens=False).ids
    assert n(text) == len(Tokenizer.from_file(BYTE_FILE).encode(text, add_special_tokens=False).ids)


def test_token_counts(make, corpus):
    t = Tokenizer.from_file(BYTE_FILE)
    got = sorted(rows_of(token_count.token_counts(make(corpus), BYTE_FILE)), key=key)
    want = [{"doc_id": i, "n_bytes": len((x or "").encode()), "n_tokens": (n := len(t.encode(x or "", add_special_tokens=False).ids)), "over_limit": n > 1024} for i, x, *_ in corpus]
    assert got == sorted(want, key=key)


def shingles(text, k=5):
    w = lower(text)
    return {tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_of_edited_and_next_texts(make, corpus):
    rows = sorted(({"doc_id": i, "text": x or ""} for i, x, *_ in corpus), key=lambda r: (*key(r), r["text"]))
    got = sorted(rows_of(fingerprint.edited_likeness(make(corpus))), key=lambda r: (*key(r), r["n_chars"]))
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    off = []
    for a, b in zip(rows, rows[1:] + rows[:1]):
        n = len(a["text"])
        edited = a["text"][: n - n // 4] + b["text"][: n // 4]
        match = [r for r in by[a["doc_id"]] if r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == n]
        assert match
        off += [abs(match[0]["near_edited"] - jaccard(shingles(a["text"]), shingles(edited)))]
    assert np.mean(off) < 0.05 and max(off) < 0.25
    same = defaultdict(set)
    for i, x, *_ in corpus:
        same[x or ""].add(fingerprint.Binner().packed(fingerprint.Binner().values(x or "")))
    assert all(len(v) == 1 for v in same.values())


def test_packing_is_a_round_trip():
    for bits in (1, 2, 4, 8):
        b = fingerprint.Binner(bits=bits)
        v = b.values("a b c d e f g h i j k l")
        assert (b.unpacked(b.packed(v)) == v).all()


def simhash_of(text, k=3):
    w = lower(text)
    if not w:
        return 0
    s = [b" ".join(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, near):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {n: root(n) for n in nodes}


def test_simhash_components(make, corpus):
    got = rows_of(simhash.near_duplicates(make(corpus)))
    prints = [(i, simhash_of(x)) for i, x, *_ in corpus]
    root = components({p for _, p in prints}, lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    want = sorted((str(i), f"{p:016x}", str(least.get(root[p]))) for i, p in prints)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


def test_covering_misses_no_link():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [(int(a), int(b)) for a, b in r.integers(0, 64, (300, 2))]
    other = np.array([int(x) ^ (1 << a) ^ (1 << b) for x, (a, b) in zip(base, flips)], np.uint64)
    row, anchor, home = simhash.anchors(base, 2)
    homes = {int(i): int(a) for i, a in zip(row[home], anchor[home])}
    row2, anchor2, _ = simhash.anchors(other, 2)
    reach = defaultdict(set)
    for i, a in zip(row2.tolist(), anchor2.tolist()):
        reach[i].add(a)
    assert len(homes) == 300 and all(homes[i] in reach[i] for i in range(300))


def test_near_duplicate_filter_keeps_one_of_each_group(make, corpus):
    r = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choice(vocabulary, 300)) for _ in range(6)]
    rows = [(1000 + 10 * i + j, t if j < 2 else t.replace(t.split()[150], "changed", 1)) for i, t in enumerate(texts) for j in range(4)]
    kept = sorted(x["doc_id"] for x in rows_of(simhash.near_duplicate_filter(make(rows + rows[:1]))))
    assert kept == [1000 + 10 * i for i in range(6)]


def kept_by_brute_force(rows):
    sets = {i: shingles(x, 5) for i, x in rows}
    root = components(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    return sorted(set(root.values()))


def test_near_duplicate_filter_finds_copies_of_other_word_prints(make):
    r = np.random.default_rng(4)
    rows = []
    while len(rows) < 40:
        w = [f"w{x}" for x in r.integers(0, 900, 100)]
        other = list(w)
        other[30], other[60] = "changed", "edited"
        a, b = " ".join(w), " ".join(other)
        if bin(simhash.word_simhash(a) ^ simhash.word_simhash(b)).count("1") > 2:
            assert 0.8 <= jaccard(shingles(a, 5), shingles(b, 5)) <= 0.85
            rows += [(len(rows), a), (len(rows) + 1, b)]
    kept = sorted(x["doc_id"] for x in rows_of(simhash.near_duplicate_filter(make(rows))))
    assert kept == kept_by_brute_force(rows) == list(range(0, 40, 2))


def test_near_duplicate_filter_joins_through_any_member(make):
    r = np.random.default_rng(6)
    rows = []
    for i in range(0, 45, 3):  # equal word prints; the outer two are under 0.8, both over 0.8 to the third
        w = [f"w{x}" for x in r.integers(0, 900, 100)]
        one, two = list(w), list(w)
        one[20], one[21] = w[21], w[20]
        two[70], two[71] = w[71], w[70]
        family = [" ".join(x) for x in (one, two, w)]
        assert [jaccard(shingles(family[a], 5), shingles(family[b], 5)) >= 0.8 for a, b in ((0, 1), (0, 2), (1, 2))] == [False, True, True]
        rows += [(i + k, x) for k, x in enumerate(family)]
    kept = sorted(x["doc_id"] for x in rows_of(simhash.near_duplicate_filter(make(rows))))
    assert kept == kept_by_brute_force(rows) == list(range(0, 45, 3))


def test_near_duplicate_filter_without_ids(make):
    w = [f"w{x}" for x in np.random.default_rng(8).integers(0, 900, 100)]
    near = w[:50] + ["changed"] + w[51:]
    rows = [(1, " ".join(w)), (None, " ".join(near)), (None, "another text that has no copy at all"), (None, " ".join(near))]
    other = [f"v{x}" for x in range(100)]
    rows += [(None, " ".join(other)), (None, " ".join(other[:99]))]
    kept = sorted((str(x["doc_id"]), x["text"]) for x in rows_of(simhash.near_duplicate_filter(make(rows))))
    assert kept[:2] == [("1", rows[0][1]), ("None", rows[2][1])] and len(kept) == 3


def test_license_places(make, corpus):
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    extra = [(300, "a cc by cc by b general public license general public"), (301, "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files"), (302, "ALL RIGHTS\nRESERVED é cc éby")]
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows_of(license_scan.license_scan(make(corpus + extra)))}
    want = set()
    for i, x, *_ in corpus + extra:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        found = [(j, k) for k, p in phrases.items() for j in range(len(w)) if w[j : j + len(p)] == p]
        at = [j for j, _ in found]
        want.add((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in found}))))
    assert got == want
    labels = {r["doc_id"]: r["labels"] for r in rows_of(license_scan.license_scan(make(extra)))}
    assert labels[301] == "mit"
    near = {
        "licensed under the GNU General Public License version 2": "gpl,gpl-2.0",
        "this work is licensed under the gnu general public license, version 3.": "gpl,gpl-3.0",
        "Licensed under the Apache License, Version 1.1": "apache-1.1",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Licensed under the new Apache License, Version 2.0.": "apache-2.0",
        "Licensed under the Apache License.": "",
        "Creative Commons Attribution NonCommercial 4.0 International License": "cc-by-nc",
        "Creative Commons Attribution 4.0 International License": "cc-by",
        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa",
        "Mozilla Public License, v. 1.1": "",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
        "The contents of this file are subject to the Mozilla Public License Version 1.1": "mpl-1.1",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa",
        "Licensed under MIT License": "mit",
        "released under the permissive MIT license": "mit",
        "released under the licence of MIT": "",
        "license mit the under released": "",
        "licensed under the GNU Lesser General Public License": "gpl,lgpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl",
    }
    got = {r["doc_id"]: r["labels"] for r in rows_of(license_scan.license_scan(make(list(enumerate(near)))))}
    assert {x: got[i] for i, x in enumerate(near)} == near
    assert license_scan.license_scan(make(corpus + extra)).count() == len(corpus + extra)


def test_quality_figures_and_verdict(make, corpus):
    extra = [(400, "same three words " * 40), (401, "line one here\nline two here\nline one here\n\n\n" + "pad%d " * 3), (402, " ".join(f"w{i}###" for i in range(80))), (403, " ".join(f"word{i}" for i in range(80)))]
    words_ = [f"word{i}" for i in range(80)]
    extra += [(404, "\n".join(" - " + w for w in words_)), (405, "\n".join(w + " ..." for w in words_)), (406, " ".join(str(i) for i in range(1000, 1100))), (407, "\n".join(f"- {w} x{w} y{w}" for w in words_[:60]) + "\n" + "\n".join(words_[60:]))]
    got = sorted((str(tuple(r.values())) for r in rows_of(quality_rules.quality_metrics(make(corpus + extra)))))
    want = []
    for i, x, *_ in corpus + extra:
        x = x or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        windows = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {j + k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        dup, sym, chars = len(lines) - len(set(lines)), len(re.findall(r"[#*$%&|<>]", x)), sum(map(len, w))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        kept = not failed and not (100 * sym > 10 * len(w) or 100 * dup > 60 * len(lines) or chars < 2 * len(w) or chars > 20 * len(w))
        bullets, dots = sum(bool(re.match(r"[ \t]*[-*•]", y)) for y in lines), sum(bool(re.search(r"(\.\.\.|…)[ \t\r]*$", y)) for y in lines)
        kept = kept and not (100 * bullets > 90 * len(lines) or 100 * dots > 30 * len(lines) or 100 * sum(any(c.isalpha() for c in y) for y in w) < 60 * len(w))
        want.append(str((i, len(w), chars, sym, dup, len(covered), failed, kept)))
    assert got == sorted(want)
    kept = {r["doc_id"] for r in rows_of(quality_rules.quality_filter(make(corpus + extra)))}
    assert {403, 407} <= kept and not kept & {400, 401, 402, 202, 203, 404, 405, 406}


def test_cascade_order_is_rejection_per_cost():
    made = lambda name, cost, rejected: quality_rules.Estimate(quality_rules.Rule(name, (), None), cost, rejected)
    given = [made("dear", 2.0, 0.5), made("cheap", 0.1, 0.1), made("idle", 0.01, 0.0), made("keen", 0.5, 0.9), made("lazy", 1.0, 0.0)]
    assert [e.rule.name for e in quality_rules.ordered(given)] == ["keen", "cheap", "dear", "idle", "lazy"]


def test_estimates_are_measured(make):
    rows = [(i, "one two three") for i in range(30)] + [(100 + i, " ".join(f"w{i}x{j}" for j in range(400))) for i in range(70)]
    found = {e.rule.name: e for e in quality_rules.estimate(make(rows))}
    assert set(found) == {r.name for r in quality_rules.RULES}
    assert found["short"].rejected == 0.3 and found["symbols"].rejected == 0
    assert found["repeats"].cost > found["short"].cost


def test_cascade_leaves_later_rules_alone(make):
    from pyspark.sql import functions as F

    never = quality_rules.Rule("never", ("n_words",), lambda n: F.raise_error(F.lit("a rejected text came to a later rule")).isNotNull())
    rows = make([(1, "a b"), (2, None)]).select("text")
    first = quality_rules.RULES[0]
    out = rows.select(quality_rules.cascade([first, never], lambda r: r.of_text(F.coalesce("text", F.lit("")), quality_rules.words_of(F.coalesce("text", F.lit(""))))).alias("by"))
    assert {x["by"] for x in out.collect()} == {"short"}


def highest_quotients(votes, seats, most):
    out = [0] * len(votes)
    for _ in range(seats):
        free = [i for i in range(len(votes)) if out[i] < most[i] and votes[i] > 0]
        if not free:
            break
        best = max(free, key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
        out[best] += 1
    return out


def test_sainte_lague_is_the_highest_quotient_rule(spark):
    r = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(12):
        votes = [float(v) for v in r.integers(0, 1000, r.integers(1, 9))]
        seats = int(r.integers(0, 60))
        for i, q in enumerate(highest_quotients(votes, seats, [10**6] * len(votes))):
            want[g, i] = q
        rows += [(g, i, v, seats, 10.0**6) for i, v in enumerate(votes)]
    df = spark.createDataFrame(rows, "g int, i int, v double, seats int, most double")
    got = {(x["g"], x["i"]): x["quota"] for x in mixing.sainte_lague(df, ["g"], ["g", "i"], "v", "seats", "most").collect()}
    assert got == want


def water_filling(sizes, weights=(1, 2, 3), repeats=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        share = left / sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * share > repeats * sizes[s] + 1e-9]
        if not over:
            return out | {s: w[s] * share for s in open_}
        for s in over:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


def test_mix_targets_and_reruns(make, corpus):
    rows = corpus + [(500 + i, "a b c d e f g h i j " * (1 + i % 4), f"t{i % 7}") for i in range(200)] + [(900, "tiny", "zz")]
    got = sorted((str(tuple(r.values())) for r in rows_of(mixing.mix(make(rows), block=4))))
    assert got == sorted((str(tuple(r.values())) for r in rows_of(mixing.mix(make(rows).repartition(3), block=4))))
    sizes = Counter()
    for i, x, s in rows:
        sizes[s] += len(words(x))
    want = water_filling(sizes)
    plan = rows_of(mixing.mixed(make(rows), block=4))
    taken = Counter()
    for r in plan:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 8 for s, t in want.items())
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_mixed_documents_beside_any_columns(spark):
    rows = [(i, f"w{i} " * 40, f"s{i % 3}", "a", "b", "c", "d") for i in range(90)] + [(1, None, None, "a", "b", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __own string, __id string, __copies string, __draw string")
    out = mixing.mixed_documents(docs, block=8)
    assert out.columns == docs.columns and {(r["__own"], r["__id"], r["__copies"], r["__draw"]) for r in out.collect()} == {("a", "b", "c", "d")}


def test_small_sources_take_part(make):
    rows = [(i, "a b c d e f g h i j", "small") for i in range(2)] + [(100 + i, "x " * 500, "large") for i in range(4)]
    plan = rows_of(mixing.mixed(make(rows)))
    taken = sum(r["taken"] for r in plan if r["source"] == "small")
    assert 0 < taken <= 60 and all(r["taken"] <= 3 * r["size"] for r in plan)


def test_context_tree_predictions_sum_to_one():
    data = context_tree.spelled(b"the cat sat on the mat the cat".split())
    w = context_tree.windows(data)
    keys, counts = np.unique(w, return_counts=True)
    context = int(keys[3]) >> 8
    every = np.array([context << 8 | b for b in range(256)], np.int64)
    part = (keys >> 8) & 0xFFFF == context & 0xFFFF
    trees = context_tree.Trees(keys[part], counts[part])
    p, _ = trees.predict(every)
    assert p.prod(axis=1).sum() == pytest.approx(1.0)


def brute_ctw(train, query):
    """Weighted context trees over dictionaries, one for each code-tree node."""
    counts = defaultdict(lambda: [0, 0])
    depth = context_tree.DEPTH
    for data in train:
        for at in range(depth, len(data)):
            byte = data[at]
            for k in range(8):
                node, bit = (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1
                for d in range(depth + 1):
                    counts[node, bytes(data[at - d : at])][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    children = defaultdict(list)
    for node, c in counts:
        if c:
            children[node, c[1:]].append(c)
    weighted = {}

    def pw(node, c):
        if (node, c) not in weighted:
            own = kt(*counts[node, c])
            weighted[node, c] = own if len(c) == depth else float(np.logaddexp(own, sum(pw(node, x) for x in children[node, c])) - math.log(2))
        return weighted[node, c]

    total = 0.0
    for at in range(depth, len(query)):
        byte = query[at]
        for k in range(8):
            node, bit = (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1
            p = 0.5
            for d in range(depth, -1, -1):
                c = bytes(query[at - d : at])
                if (node, c) not in counts:
                    p = 0.5
                    continue
                a = counts[node, c]
                own = (a[bit] + 0.5) / (sum(a) + 1)
                if d == depth:
                    p = own
                else:
                    ratio = kt(*a) - sum(pw(node, x) for x in children[node, c])
                    share = 1 / (1 + math.exp(-max(-700, min(700, ratio))))
                    p = share * own + (1 - share) * p
            total += math.log10(p)
    return total


def test_context_tree_scores(make, corpus):
    rows = [r for r in corpus if len(r[1] or "") < 2000]
    learn = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    train = [bytes(context_tree.spelled(lower(x))) for i, x, *_ in rows if learn(i)]
    count = Counter(t for i, x, *_ in rows if learn(i) for t in [*lower(x), b""])
    n, v = sum(count.values()), len(count)
    got = sorted(rows_of(context_tree.context_tree_scores(make(rows), block_chars=1500)), key=lambda r: (*key(r), r["n_tokens"]))
    assert len(got) == len(rows)
    for r, (i, x, *_) in zip(got, sorted(rows, key=lambda y: (y[0] is None, y[0] or 0, len(lower(y[1]))))):
        t = [*lower(x), b""]
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, not learn(i), len(t), sum(count[y] > 0 for y in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[y] + 1) / (n + v + 1)) for y in t))
    for r, (i, x, *_) in list(zip(got, sorted(rows, key=lambda y: (y[0] is None, y[0] or 0, len(lower(y[1]))))))[:6]:
        assert r["score"] == pytest.approx(brute_ctw(train, bytes(context_tree.spelled(lower(x)))), rel=1e-6)


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    page = "<p>" + "x" * 200 + "é"
    rows = [(1, "http://a/1", page), (2, "http://a/2", page), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", "y" * 300_000), (1, "http://a/1", page), (None, "u", page), (7, "a\r\nb", "z" * 99)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload_digest string")
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows_of(warc.archive_round_trip(pages)))
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        again = len(b) >= 100 and i != min(same)
        want.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    assert got == sorted(want)
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    few = warc.read_warc(spark, path).where("record_type = 'revisit'")
    assert few.count() == 2 and " Filter " not in str(few._jdf.queryExecution().executedPlan())
    assert {r["page_id"] for r in warc.read_warc(spark, path).where("page_id in (3, 6)").select("page_id", "payload").collect()} == {3, 6}
    reader = warc.WarcReader(path, warc.read_warc(spark, path).schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("page_id",), 1)])) == [GreaterThan(("page_id",), 1)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2
    heads = warc.read_warc(spark, path, payloads=False)
    assert "payload" not in heads.columns and heads.count() == len(rows)
    # What stands in the folder stays when more is appended, and goes when it is overwritten.
    warc.write_warc(pages.where("page_id > 4"), path)
    more = warc.read_warc(spark, path)
    assert more.count() == len(rows) + 3 and more.where("record_type = 'revisit'").count() == 2
    warc.write_warc(pages.where("page_id > 4"), path, mode="overwrite")
    assert warc.read_warc(spark, path).count() == 3


def plain_record(i, payload):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def read_all(path, ids, payloads=True):
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        return [(r["page_id"], p) for r, p in warc.read_records(f, lambda r: r["page_id"] in ids, payloads)]


def test_warc_of_other_writers(spark, tmp_path):
    import gzip

    big = bytes(np.random.default_rng(3).integers(0, 256, 700_000, np.uint8))
    given = {1: b"abc", 2: b"", 3: big, 4: b"\r\n\r\n", 5: b"x" * 2_000_000}
    packed, plain = tmp_path / "a.warc.gz", tmp_path / "b.warc"
    packed.write_bytes(b"".join(gzip.compress(plain_record(i, p)) for i, p in given.items()))
    plain.write_bytes(b"".join(plain_record(10 + i, p) for i, p in given.items()))
    for ids in ({1, 2, 3, 4, 5}, {2, 4}, {5}, set()):
        assert read_all(packed, ids) == [(i, given[i]) for i in sorted(ids)]
        assert read_all(plain, {10 + i for i in ids}) == [(10 + i, given[i]) for i in sorted(ids)]
        assert read_all(packed, ids, False) == [(i, None) for i in sorted(ids)]
    assert warc.read_warc(spark, str(tmp_path)).count() == 10


def test_warc_skips_by_length(tmp_path):
    records = [warc.record(i, "response", "u", n, "d", None, b"y" * n) for i, n in ((1, 10), (2, 900_000), (3, 0), (4, 70_000))]
    f = tmp_path / "a.warc.gz"
    f.write_bytes(b"".join(records))
    # A skipped payload is not looked at: breaking it does not matter.
    broken = bytearray(f.read_bytes())
    at = len(records[0]) + len(records[1]) - 200
    broken[at : at + 100] = bytes(100)
    f.write_bytes(bytes(broken))
    assert read_all(f, {1, 3, 4}) == [(1, b"y" * 10), (3, b""), (4, b"y" * 70_000)]
    # A length that leads nowhere (as of a member above 4 GiB) is not followed.
    wrong = bytearray(records[1])
    wrong[16:20] = (12345).to_bytes(4, "little")
    f.write_bytes(bytes(wrong) + records[3])
    assert read_all(f, {4}) == [(4, b"y" * 70_000)]


def test_block_max_search_is_exact():
    r = np.random.default_rng(4)
    for size, terms in ((500, 30), (3000, 400), (1, 3), (64, 8)):
        weights = r.random(terms) + 0.1
        blank = toxicity.Index.of(weights, [])
        vectors = []
        for _ in range(size):
            t = np.sort(r.choice(terms, r.integers(0, 3), replace=False))
            if len(t) and r.random() < 0.5:
                t = np.unique(np.append(t, 0))  # one common term
            vectors.append((t, blank.unit(t, r.integers(1, 5, len(t)).astype(float))))
        index = toxicity.Index.of(weights, vectors)
        dense = np.zeros((size, terms))
        for i, (t, v) in enumerate(vectors):
            dense[i, t] = v
        for i in r.integers(0, size, 60):
            t, v = vectors[i]
            q = np.zeros(terms)
            q[t] = v
            for but in (-1, int(i)):
                cos = np.round(dense.astype(np.float32).astype(float) @ q, 5)
                cos[but] = 0 if but >= 0 else cos[but]
                best = np.sort(cos[cos > 0])[::-1][: toxicity.NEIGHBOURS]
                rows, got = index.nearest(t, v, but=but)
                assert len(rows) == len(best) == len(set(rows.tolist())) and but not in rows
                assert np.allclose(got, best, atol=2e-5) and np.allclose(cos[rows], best, atol=2e-5)


def brute_toxicity(rows, marks):
    """Scores by dense cosines over all terms, from the definition."""
    word = re.compile(r"[^\W_]+")
    counts = [Counter(word.findall((x[1] or "").lower())) for x in rows]
    held = [x[0] is not None and zlib.crc32(str(x[0]).encode()) % 3 == 1 for x in rows]
    by_id = defaultdict(list)
    for i, y in marks:
        if i is not None and y is not None:
            by_id[i].append(y)
    by_text = defaultdict(list)
    for x, h in zip(rows, held):
        if x[0] is not None and not h and x[0] in by_id:
            by_text[x[1] or ""].append(np.mean(by_id[x[0]]))
    texts = sorted(by_text)
    y = np.array([float(np.mean(by_text[t]) > 0.5) for t in texts])
    terms = sorted({w for t in texts for w in word.findall(t.lower())})
    at = {w: i for i, w in enumerate(terms)}
    df = np.array([max(1, sum(w in c for c in counts)) for w in terms])
    dense = np.zeros((len(texts), len(terms)))
    for i, t in enumerate(texts):
        for w, n in Counter(word.findall(t.lower())).items():
            dense[i, at[w]] = 1 + math.log(n)
    toxic, clean = (dense[y == 1] > 0).sum(0), (dense[y == 0] > 0).sum(0)
    weight = np.log(1 + len(rows) / df) * np.abs(np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / ((1 - y).sum() + 1)))

    def unit(m):
        m = m * weight
        return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)

    examples = unit(dense)
    prior = y.sum() / (len(y) + 1)

    def signals(q, loo):
        out = []
        for i, cos in enumerate(q @ examples.T):
            if loo:
                cos[i] = 0
            near = [j for j in np.argsort(-cos)[: toxicity.NEIGHBOURS] if cos[j] > 1e-9]
            w = cos[near] / cos[near[0]] if near else np.empty(0)
            p = (w @ y[near] + prior) / (w.sum() + 1) if near else prior
            out.append(math.log(p / (1 - p)))
        return np.array(out)

    a, b = toxicity.platt(signals(examples.copy(), True), y, np.ones(len(y)))
    asked = np.zeros((len(rows), len(terms)))
    for i, c in enumerate(counts):
        for w, n in c.items():
            if w in at:
                asked[i, at[w]] = 1 + math.log(n)
    return 1 / (1 + np.exp(-(a * signals(unit(asked), False) + b)))


def test_toxicity_on_held_out_rows(spark, make):
    r = np.random.default_rng(6)
    plain = [f"word{i}" for i in range(300)]
    bad = ["grolt", "snarv", "blick", "frump"]
    rows, marks = [], []
    for i in range(600):
        w = list(r.choice(plain, 60))
        toxic = i % 6 == 0
        for _ in range(3 * toxic):
            w[r.integers(60)] = str(r.choice(bad))
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    rows += [(9001, ""), (9002, None), (None, "grolt snarv"), (3, rows[3][1])]
    labels = spark.createDataFrame([*marks, (None, 1), (77777, 1), (5, None)], "doc_id long, toxic int")
    got = rows_of(toxicity.toxicity_scores(make(rows), labels))
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7) for x in got)
    truth = dict(marks)
    held = [x for x in got if x["held_out"] and x["doc_id"] in truth]
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in got)
    assert np.mean([x["predicted"] == truth[x["doc_id"]] for x in held]) > 0.97
    kept = {x["doc_id"] for x in rows_of(toxicity.toxicity_filter(make(rows), labels))}
    assert {9001, 9002} <= kept and None not in kept
    plain_scores = brute_toxicity(rows, [*marks, (5, None)])
    by_key = {(x["doc_id"], i): x for i, x in enumerate(sorted(got, key=lambda x: (x["doc_id"] is None, x["doc_id"] or 0)))}
    want = sorted(zip([x[0] for x in rows], plain_scores), key=lambda x: (x[0] is None, x[0] or 0))
    assert np.allclose([x["score"] for x in by_key.values()], [s for _, s in want], atol=1e-4)
    assert all(len(x["evidence"]) == toxicity.NEIGHBOURS for x in got if x["doc_id"] in truth)
    assert not any(e["doc_id"] is None or zlib.crc32(str(e["doc_id"]).encode()) % 3 == 1 for x in got for e in x["evidence"])
    none = toxicity.toxicity_scores(make(rows[:5]), labels.where("toxic = 0"))
    assert {x["score"] for x in rows_of(none)} == {0.0}


def test_very_long_texts(spark, make):
    r = np.random.default_rng(12)
    long = " ".join(f"w{x}" for x in r.integers(0, 20_000, 60_000)) + " licensed under the mit license"
    rows = [(1, long), (2, long + " tail"), (3, "short text"), (4, "x" * 300_000)]
    n = len(long.split())
    counts = {x["doc_id"]: x["n_tokens"] for x in rows_of(token_count.token_counts(make(rows), BYTE_FILE))}
    t = Tokenizer.from_file(BYTE_FILE)
    assert counts == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in rows}
    labels = {x["doc_id"]: (x["n_words"], x["labels"]) for x in rows_of(license_scan.license_scan(make(rows)))}
    assert labels == {1: (n, "mit"), 2: (n + 1, "mit"), 3: (2, ""), 4: (1, "")}
    assert {x["doc_id"]: x["n_words"] for x in rows_of(quality_rules.quality_metrics(make(rows)))} == {1: n, 2: n + 1, 3: 2, 4: 1}
    assert sorted(x["doc_id"] for x in rows_of(simhash.near_duplicate_filter(make(rows)))) == [1, 3, 4]
    near = {x["doc_id"]: x["near_next"] for x in rows_of(fingerprint.edited_likeness(make(rows)))}
    assert near[1] > 0.95 and near[2] < 0.1


def test_empty_tables(spark, make):
    e = make([])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        bpe_codec.bpe_round_trip(e, WORD_FILE), token_count.token_counts(e, BYTE_FILE), fingerprint.edited_likeness(e), simhash.near_duplicates(e), simhash.near_duplicate_filter(e),
        license_scan.license_scan(e), quality_rules.quality_metrics(e), quality_rules.quality_filter(e), mixing.mix(e), mixing.mixed_documents(e), context_tree.context_tree_scores(e),
        toxicity.toxicity_scores(e, labels), toxicity.toxicity_filter(e, labels), warc.archive_round_trip(pages),
    ):
        assert df.count() == 0
