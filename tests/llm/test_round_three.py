"""Turn repair, hard negatives and the URL filter against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from urllib.parse import urlsplit

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from sparkwarden.llm import bpe_codec, context_tree, fingerprint, mixing, toxicity
from sparkwarden.llm import hard_negatives as H
from sparkwarden.llm import turn_repair as T
from sparkwarden.llm import url_filter as U

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
SPACES = " \t\n\x0b\x0c\r"


# ---- turn repair ---------------------------------------------------------------------------


def damaged_rows(rows):
    space = lambda x: " " if x is None else x
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(c for c in text if c not in ".!?")
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit) by trying every edit at every place."""
    then = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    fill = (2, 2, 3, 2)

    table = {}
    for i in range(len(rows), -1, -1):
        for inserted in (2, 1, 0):
            for q in range(4):
                found = [(math.inf, "")]
                if i == len(rows) and q in (0, 3):
                    found.append((0, ""))
                if inserted < 2:
                    c, a = table[i, fill[q], inserted + 1]
                    found.append((c + 2, "I" + a))
                if i < len(rows):
                    role, fault = rows[i]
                    c, a = table[i + 1, q, 0]
                    found.append((c + 3, "D" + a))
                    if fault not in ("blank", "duplicate"):
                        extra = fault == "truncated"
                        if role[:1] in then[q]:
                            c, a = table[i + 1, then[q][role[:1]], 0]
                            found.append((c + extra, "K" + a))
                        c, a = table[i + 1, fill[q], 0]
                        found.append((c + 2 + extra, "R" + a))
                table[i, q, inserted] = min(found)
    return table[0, 0, 0]


def brute_repair(rows):
    out = {}
    kept = damaged_rows(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            bare = text.strip(SPACES)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = cheapest(tuple((r[2], f) for r, f in zip(mine, faults)))
        lines, i, q = [], 0, 0
        for e in audit:
            put, to = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)][q]
            if e == "I":
                lines.append(f"{put}:")
                q = to
                continue
            _, _, role, text = mine[i]
            i += 1
            if e == "K":
                lines.append(f"{role}:{text}")
                q = {"s": 1, "u": 2, "a": 3}[role[0]]
            if e == "R":
                lines.append(f"{put}:{text}")
                q = to
        turns = [r[1] for r in mine if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(n, longest, seed):
    r = random.Random(seed)
    texts = ["Yes.", "no", "What?", " ", "", "a b c!", "über.", "same text.", None, "cut off ", "Fine. \n"]
    rows = []
    for c in range(n):
        for t in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            turn = r.choice([t, t, t, t, t + r.randint(0, 3), None])
            rows.append((c, turn, role, r.choice(texts) if r.random() < 0.6 else f"{r.random()}."))
    return rows


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, fault string")
    return {r["conv_id"]: tuple(r)[1:] for r in T.conversation_repair(df).collect()}


def test_turn_repair_against_brute_force(spark):
    rows = conversations(150, 9, 1) + [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (900, 5, "user", "x" * 300_000)]
    assert repaired(spark, rows) == brute_repair(rows)


def test_turn_repair_of_long_and_split_conversations(spark, monkeypatch):
    """Many segments, held ones and ones over several ranges, and one that all ranges share."""
    rows = conversations(6, 400, 2) + [(50, t, random.Random(t).choice(["user", "assistant"]), f"{t % 40}.") for t in range(1500)]
    assert repaired(spark, rows) == brute_repair(rows)


def test_turn_repair_without_rows(spark):
    assert repaired(spark, []) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "x.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("seed", range(30))
def test_layers_over_segments(seed, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", 3)
    r = random.Random(seed)
    rows = [(r.choice(["user", "assistant", "system", "x"]), "t", r.choice([0, 0, 1, 2, 3])) for _ in range(r.randint(0, 14))]
    made = T.repaired(rows)
    names = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
    assert (made.cost, "".join(made.audit)) == cheapest(tuple((role, names[f]) for role, _, f in rows))


# ---- hard negatives ------------------------------------------------------------------------


def brute_negatives(rows, every=100):
    use = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        new = (label, [math.floor(256 * x) for x in v])
        use[i] = min(use.get(i, new), new)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for i, (label, v) in use.items():
        if i % every:
            continue
        score = {j: dot(v, w) for j, (_, w) in use.items() if j != i}
        first = lambda ids, k: sorted(ids, key=lambda j: (-score[j], j))[:k]
        for p in first([j for j in score if use[j][0] == label], 5):
            inside = [j for j in score if use[j][0] != label and 80 * score[p] <= 100 * score[j] <= 100 * score[p]]
            out |= {(i, p, k, j, score[p], score[j]) for k, j in enumerate(first(inside, 5), 1)}
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, codes string, block int")
    df = df.withColumn("label", H.shifted(df["label"], df["vec_id"]))
    return H.hard_negatives(H.usable_vectors(df), **more)


def vectors(n, dims, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims)).astype(np.float32) / np.float32(math.sqrt(dims))
    return [(i, [float(c) for c in x[i]], int(r.integers(0, 10))) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 7, 64])
def test_hard_negatives_against_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(H, "BLOCK", 300)
    monkeypatch.setattr(H, "CHUNK", 3)
    rows = vectors(900, dims, dims)
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(80)] + [(1200 + i, rows[100][1], 9) for i in range(80)]
    rows += [(2000, None, 1), (2001, [float("nan")] * dims, 1), (2002, [float("inf")] * dims, 2), (2003, [None] * dims, 2), (2004, rows[0][1], None), (None, rows[0][1], 3), (2100, [], 4), (2101, [3.0], 4), (5, rows[9][1], 0), (2200, [0.0] * dims, 4)]
    df = mined(spark, rows)
    assert {tuple(r) for r in df.collect()} == brute_negatives(rows)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_with_few_rows(spark):
    assert mined(spark, []).collect() == []
    assert mined(spark, [(100, [1.0, 0.0], 1), (101, [1.0, 0.0], 2)]).collect() == []
    rows = [(100, [1.0, 2.0], 1), (101, [1.0, 1.0], 1), (102, [1.0, 0.9], 2)]
    assert {tuple(r) for r in mined(spark, rows).collect()} == brute_negatives(rows) != set()


def test_codebook_bounds_hold():
    r = np.random.default_rng(0)
    v = r.integers(-400, 400, (500, 9))
    book = H.Codebook(v[:50], 9)
    codes, norms = book.encode(v)
    lower, upper = book.bounds(v[:40], codes, norms)
    exact = v[:40] @ v.T
    assert (lower <= exact).all() and (exact <= upper).all()
    assert book.centroids.shape == (5, H.CENTROIDS, H.PART)


# ---- URL filter ----------------------------------------------------------------------------


def brute_rule(url):
    """host, path, rule, verdict."""
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    ends = [rest.index(c) for c in "/?#" if c in rest]
    host, tail = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = []
    for what, rule in U.RULES:
        at, p = rule.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + p):
            fits.append((len(rule), rule, what))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


ODD_URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG", "http://A.Example.ORG/", "HTTP://x.org/a?b#c", "x://org/a://b", "http://example.org/es/1", "http://example.org/en/19", "http://notexample.org/en/1", "http://com/fr/?q", "http://a.com/de/", "http://b.com?x=/fr/", "http://c.com#/de/", "http://é.ÉA.net/ü/\n2", "://org/x", "a\n://org/y", ":/://org/z", "http://acom/de/1", "http://a.com/DE/"]


def urls(n, seed):
    r = random.Random(seed)
    hosts = ["alpha.example", "beta.example", "gamma", "delta.shop", "m.epsilon"]
    return [f"http{r.choice(['', 's'])}://{r.choice(hosts)}.{r.choice(['com', 'net', 'org', 'com'])}/{r.choice(['en', 'de', 'fr', 'es'])}/{r.randint(1, 999)}" for _ in range(n)]


def judged(spark, rows, **more):
    df = spark.createDataFrame([(i, u, "<html>", "x", 1.0) for i, u in rows], "page_id long, url string, html string, host string, score double")
    return U.url_filter(df, **more)


def test_url_rules_and_parts(spark):
    rows = list(enumerate(ODD_URLS + urls(300, 1))) + [(None, "http://a.org/1"), (3, "http://a.org/1")]
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in judged(spark, rows).collect()), key=repr)
    want = [(i, *brute_rule(u)[:3]) for i, u in rows]
    assert got == sorted(want, key=repr)
    for r in judged(spark, rows).collect():
        if r["rule"]:
            assert r["verdict"] == {text: what for what, text in U.RULES}[r["rule"]]
        assert r["verdict"] in ("allow", "block")


def brute_probability(texts, context, c):
    """Witten and Bell over all suffixes of the context, counted in the texts."""
    p = 1 / 257
    for k in range(len(context) + 1):
        x = context[len(context) - k :]
        after = [t[i + k] if i + k < len(t) else 256 for t in texts for i in range(len(t) - k + 1) if t[i : i + k] == x]
        if not after:
            break
        p = (after.count(c) + len(set(after)) * p) / (len(after) + len(set(after)))
    return p


def test_url_scores_against_brute_force(spark):
    rows = list(enumerate(ODD_URLS + urls(160, 2)))
    texts = defaultdict(list)
    labelled = spark.createDataFrame([(u, brute_rule(u)[3]) for _, u in rows], "url string, verdict string")
    for r in U.labelled_sample(labelled).where("not calibration").collect():
        texts[r["verdict"]].append(r["url"].encode())
    got = {r["page_id"]: r["score"] for r in judged(spark, rows).collect()}
    for i, u in rows[:40]:
        b = (u or "").encode()
        total = 0.0
        for at, c in enumerate([*b, 256]):
            context = b[max(0, at - U.ORDER) : at]
            total += math.log(brute_probability(texts["block"], context, c)) - math.log(brute_probability(texts["allow"], context, c))
        assert got[i] == pytest.approx(total / (len(b) + 1), abs=1e-9)


def test_url_models_tell_verdicts_apart(spark):
    """On labelled URLs that were not learnt from, of the same make."""
    rows = list(enumerate(dict.fromkeys(urls(3000, 3))))
    labelled = spark.createDataFrame([(u, brute_rule(u)[3]) for _, u in rows], "url string, verdict string")
    judge = U.fit(labelled, 200)
    learnt = {r["url"] for r in U.labelled_sample(labelled, 200).collect()}
    fresh = [(judge.score(u) > judge.threshold, v) for _, u in rows if u not in learnt and (v := brute_rule(u)[3])]
    assert len(fresh) > 500 and sum(b == (v == "block") for b, v in fresh) / len(fresh) > 0.95


def test_url_filter_without_labelled_urls(spark):
    assert judged(spark, []).collect() == []
    assert {r["verdict"] for r in judged(spark, [(1, "http://a.net/x"), (2, None)]).collect()} == {"allow"}
    assert {r["verdict"] for r in judged(spark, [(1, "http://a.net/x"), (2, "http://a.org/")]).collect()} == {"allow"}


def test_threshold_is_the_best_cut():
    r = np.random.default_rng(1)
    for _ in range(20):
        s, y = r.normal(size=40).round(1), r.random(40) < 0.4
        cut = U.calibrated(s, y)
        loss = lambda t: (s[y] <= t).mean() + (s[~y] > t).mean()  # noqa: E731, B023
        assert loss(cut) == pytest.approx(min(loss(t) for t in np.append(s, s.min() - 1)))
    assert U.calibrated(np.array([1.0]), np.array([True])) == math.inf
    assert urlsplit(ODD_URLS[8]).hostname == brute_rule(ODD_URLS[8])[0]


# ---- fingerprints and toxicity -------------------------------------------------------------


def plain_fingerprint(text):
    """One-permutation MinHash in plain Python: least hash a bin, empty bins from drawn ones."""
    mask = (1 << 64) - 1
    found = (text or "").encode().lower().split()
    if not found:
        return None
    k = min(5, len(found))
    best = {}
    for i in range(len(found) - k + 1):
        h = xxhash.xxh64_intdigest(found[i])
        for w in found[i + 1 : i + k]:
            h = (h * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(w)) & mask
        h ^= h >> 32
        for _ in range(2):
            h = h * 0xD6E8FEB86659FD93 & mask
            h ^= h >> 32
        best[h >> 56] = min(best.get(h >> 56, mask), h)
    draw, rounds = np.random.default_rng(20240229), []
    out = []
    for b in range(256):
        at, r = b, 0
        while at not in best:
            if r == len(rounds):
                rounds += list(draw.integers(0, 256, (64, 256)))
            at, r = int(rounds[r][b]), r + 1
        out.append(best[at] & 15)
    return out


def plain_likeness(a, b):
    if a is None or b is None:
        return float(a is None and b is None)
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 16) / (15 / 16))


def plain_edited(rows):
    """The whole result of op2's contract; null ids in the order of their texts' hashes."""
    signed = lambda t: (x := xxhash.xxh64_intdigest(t.encode(), 42)) - (x >> 63 << 64)
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, signed(r[1]) if r[0] is None else 0, r[1].encode()))
    packed = lambda v: "" if v is None else "".join(f"{x:x}" for x in v)
    out = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a, b, c = map(plain_fingerprint, (t, edited, nxt))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), packed(a), packed(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("case", ["mixed", "all null", "one", "one null", "none"])
def test_fingerprints_against_plain_minhash(spark, case):
    r = random.Random(9)
    text = lambda n: " ".join(r.choice(["alpha", "Beta", "ÉCLAIR", "über", "x#y", "the", "12"]) + str(r.randrange(4)) for _ in range(n))
    some = [(i, text(r.choice([0, 1, 3, 40, 400]))) for i in range(90)] + [(3, text(9)), (200, None), (201, "")]
    nulls = [(None, text(r.choice([0, 2, 20]))) for _ in range(60)] + [(None, "again and again")] * 3
    rows = {"mixed": some + nulls, "all null": nulls, "one": [(7, "a b c d")], "one null": [(None, "a b c d")], "none": []}[case]
    got = fingerprint.edited_likeness(spark.createDataFrame([(*x, "u", 3) for x in rows], "doc_id long, text string, role string, bucket int")).collect()
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")
    assert sorted(((*[x[n] for n in names], round(x["near_edited"], 9), round(x["near_next"], 9)) for x in got), key=repr) == plain_edited(rows)


def test_toxicity_with_ids_of_text(spark):
    r = random.Random(2)
    rows = [(f"d{i}", " ".join(r.choice(["one", "two", "three", "four"]) for _ in range(12)) + (" grolt" if i % 4 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(i, int("grolt" in t), "x") for i, t in rows], "doc_id string, toxic int, text string")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == 120 and {e["doc_id"] for x in got for e in x["evidence"]} <= {i for i, _ in rows}
    assert sum(x["predicted"] == ("grolt" in dict(rows)[x["doc_id"]]) for x in got) > 110


# ---- long texts, ties, clashing names ------------------------------------------------------


def test_very_long_texts_of_the_other_operators(spark):
    r = np.random.default_rng(4)
    long = " ".join(f"w{x}" for x in r.integers(0, 3000, 60_000))
    rows = [(1, long, "a"), (2, long + " w1 tail", "b"), (3, "x" * 200_000, "b"), (4, "short text", None)]
    docs = spark.createDataFrame([(*x, "clash", 5.0) for x in rows], "doc_id long, text string, source string, toxic string, score double")
    tokenizer = Tokenizer.from_file(WORD_FILE)
    got = {x["doc_id"]: (x["n_tokens"], x["ids_sha256"]) for x in bpe_codec.bpe_round_trip(docs, WORD_FILE).collect()}
    for i, text, _ in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    labels = spark.createDataFrame([(1, 0, "a", 1.0, True), (2, 1, "b", 2.0, False)], "doc_id long, toxic int, text string, score double, held_out boolean")
    scores = {x["doc_id"]: x["score"] for x in toxicity.toxicity_scores(docs, labels).collect()}
    assert set(scores) == {1, 2, 3, 4} and all(0 <= s <= 1 for s in scores.values())
    sizes = {x["doc_id"]: (x["size"], x["taken"]) for x in mixing.mix(docs).collect()}
    assert {i: s for i, (s, _) in sizes.items()} == {1: 60_000, 2: 60_002, 3: 1, 4: 2} and all(t <= 3 * s for s, t in sizes.values())
    scored = {x["doc_id"]: x for x in context_tree.context_tree_scores(docs).collect()}
    for i, text, _ in rows:
        x = scored[i]
        assert x["n_tokens"] == len(text.split()) + 1 and x["n_bytes"] == len(" ".join(text.split())) + 1 and math.isfinite(x["score"]) and x["score"] < 0


def test_equally_near_examples_vote_alike_however_rows_are_dealt(spark):
    """Many examples at the same cosine: reruns over other partitions give the same scores."""
    rows = [(i, f"same words here v{i % 50}" if i < 200 else "same words grolt") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i >= 200 or i % 9 == 0)) for i in range(240)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ({x["doc_id"]: (round(x["score"], 12), [e["doc_id"] for e in x["evidence"]]) for x in toxicity.toxicity_scores(d, labels).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert a == b and len(a) == 240
