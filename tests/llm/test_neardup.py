import random
import re
from collections import Counter

import numpy as np

from helixlake.llm import common, kernels
from helixlake.llm import neardup as nd


def words(text):
    low = "".join(c.lower() if c < "\x80" or "\xc0" <= c <= "\xde" and c != "\xd7" else c for c in text or "")
    return re.findall("[0-9a-z_\x80-\U0010ffff]+", low)


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(texts, least=0.8):
    """Class (smallest index) of each text: components of links of at least ``least``."""
    s = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if s[i] and s[j] and jaccard(s[i], s[j]) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def family(rng, vocabulary, base, n):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(0, max(2, len(w) // 25))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghiéö") for _ in range(rng.randrange(1, 9))) for _ in range(900)]
    texts = [None, "", "!!! ...", "one", "one", "Two words", "a b c d", "a b c d e", "x " * 400, "x " * 420]
    for _ in range(25):
        base = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([8, 30, 90, 300])))
        texts += family(rng, vocabulary, base, rng.randrange(1, 9))
    base = " ".join(rng.choice(vocabulary) for _ in range(120))
    texts += family(rng, vocabulary, base, 60) + [base] * 40 + [base.upper() + "!"] * 3
    rng.shuffle(texts)
    return texts


def test_classes_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 1.0, "k") for i, t in enumerate(texts)], "doc_id long, text string, node double, key string")
    rows = {r["doc_id"]: r for r in nd.near_duplicates(docs).collect()}
    want = brute(texts)
    assert [rows[i]["class_id"] for i in range(len(texts))] == want
    sizes = Counter(want)
    assert all(rows[i]["class_size"] == sizes[want[i]] for i in rows)
    assert sorted(i for i in rows if rows[i]["keep"]) == sorted(set(want))
    kept = nd.drop_near_duplicates(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want))
    assert all(r["text"] == texts[r["doc_id"]] and r["key"] == "k" for r in kept)


def test_pairs_on_one_template_do_not_depend_on_seeds(spark, monkeypatch):
    monkeypatch.setattr(nd, "SEEDS", 1)
    monkeypatch.setattr(nd, "SPAN", 1)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(8))
    template = [word() for _ in range(120)]
    texts = []
    for _ in range(130):  # texts of different pairs are about 0.7 alike, those of a pair 0.9
        w = list(template)
        for at in rng.sample(range(5, 115), 2):
            w[at] = word()
        texts.append(" ".join(w))
        w[rng.randrange(5, 115)] = word()
        texts.append(" ".join(w))
    want = brute(texts)
    assert len(set(want)) > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (nd.__dict__.get("BLOCK_BYTES", 0), 20_000):
        monkeypatch.setattr(nd, "BLOCK_BYTES", limit, raising=False)
        assert dict(nd.near_duplicates(docs).select("doc_id", "class_id").collect()) == dict(enumerate(want))


def test_rows_that_repeat_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "g h i j k l")], "doc_id long, text string")
    got = sorted((r["class_id"] or 0, r["class_size"]) for r in nd.near_duplicates(docs).collect())
    assert got == [(0, 1), (1, 3), (1, 3), (1, 3), (2, 1)]
    assert sorted((r["doc_id"] or 0) for r in nd.drop_near_duplicates(docs).collect()) == [0, 1, 2]
    assert nd.near_duplicates(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(None, ""), (None, "!!!"), (7, None), (7, "")], "doc_id long, text string")
    assert nd.drop_near_duplicates(blank).count() == 4


def test_texts_are_dealt_out_once_to_drop_duplicates_and_nothing_else_is_kept(spark):
    texts = corpus(5)
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string")
    common.drop_stored(spark)
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "-1")
        kept = nd.drop_near_duplicates(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(setting, before)
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 2  # of texts, and of the keys that stay
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute(texts)))
    assert common.drop_stored(spark) == 1


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    k = 2000
    for n, heavy in ((3, 1), (40, 1), (40, 6), (300, 3)):
        h = kernels.mix(np.arange(2 * n, dtype=np.uint64) + np.uint64(n * 1000))
        wa, wb = rng.integers(0, heavy + 1, 2 * n), rng.integers(0, heavy + 1, 2 * n)
        wb = np.where(rng.random(2 * n) < 0.7, wa, wb)
        a, b = np.flatnonzero(wa), np.flatnonzero(wb)
        if not len(a) or not len(b):
            continue
        sig = nd.dart_minhash(np.concatenate([h[a], h[b]]), np.repeat([0, 1], [len(a), len(b)]), np.concatenate([wa[a], wb[b]]), 2, k)
        want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / k) + 0.01
        alone = nd.dart_minhash(h[a], np.zeros(len(a), np.int64), wa[a], 1, k)
        assert (alone[0] == sig[0]).all()


def test_tokens_and_shingles_as_by_regex():
    import pyarrow as pa

    texts = corpus(9)[:80] + ["ÀÉ×ß a_b--c9", "\x00a\x00b", "tab\tline\nfeed\x0bvt"]
    for mode, split in ((True, words), (False, lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or "")))):
        seen = {}
        for first, data, ends in kernels.chunks(pa.array(texts), 500):
            h, a, b, rows = kernels.tokenize(data, ends, words=mode)
            for i in range(len(ends) - 1):
                want = split(texts[first + i])
                at = np.flatnonzero(rows == i)
                assert len(at) == len(want)
                for j, w in zip(at, want):
                    assert seen.setdefault(w, h[j]) == h[j]
        assert len(set(seen.values())) == len(seen)
