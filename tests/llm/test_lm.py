import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.llm import common, lm


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))


def corpus(n=300, seed=2):
    """Two made-up languages, each with nouns and verbs that alternate."""
    rng = random.Random(seed)
    make = lambda letters, end: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) + end for _ in range(150)]
    tongues = [(make("abcd", "um"), make("abcd", "it")), (make("wxyz", "ski"), make("wxyz", "oj"))]
    texts = [None, "", "ONE One one", "café Été\ttab\nline"]
    for _ in range(n):
        noun, verb = rng.choice(tongues)
        texts.append(" ".join(rng.choice(noun if i % 2 else verb) for i in range(rng.randrange(4, 60))))
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(corpus())], "doc_id long, text string, unit string, score double")


@pytest.mark.parametrize("most_words", [1_000_000, 150, 3, 0])
def test_scores_equal_a_plain_count(spark, docs, most_words):
    texts = corpus()
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    model, counts = lm.learn(docs, ~(lm.crc_bucket("doc_id", 5) == 1), most_words=most_words)
    rows = {r["doc_id"]: r for r in lm.score_texts(docs, model, counts).collect()}
    c = Counter(w for t, h in zip(texts, held, strict=True) if not h for w in [*words(t), "\0end"])
    N, V = sum(c.values()), len(c)
    assert (model.train_tokens, model.distinct) == (N, V)
    for i, t in enumerate(texts):
        w = [*words(t), "\0end"]
        base = sum(math.log10((c[x] + 0.5) / (N + 0.5 * (V + 1))) for x in w)
        assert (rows[i]["n_tokens"], rows[i]["n_known"]) == (len(w), sum(c[x] > 0 for x in w))
        assert abs(rows[i]["base_score"] - base) < 1e-6
    held_ids = [i for i in rows if held[i]]
    assert sum(rows[i]["score"] for i in held_ids) > sum(rows[i]["base_score"] for i in held_ids)
    if most_words < 1000:
        assert model.least > 1


def test_probabilities_sum_to_one(docs):
    model, counts = lm.learn(docs, lm.F.lit(True))
    rows = [r for r in counts.collect()]
    kind, _, _ = model.held.find(np.array([r["word"] for r in rows]), np.array([max(0, r["ending"]) for r in rows], np.int16), model.classes, model.own)
    assert (kind[np.array([r["word"] for r in rows]) == lm.END] == lm.END_CLASS).all()
    n = np.array([r["n"] for r in rows])
    for a in (0, 1, 5, 17):
        # the known words, and one unknown word for each class and for the unigram
        known = (10 ** model.joint[a, kind] * (n + 0.5)).sum()
        unknown = (10 ** model.joint[a] * 0.5).sum() - (lm.CLASSES - 1) * 0.5 * (1 - lm.CLASS_SHARE) / (model.train_tokens + 0.5 * (model.distinct + 1))
        assert abs(known + unknown - 1) < 1e-9


def test_exchange_raises_the_likelihood_and_finds_the_classes(docs):
    counts = lm.word_counts(docs)
    held, _ = lm.lookup(counts, 10**6)
    bigrams = lm.unit_bigrams(docs, held).cache()
    n = 1 << lm.UNIT_BITS
    classes = 1 + np.arange(n) % 4
    classes[0] = 0
    seen = []
    for _ in range(6):
        after, before = lm.class_sums(bigrams, classes, 5)
        matrix = np.zeros((5, 5))
        np.add.at(matrix, classes, after)
        seen.append(lm.likelihood(matrix))
        lm.exchange(after, before, classes)
    assert seen[-1] > seen[0] and seen[-1] >= max(seen) - 1e-6
    place = {}
    for text in corpus():
        for w in words(text):
            place.setdefault(next((e for e in ("um", "it", "ski", "oj") if w.endswith(e)), None), set()).add(w)
    by_word = dict(zip(held.words.tolist(), classes[held.units].tolist(), strict=True))
    import pyarrow as pa

    of = {}
    for end, some in place.items():
        if end:
            for _, _, h, _, _ in lm.tokens(pa.array(sorted(some))):
                of[end] = Counter(by_word[x] for x in h.tolist()).most_common(1)[0]
                assert of[end][1] > 0.9 * len(some)
    assert len({c for c, _ in of.values()}) == 4


@pytest.mark.parametrize("parts", [5, 70])
def test_bigrams_by_brute_force(docs, parts):
    texts = corpus()
    counts = lm.word_counts(docs)
    held, _ = lm.lookup(counts, 10**6)
    import pyarrow as pa

    unit = {}
    for w in {w for t in texts for w in words(t)}:
        for _, _, h, e, _ in lm.tokens(pa.array([w])):
            unit[w] = int(held.find(h, e)[0][0])
    want = Counter()
    for t in texts:
        line = [0, *(unit[w] for w in words(t)), 0]
        want.update(zip(line, line[1:], strict=False))
    got = {0: Counter(), 1: Counter()}
    for r in lm.unit_bigrams(docs.repartition(parts), held).collect():
        for code, n in zip(np.frombuffer(r["codes"], np.uint32).tolist(), np.frombuffer(r["counts"], np.uint64).tolist(), strict=True):
            a, b = code >> lm.UNIT_BITS, code & ((1 << lm.UNIT_BITS) - 1)
            got[r["side"]][(a, b) if r["side"] == 0 else (b, a)] += n
    assert got[0] == want and got[1] == want


def all_free(docs):
    """The held words of a model in which no word has a unit, the words by name, and classes of units."""
    import pyarrow as pa

    held, _ = lm.lookup(lm.word_counts(docs), 10**6)
    held.units[held.words != lm.END] = -1
    classes = np.random.default_rng(3).integers(1, lm.CLASSES, 1 << lm.UNIT_BITS)
    classes[lm.END_UNIT] = lm.END_CLASS
    place, kind = {}, {}
    for w in {w for t in corpus() for w in words(t)}:
        for _, _, h, e, _ in lm.tokens(pa.array([w])):
            place[w], kind[w] = int(np.searchsorted(held.words, h[0])), int(classes[1 + e[0]])
    return held, classes, place, kind


@pytest.mark.parametrize("parts", [1, 9])
def test_words_move_to_the_best_class_by_brute_force(docs, parts):
    held, classes, place, kind = all_free(docs)
    own = np.full(len(held.words), -1, np.int16)
    matrix = lm.class_bigrams(docs.repartition(parts), held, classes, own, lm.CLASSES)
    lines = [["", *words(t), ""] for t in corpus()]
    kind[""] = lm.END_CLASS
    want = np.zeros_like(matrix)
    for line in lines:
        for a, b in zip(line, line[1:], strict=False):
            want[kind[a], kind[b]] += 1
    assert (matrix == want).all()
    own = lm.word_classes(docs.repartition(parts), held, classes, matrix)
    n = Counter(w for line in lines for w in line)
    moved = 0
    for w in place:
        if n[w] < lm.LEAST_TOKENS:
            assert own[place[w]] == -1
            continue
        after, before = Counter(), Counter()
        for line in lines:
            for a, b in zip(line, line[1:], strict=False):
                if b == w:
                    after[kind[a]] += 1
                if a == w:
                    before[kind[b]] += 1
        k = kind[w]
        gain = {}
        for j in range(1, lm.CLASSES):
            less = j == k  # without the word's own counts
            gain[j] = sum(c * math.log(matrix[a, j] - c * less + 0.5) for a, c in after.items()) + sum(c * math.log(matrix[j, b] - c * less + 0.5) for b, c in before.items())
            gain[j] -= sum(n[w] * math.log(x - n[w] * less + 0.5 * lm.CLASSES) for x in (matrix[:, j].sum(), matrix[j].sum()))
        assert gain[int(own[place[w]])] >= max(gain.values()) - 1e-6
        moved += own[place[w]] != k
    assert moved > 100
    later = lm.class_bigrams(docs, held, classes, own, lm.CLASSES)
    assert later.sum() == matrix.sum() and (later != matrix).any()
    held.counts[:] = 1
    assert (lm.word_classes(docs, held, classes, matrix) == -1).all()


def test_scores_follow_words_that_left_their_endings(docs, monkeypatch):
    monkeypatch.setattr(lm, "cluster", lambda bigrams, take=lm.cluster: take(bigrams, rounds=1))
    lookup = lm.lookup

    def few(counts, most):
        held, least = lookup(counts, most)
        held.units[(held.units >= 0) & (held.counts < 40) & (held.words != lm.END)] = -1
        return held, least

    monkeypatch.setattr(lm, "lookup", few)
    model, counts = lm.learn(docs, lm.F.lit(True))
    assert (model.own >= 0).sum() > 100
    joint = 10 ** model.joint
    kind, n, _ = model.held.find(model.held.words, np.maximum(model.held.endings, 0), model.classes, model.own)
    for a in (0, 3, 20):
        unknown = (joint[a] * 0.5).sum() - (lm.CLASSES - 1) * 0.5 * (1 - lm.CLASS_SHARE) / (model.train_tokens + 0.5 * (model.distinct + 1))
        assert abs((joint[a, kind] * (n + 0.5)).sum() + unknown - 1) < 1e-9
    assert lm.score_texts(docs, model, counts).where("score > base_score").count() > 250


def test_empty_table(docs):
    model, counts = lm.learn(docs.limit(0), lm.F.lit(True))
    assert lm.score_texts(docs.limit(0), model, counts).count() == 0
    rows = lm.score_texts(docs, model, counts).collect()
    assert len(rows) == docs.count() and all(np.isfinite(r["score"]) and r["n_known"] == 0 for r in rows)


def test_sums_of_codes_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    size = 1_000_000
    code, n = rng.integers(0, 1 << 28, size), rng.integers(1, 9, size)
    code[::3] = code[0]
    want, place = np.unique(code, return_inverse=True)
    totals = np.bincount(place, n).astype(np.int64)
    tracemalloc.start()
    parts = [(code, n)]
    value, sums = lm.summed(parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (value == want).all() and (sums == totals).all() and sums.dtype == n.dtype and not parts
    assert peak < 5.5 * 8 * size  # by numbers of places it was more


def test_texts_go_to_workers_in_small_batches(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(lm, "stored", lambda df, name, rows=None: asked.append((name, rows)) or common.stored(df, name, rows))
    docs = spark.createDataFrame([(i, f"a b c{i} d{i % 3}") for i in range(40)], "doc_id long, text string")
    model, counts = lm.learn(docs, F.lit(True), most_words=3)
    assert lm.score_texts(docs, model, counts).count() == 40
    assert dict(asked) == {"word_counts": 1000, "bigrams": 1000, "scores": 1000}
