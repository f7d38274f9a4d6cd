import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helixlake.llm import passages as ps


def cartesian(v, t):
    """Compact windows by recursion on the first minimum of each range."""
    out, todo = [], [(0, len(v) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a + 1 < t:
            continue
        c = a + int(np.argmin(v[a : b + 1]))
        out.append((c, a, b))
        todo += [(a, c - 1), (c + 1, b)]
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 30), max_size=40), max_size=5), st.integers(1, 9))
def test_windows_equal_cartesian_trees(texts, t):
    v = np.array([x for w in texts for x in w], np.uint64)
    rows = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
    got = sorted(zip(*(x.tolist() for x in ps.compact_windows(v, rows, t)), strict=True))
    want, at = [], 0
    for w in texts:
        want += [(c + at, a + at, b + at) for c, a, b in cartesian(np.array(w), t)]
        at += len(w)
    # among equal values ours may stop a window at a later equal one's left; centres and lefts agree, rights for distinct values
    assert got == sorted(want)


def text_of(rng, vocabulary, n):
    return [rng.choice(vocabulary) for _ in range(n)]


def test_planted_passages_are_found_and_others_are_not(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    long, noisy, short = text_of(rng, vocabulary, 70), text_of(rng, vocabulary, 120), text_of(rng, vocabulary, 40)
    docs, planted = [], {}
    for i in range(120):
        w = text_of(rng, vocabulary, rng.randrange(60, 400))
        at = rng.randrange(len(w))
        if i % 6 == 0:
            planted[i] = (at, 70)
            w[at:at] = long
        elif i % 6 == 1:
            p = list(noisy)
            if i > 1:
                del p[60]
                p[20] = "zzz"
            planted[i] = (at, len(p))
            w[at:at] = p
        elif i % 6 == 2:
            w[at:at] = short
        docs.append((i, " ".join(w)))
    copies = " ".join(text_of(rng, vocabulary, 80))
    docs += [(200 + i, copies.upper() if i else copies) for i in range(5)]
    docs += [(300, None), (301, ""), (302, "few words"), (303, "few words")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int")
    rows = ps.repeated_passages(df).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(planted) | set(range(200, 205))
    for i, (at, n) in planted.items():
        assert any(abs(r["start_word"] - at) <= 8 and abs(r["end_word"] - at - n) <= 8 and r["other_id"] in planted for r in by_doc[i]), (i, at, n, by_doc[i])
    for i in range(200, 205):
        assert [(r["start_word"], r["end_word"], r["other_id"]) for r in by_doc[i]] == [(0, 80, 200 if i > 200 else 204)]
    assert ps.repeated_passages(df.limit(0)).count() == 0


def test_alignment_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        p = rng.integers(0, 1 << 30, 60).astype(np.uint32)
        a = np.concatenate([rng.integers(0, 1 << 30, rng.integers(0, 90)).astype(np.uint32), p, rng.integers(0, 1 << 30, 50).astype(np.uint32)])
        b = np.concatenate([rng.integers(0, 1 << 30, rng.integers(0, 90)).astype(np.uint32), p, rng.integers(0, 1 << 30, 50).astype(np.uint32)])
        s = int(np.flatnonzero(a == p[0])[0])
        h = int(np.flatnonzero(b == p[0])[0])
        region = s - h + int(rng.integers(-5, 6)), np.array([s]), np.array([s + 59]), np.array([0])
        assert ps.align(a, b, region, 46, 0.8) == ([(s, s + 60, h, h + 60, 1.0)], [])


def test_passages_around_a_line_of_all_texts_are_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(7))
    line = [word() for _ in range(30)]
    docs, partner = [], {}
    for pair in range(60):
        left, right = [word() for _ in range(12)], [word() for _ in range(12)]
        for i in (2 * pair, 2 * pair + 1):  # 54 words, of which all texts have 30
            docs.append((i, " ".join([word() for _ in range(40)] + left + line + right + [word() for _ in range(40)])))
            partner[i] = i ^ 1
    rng.shuffle(docs)
    rows = ps.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"], r["other_id"]) for r in rows} == {(i, 40, 94, o) for i, o in partner.items()}


def covered(rows):
    """The places (doc, word) in the rows."""
    return {(r["doc_id"], w) for r in rows for w in range(r["start_word"], r["end_word"])}


def exact(texts, n=50):
    """Every place in a run of ``n`` words that stands in another text too."""
    held = {}
    for i, w in texts.items():
        for k in range(len(w) - n + 1):
            held.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(i, k + j) for i, w in texts.items() for k in range(len(w) - n + 1) if len(held[tuple(w[k : k + n])]) > 1 for j in range(n)}


def test_passages_with_a_common_core_equal_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(7))
    some = lambda n: [word() for _ in range(n)]
    core, second = some(40), some(30)
    texts = {}
    for pair in range(100):  # 64 words, of which all texts have 40
        left, right = some(rng.randrange(25)), None
        right = some(24 - len(left))
        for i in (2 * pair, 2 * pair + 1):
            texts[i] = some(rng.randrange(60)) + left + core + right + some(rng.randrange(60))
    for pair in range(20):  # two common lines, side by side only in one pair of texts
        a = some(rng.randrange(3))
        for i in (1000 + 2 * pair, 1001 + 2 * pair):
            texts[i] = some(20) + core[20:] + a + second + some(30) if pair else some(20) + core + second + some(30)
    for i in range(2000, 2060):
        texts[i] = some(30) + second + some(30)
    want = exact(texts)
    docs = list({i: " ".join(w) for i, w in texts.items()}.items())
    rng.shuffle(docs)
    rows = ps.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    got = covered(rows)
    assert len(got & want) >= 0.99 * len(want)
    assert len({i for i, _ in want} - {i for i, _ in got}) == 0
    assert sum(len(range(r["start_word"], r["end_word"])) for r in rows) == len(got)  # no word is in two rows


def test_every_occurrence_in_a_text_is_found(spark):
    rng = random.Random(12)
    some = lambda n: ["".join(rng.choice("abcdefghijk") for _ in range(7)) for _ in range(n)]
    p, q = some(70), some(60)
    for order in range(4):  # whichever text comes first
        texts = {i: some(50) + p + some(20) for i in range(2)}
        texts[9 - order] = some(50) + p + some(100) + p + some(30) + q + some(70) + q
        rows = ps.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")).collect()
        assert sorted((r["start_word"], r["end_word"]) for r in rows if r["doc_id"] == 9 - order) == [(50, 120), (220, 290)]
        assert covered(rows) == exact(texts)


def test_a_family_on_one_text_keeps_all_its_members(spark):
    rng = random.Random(13)
    some = lambda n: ["".join(rng.choice("abcdefghijk") for _ in range(7)) for _ in range(n)]
    base = some(120)
    texts = {}
    for i in range(200):  # 120 words with one changed in each: two members are 0.84 alike
        w = list(base)
        for at in rng.sample(range(120), 1):
            w[at] = some(1)[0]
        texts[i] = some(40) + w + some(40)
    rows = ps.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(4)).collect()
    assert len({r["doc_id"] for r in rows}) >= 190
    assert len(rows) < 230


def test_null_repeated_and_very_long_texts(spark):
    rng = random.Random(14)
    some = lambda n: ["".join(rng.choice("abcdefghijk") for _ in range(7)) for _ in range(n)]
    p = some(55)
    long = some(150_000) + p + some(1000)
    docs = [(1, " ".join(long)), (2, " ".join(some(30) + p)), (3, "x " * 30_000), (4, "x " * 30_001 + "y"), (None, None), (None, " ".join(p)), (5, ""), (5, "")]
    rows = ps.repeated_passages(spark.createDataFrame([(i, t, 0, "n") for i, t in docs], "doc_id long, text string, node int, start string")).collect()
    spans = {(r["doc_id"], r["start_word"], r["end_word"]) for r in rows}
    assert {(1, 150_000, 150_055), (2, 30, 85), (None, 0, 55), (4, 0, 30_001), (3, 0, 30_000)} == spans


def test_a_passage_beside_noise_is_found_whole():
    rng = np.random.default_rng(3)
    some = lambda n: rng.integers(0, 1 << 30, n).astype(np.uint32)
    a = some(113)
    b = a.copy()
    b[30:35] = some(5)
    for k in range(65, 113, 8):  # after the passage, three of eight are alike
        b[k : k + 5] = some(5)
    region = 0, np.array([0]), np.array([29]), np.array([0])
    got, runs = ps.align(a, b, region, 46, 0.8)
    whole = [(s, e) for s in range(113) for e in range(s + 46, 114) if ps._alike(a, b, s, e, s, e) >= 0.8]
    assert {k for s, e, *_ in got for k in range(s, e)} >= {k for s, e in whole for k in range(s, e) if a[k] == b[k]} >= set(range(30))
    assert all(ps._alike(a, b, *r[:4]) >= 0.8 and r[1] - r[0] >= 46 for r in got)
    same = set(np.flatnonzero(a == b).tolist())
    assert {k for s, e in [*runs, *(r[:2] for r in got)] for k in range(s, e)} >= same


def test_two_parts_that_are_a_passage_only_together():
    rng = np.random.default_rng(4)
    some = lambda n: rng.integers(0, 1 << 30, n).astype(np.uint32)
    x, y = some(44), some(44)
    a, b = np.concatenate([some(60), x, some(17), y, some(60)]), np.concatenate([some(60), x, some(4), y, some(60)])
    assert ps._alike(a, b, 60, 165, 60, 152) >= 0.8
    got, _ = ps.align(a, b, (0, np.array([60]), np.array([103]), np.array([0])), 46, 0.8)
    assert [r[:4] for r in got] == [(60, 165, 60, 152)]


def test_pieces_whose_stretch_goes_on_past_a_cut_are_compared():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 30, 150).astype(np.uint32)
    b = rng.integers(0, 1 << 30, 150).astype(np.uint32)
    b[125:] = a[125:]
    piece = lambda x: (x, np.array([0, 150]))
    for left, right, far in ((False, True, False), (False, False, True), (True, False, True)):
        cuts = [np.array([left]), np.array([right])]
        assert ps._far_apart(np.zeros(1, np.int64), np.array([0]), piece(a), piece(b), cuts, 0.8 * 46)[0].tolist() == [far]


def test_a_line_that_its_text_has_before_hides_no_passage(spark):
    rng = random.Random(15)
    some = lambda n: ["".join(rng.choice("abcdefghijk") for _ in range(7)) for _ in range(n)]
    texts = {}
    for k in range(60):
        line = some(42)
        passage = some(4) + line + some(4)
        texts[2 * k] = some(30) + line + some(90) + passage + some(30)
        texts[2 * k + 1] = some(30) + passage + some(30)
    docs = [(i, " ".join(w)) for i, w in texts.items()]
    got = covered(ps.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect())
    assert exact(texts) <= got


def parts_by_brute_force(a, b, w, other, t, least):
    """The parts that ``_inner`` returns, each compared as sets."""
    cut = [i for i in range(1, len(w)) if w[i] - w[i - 1] > 1 or other[i] - other[i - 1] != 1]
    runs = list(zip([0, *cut], [*cut, len(w)], strict=True))
    out, reach = [], -1
    for k in range(len(runs)):
        for x in range(len(runs) - 1, max(k - 1, reach), -1):
            s, e = int(w[runs[k][0]]), int(w[runs[x][1] - 1]) + 1
            met = other[runs[k][0] : runs[x][1]]
            hs, he = int(met.min()), int(met.max()) + 1
            p, q = {*a[s:e].tolist()}, {*b[hs:he].tolist()}
            similarity = len(p & q) / len(p | q)
            if e - s >= t and similarity >= least:
                out.append((s, e, hs, he, similarity))
                reach = x
                break
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 1 << 30), st.sampled_from([3, 10, 1000]), st.floats(0, 0.5), st.integers(4, 20))
def test_parts_of_a_stretch_equal_brute_force(seed, vocabulary, share, t):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, vocabulary, 90).astype(np.uint32)
    b = np.where(rng.random(90) < share, rng.integers(0, vocabulary, 90), a).astype(np.uint32)
    drop = np.flatnonzero(rng.random(90) < share / 4)
    b = np.delete(b, drop)
    w, other = ps._matches(a, b, 0, 0, len(a), ps.DRIFT)
    if len(w):
        assert ps._inner(a, b, w, other, t, 0.8) == parts_by_brute_force(a, b, w, other, t, 0.8)
        cells = [list(x) for x in ([(k, m.tolist()) for k, m in ps._may_be_passages(a, b, *bounds, t, 0.8, n)] for bounds in [_runs(w, other)] for n in (1, 1 << 20))]
        assert cells[0] == cells[1]


def _runs(w, other):
    cut = np.flatnonzero((np.diff(w) > 1) | (np.diff(other) != 1))
    first, last = np.append(0, cut + 1), np.append(cut, len(w) - 1)
    return w[first], w[last] + 1, other[first], other[last] + 1


def test_parts_that_cannot_be_passages_are_not_compared(monkeypatch):
    """Two of three shingles are shared all along, in order: no part of it is a passage, and bounds alone say so."""
    a = np.arange(600, dtype=np.uint32)
    b = a.copy()
    b[::3] += 10_000
    b = np.delete(b, [0])
    w, other = ps._matches(a, b, 1, 0, len(a), ps.DRIFT)
    calls = []
    alike = ps._alike
    monkeypatch.setattr(ps, "_alike", lambda *x: calls.append(0) or alike(*x))
    assert ps._inner(a, b, w, other, 46, 0.8) == [] and not calls
    # the first part shares all but is followed by words of the second only: counted on both sides
    b3 = np.concatenate([a[:100], np.arange(20_000, 20_012, dtype=np.uint32), a[100:140], np.arange(30_000, 30_012, dtype=np.uint32), a[140:180]])
    w, other = ps._matches(a[:180], b3, 0, 0, 180, 30)
    got = ps._inner(a[:180], b3, w, other, 46, 0.9)
    assert got == parts_by_brute_force(a[:180], b3, w, other, 46, 0.9) and len(calls) == len(got)
