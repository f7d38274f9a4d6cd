import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from helixlake.llm import pii


def plain(text):
    """The contract's patterns as written."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "1", "23", "255", "256", "4111111111111111", "-", " ", "+", "(", ")", "é", "x@y.z", "1.2.3.4", "\n"]), max_size=25))
def test_patterns_as_written(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain(text)


def corpus():
    out = []
    for i in range(120):
        out.append(f"call +1 ({200 + i}) 555-{1000 + 7 * i} or write to ab{i}.c@mail{i % 7}.example.com from 10.{i}.3.{i % 250} today version 2.{i % 9} of {1990 + i % 30}")
        out.append(f"under licence {i % 5}.0 there are {i} things and code AKIA{i}QX{i * 7}Z here with {i * 131 % 977} more")
    return out


def test_repeats_settle_one_another():
    field = pii.fit(corpus())
    text = "reach me at +1 (301) 555-1234 soon. Some words then. Again, (301) 555-1234 works. Version 2.0 of 1999 is out."
    (base, added), *_ = pii.find_spans([text], field)
    assert [s[0] for s in base] == ["phone"]
    assert any(k == "phone" and "555-1234" in text[a:b] for k, a, b in added)
    assert not any("2.0" in text[a:b] or "1999" in text[a:b] for _, a, b in added)


def test_clean_texts_stay_clean():
    field = pii.fit(corpus())
    texts = ["Licensed under CC BY-NC 4.0.", "Apache License, Version 2.0.", "no digits at all", "", None, "in 1984 there were 12 of them"]
    assert all(base == [] and added == [] for base, added in pii.find_spans(texts, field))


def test_messages_equal_exact_marginals_on_a_tree():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    field = pii.Field(rng.normal(size=(pii.SIZE, pii.LABELS)), rng.normal(size=(pii.LABELS,) * 2), rng.normal(size=(pii.LABELS,) * 2))
    g = pii.Graph([0] * 4, [0] * 4, [1] * 4, rng.integers(0, pii.SIZE, (4, 3)), np.array([-1, -1, 2, -1]), np.array([[0, 1], [1, 2]]), np.array([[1, 3]]))
    want = np.zeros((4, pii.LABELS))
    for y in itertools.product(range(pii.LABELS), repeat=4):
        if y[2] != 2:
            continue
        s = sum(field.unary[g.features[n]].sum(axis=0)[y[n]] for n in (0, 1, 3)) + field.chain[y[0], y[1]] + field.chain[y[1], y[2]] + field.skip[y[1], y[3]]
        for n in range(4):
            want[n, y[n]] += np.exp(s)
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(field.marginals(g, rounds=200), want, atol=1e-3)


def test_query_and_redaction(spark):
    texts = corpus() + [None, "", "a@b.co " * 400]
    docs = spark.createDataFrame([(i, t, "src", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_chars long")
    field = pii.learn(docs)
    rows = {r["doc_id"]: r for r in pii.tag(docs, field).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        base = plain(t or "")
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(rows[i]["spans"].split(","))
    clean = {r["doc_id"]: r for r in pii.redact(docs, field).collect()}
    assert not re.search("@|555", clean[0]["text"]) and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[240]["text"] is None and clean[1]["text"] == texts[1]
    empty = docs.limit(0)
    assert pii.tag(empty, pii.learn(empty)).count() == 0
