import os
import random

import pytest

import corpus_pipeline
from helixlake.llm import decontaminate, pii
from tests.llm.test_neardup import brute, family


def make(spark, path, texts, sources, labels, items):
    docs = [(i, t, "en", s, len(t) if t is not None else None, "x") for i, (t, s) in enumerate(zip(texts, sources, strict=True))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3).write.parquet(os.path.join(path, "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(os.path.join(path, "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(os.path.join(path, "benchmark.parquet"))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 9))) for _ in range(900)]

    def prose(n):
        return ". ".join(" ".join(rng.choice(vocabulary) for _ in range(12)).capitalize() for _ in range(n // 12 + 1)) + "."

    item = prose(40)
    texts, sources, labels = [], [], []
    for i in range(260):
        kind = i % 13
        if kind == 0:
            t = "!! ".join(w.upper() for w in prose(80).split()) + "!!"
        elif kind == 1 and i > 13:
            t = family(rng, vocabulary, texts[3], 2)[1]
        elif kind == 2:
            t = f"{prose(50)} {item} {prose(30)}"
        elif kind == 3 and i > 13:
            t = f"{prose(60)} Write to ab{i}.x@mail{i % 5}.example.com now. {prose(20)}"
        else:
            t = prose(rng.randrange(20, 200))
        texts.append(t)
        sources.append(rng.choice(["a", "b", "c", None]))
        if i % 2 == 0 or kind == 0:
            labels.append((i, 0 if kind == 0 else 1, 0))
    path = str(tmp_path_factory.mktemp("corpus"))
    make(spark, path, texts, sources, labels, [(1, item), (2, None)])
    return path, texts, item


def test_stages(spark, made):
    path, texts, item = made
    docs = spark.read.parquet(os.path.join(path, "documents.parquet"))
    columns = docs.columns
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        steps.append({r["doc_id"]: r for r in docs.collect()})
        if name != "mixing":
            assert docs.columns == columns
    good, unique, clean, masked, mixed = steps
    junk = {i for i in range(len(texts)) if i % 13 == 0}
    assert len(junk - set(good)) >= 5 and len(set(range(len(texts))) - junk - set(good)) <= 2  # few labels: test_quality has more
    ids = sorted(good)
    classes = brute([texts[i] for i in ids])
    assert sorted(unique) == sorted({ids[c] for c in classes})
    holds = lambda t: min_distance(decontaminate.normal(item), decontaminate.normal(t)) <= decontaminate.budget(len(decontaminate.normal(item)))
    assert set(unique) - set(clean) == {i for i in unique if holds(texts[i])}
    assert set(masked) == set(clean)
    for i, r in masked.items():
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert r["text"] == texts[i] or "[EMAIL]" in r["text"]
    assert set(mixed) == set(masked)
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["size"] == len(masked[i]["text"].split()) for i, r in mixed.items())


def min_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_run_and_rerun_agree(spark, made):
    path, *_ = made
    once, again = (sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) for _ in range(2))
    assert once == again and once


def test_empty_documents(spark, tmp_path):
    make(spark, str(tmp_path), [], [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_everywhere(spark, tmp_path):
    make(spark, str(tmp_path), [None, "", "word", None], [None, None, "a", "b"], [(1, None, None), (None, 1, 0)], [(None, None)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1
