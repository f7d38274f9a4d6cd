import random
import zlib

import numpy as np
import pyarrow as pa

from helixlake.llm import quality as q


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    prose = lambda m: " ".join(" ".join(rng.choice(vocabulary) for _ in range(12)).capitalize() + "." for _ in range(m // 12 + 1))
    texts, good = [], []
    for _ in range(n):
        t, kind = prose(rng.randrange(20, 300)), rng.randrange(12)
        if kind == 0:
            t = "!! ".join(w.upper() for w in t.split())
        elif kind == 1:
            t = " ".join(w + rng.choice(["***", "%%%", "&&&"]) for w in t.split())
        texts.append(t)
        good.append(int(kind > 1))
    return texts, np.array(good)


def auc(score, good):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n1, n0 = good.sum(), (1 - good).sum()
    return (rank[good == 1].sum() - n1 * (n1 - 1) / 2) / n1 / n0


def test_held_out_documents_and_the_prior(spark):
    texts, good = corpus(2400)
    docs = spark.createDataFrame([(i, t, "zz", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good) if i % 2], "doc_id long, quality int")
    model = q.train_on_labels(docs, labels)
    assert abs(model.prior - good.mean()) < 0.06
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in range(len(texts))])
    score = np.array([r["score"] for r in q.score_documents(docs, model).orderBy("doc_id").collect()])
    assert auc(score[held], good[held]) > 0.98
    assert (score[held & (good == 1)] >= 0.3).mean() > 0.99 and (score[held & (good == 0)] < 0.3).mean() > 0.8
    kept = {r["doc_id"] for r in q.keep_good(docs, model).collect()}
    assert kept == set(np.flatnonzero(score >= 0.3).tolist())


def test_risk_is_minimised_by_the_gradient():
    """The fitted weights beat small random moves on the PU risk they minimise."""
    rng = np.random.default_rng(0)
    positive, unlabelled = rng.normal(1, 1, (400, 3)), np.concatenate([rng.normal(1, 1, (400, 3)), rng.normal(-2, 1, (400, 3))])
    model = q.fit(positive, unlabelled)
    assert 0.35 < model.prior < 0.65
    p, u = model.encode(positive), model.encode(unlabelled)

    def risk(w, b):
        zp, zu = w[p].sum(axis=1) + b, w[u].sum(axis=1) + b
        return model.prior * np.logaddexp(0, -zp).mean() + max(0, np.logaddexp(0, zu).mean() - model.prior * np.logaddexp(0, zp).mean()) + 0.04 / 1200 * (w**2).sum()

    best = risk(model.weights, model.bias)
    assert all(best <= risk(model.weights + rng.normal(0, 0.2, len(model.weights)), model.bias) + 0.01 for _ in range(40))


def test_nulls_empty_and_no_training(spark):
    x = q.features(pa.array([None, "", "one two", "one two"]))
    assert (x[0] == x[1]).all() and (x[2] == x[3]).all() and np.isfinite(x).all()
    docs = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = q.train_on_labels(docs, labels)
    assert [r["score"] for r in q.score_documents(docs, model).collect()] == [1.0, 1.0]
    assert q.score_documents(docs.limit(0), model).count() == 0


def test_statistics_of_a_text_do_not_depend_on_its_batch():
    texts, _ = corpus(60)
    alone = np.concatenate([q.features(pa.array([t])) for t in texts])
    assert np.allclose(alone, q.features(pa.array(texts)))
