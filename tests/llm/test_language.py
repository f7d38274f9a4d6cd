import random
import zlib

from helixlake.llm import language as lg
from helixlake.llm.common import crc_bucket

ALPHABETS = {"aa": ["the", "and", "ing", "ion", "er"], "bb": ["sch", "ung", "ein", "der", "ich"], "cc": ["eau", "que", "les", "oux", "ment"]}


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        name = rng.choice(list(ALPHABETS))
        out.append((i, " ".join("".join(rng.choice(ALPHABETS[name]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(15, 80))), name))
    return out


def test_held_out_accuracy_and_odd_texts(spark):
    rows = corpus()
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "bb"), (1003, "The And", None), (1004, rows[0][1] * 300, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double")
    model = lg.learn(docs, crc_bucket("doc_id", 3) != 1)
    assert sorted(model.content) == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in lg.identify(docs, model).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [(i, name) for i, _, name in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["lang_pred"] == name for i, name in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True) for i in (1000, 1001, 1002))
    assert got[1004]["lang_pred"] == rows[0][2]
    again = {r["doc_id"]: r["lang_pred"] for r in lg.identify(docs.repartition(7), lg.learn(docs.repartition(5), crc_bucket("doc_id", 3) != 1)).collect()}
    assert all(again[i] == got[i]["lang_pred"] for i in again)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    model = lg.learn(docs, lg.F.lit(True))
    assert [r["lang_pred"] for r in lg.identify(docs, model).collect()] == ["und"]
    assert lg.identify(docs.limit(0), model).count() == 0


def test_narrow_margins_are_marked():
    model = lg.Dictionaries({"x": b"same words here", "y": b"same words here"})
    assert model.classify("same words here")[0] == "x" and model.classify("same words here")[2]
