import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from helixlake.llm import chat

PIECES = st.lists(st.sampled_from(["<", "|", "\\", "<|im_end|>", "<|im_start|>", "im_end", "|>", "\n", "assistant", "é", "a"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), PIECES), PIECES), max_size=6))
def test_round_trip(messages):
    text, starts, ends = chat.render(messages)
    assert chat.parse(text) == messages
    assert "".join(chat.unescape(text[a:b]) for a, b in zip(starts, ends, strict=True)) == "".join(t for r, t in messages if r == "assistant")


def test_fold():
    events = [
        ("open", 1, "user", ""), ("delta", 1, None, "Hel"), ("delta", 1, None, "lo"), ("open", 2, "assistant", ""), ("delta", 2, None, "bad"), ("open", 3, "user", "later"),
        ("regenerate", 2, None, ""), ("delta", 2, None, "go"), ("delta", 2, None, "od"), ("edit", 1, None, "Hi"), ("delta", 9, None, "lost"), ("open", 4, "user", None), ("delete", 4, None, None),
    ]
    assert chat.fold(events) == [("user", "Hi"), ("assistant", "good")]
    assert chat.fold([]) == [] and chat.fold([("edit", 1, None, "x")]) == []


def test_query_rows(spark, tmp_path):
    rows = [(1, 0, "user", "q" * 1300), (1, 1, "assistant", chat.PROBE), (2, 0, "assistant", None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, None, None, "n"), (3, 2, "assistant", "late"), (3, 1, "user", "early")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", chat.F.lit(1)).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.op7_chat(spark, str(tmp_path)).collect()}
    want = {
        1: [("user", "q" * 1300), ("assistant", chat.PROBE)], 2: [("assistant", ""), ("assistant", "x"), ("assistant", "x")], None: [("", "n")], 3: [("user", "early"), ("assistant", "late")],
        -1: [("user", chat.PROBE), ("assistant", chat.PROBE)],
    }
    assert set(got) == set(want)
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[k]["n_turns"], got[k]["loss_chars"]) == (len(turns), len(loss))
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[k]["formatted_chars"] == len(chat.render(turns)[0])


def test_empty_log(spark):
    events = spark.createDataFrame([], "conv_id long, seq long, kind string, message long, role string, text string")
    assert chat.format_conversations(events).count() == 0
