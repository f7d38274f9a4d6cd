import random

from hypothesis import given, settings
from hypothesis import strategies as st

from helixlake.llm import decontaminate as d


def edit_rows(pattern, text):
    """Distances of the pattern to substrings of the text that end at each place."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return row


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", min_size=1, max_size=12), st.text("ab ", max_size=30))
def test_myers_equals_dynamic_programming(pattern, text):
    best = min((v, j) for j, v in enumerate(edit_rows(pattern, text)))
    assert d.myers(d.peq(pattern), len(pattern), text, len(pattern)) == best


def noisy(item, edits, rng):
    s = list(item)
    for _ in range(edits):
        at = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[at] = rng.choice("abcdefgh ")
        elif kind == 1:
            del s[at]
        else:
            s.insert(at, rng.choice("abcdefgh "))
    return "".join(s)


def test_matches_within_the_budget_are_found_as_by_brute_force():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 40)))) for i in range(12)]
    matcher = d.Matcher(items)
    found = missed = 0
    for _ in range(120):
        i, item = rng.choice(items)
        k = d.budget(len(item))
        text = " ".join(rng.choice(words) for _ in range(60))
        at = rng.randrange(len(text))
        text = d.normal(text[:at] + " " + noisy(item, rng.randrange(0, 2 * k), rng) + " " + text[at:])
        got = {h[0]: h for h in matcher.find(text)}
        for j, other in items:
            distance = min(edit_rows(other, text))
            if distance <= d.budget(len(other)):
                found += 1
                missed += j not in got or got[j][1] != distance
            else:
                assert j not in got
    assert found > 40 and missed == 0


def test_query(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame(
        [(1, f"Intro. {item.upper()}! Outro", "x"), (2, f"{item.replace('brown', 'browm')}", "x"), (3, "nothing here", None), (4, None, "x"), (5, "", "x"), (1, f"Intro. {item.upper()}! Outro", "x")],
        "doc_id long, text string, item_id string",
    )
    items = spark.createDataFrame([(7, item), (8, None), (9, "short"), (7, item)], "item_id int, text string")
    rows = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in d.find_items(docs, items).collect())
    assert rows == [(1, 7, 0), (1, 7, 0), (2, 7, 1)]
    assert d.find_items(docs, items.limit(0)).count() == 0
    assert d.find_items(docs.limit(0), items).count() == 0
    assert sorted(r["doc_id"] for r in d.drop_contaminated(docs, items).collect()) == [3, 4, 5]
    blocks = list(d.item_blocks(items, block_chars=10))
    assert len(blocks) == 2  # the item, then the short one


def test_a_tenth_of_the_characters_may_be_edited():
    rng = random.Random(9)
    for length in (40, 60, 80, 100, 120):
        item = "".join(rng.choice("abcdefgh") for _ in range(length))
        text = "".join("z" if i % 10 == 4 else c for i, c in enumerate(item))
        got = d.Matcher([(1, item)]).find("xxxx " + text + " yyyy")
        assert [(h[0], h[1]) for h in got] == [(1, length // 10)]


def test_short_items_match_exactly_on_word_bounds():
    cjk = "\u4eca\u5929\u5929\u6c14\u5f88\u597d"
    matcher = d.Matcher([(1, "two plus two"), (2, cjk), (3, "x"), (4, "")])
    assert sorted(matcher.find("what is two plus two now")) == [(1, 0, 8, 20)]
    assert matcher.find("two plus twofold") == [] and matcher.find("two plus tvo") == []
    assert sorted(matcher.find("x two plus twos two plus two")) == [(1, 0, 16, 28), (3, 0, 0, 1)]
    assert matcher.find("\u4ed6\u8bf4" + cjk + "\u5417") == [(2, 0, 2, 8)]


def test_similarity_where_items_share_an_id(spark):
    a, b = "the quick brown fox jumps over the lazy dog again", "pack my box with five dozen liquor jugs and then some more of them to be sure"
    items = spark.createDataFrame([(1, a), (1, b)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + a.replace("brown", "brawn")), (2, b)], "doc_id long, text string")
    got = {r["doc_id"]: r["similarity"] for r in d.find_items(docs, items).collect()}
    assert got == {1: 1 - 1 / len(a), 2: 1.0}
