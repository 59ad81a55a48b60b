import random

import pytest

from countersign.llm import decontaminate as d


def distance(item, text):
    """Least edit distance of the item to a substring, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row = row, [i]
        for j, x in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != x)))
    return min(row)


def edited(text, edits, rng):
    w = list(text)
    for _ in range(edits):
        i = rng.randrange(len(w))
        kind = rng.randrange(3)
        w[i : i + (kind != 1)] = [] if kind == 2 else [rng.choice("xyz")]
    return "".join(w)


def test_myers_equals_the_table():
    rng = random.Random(2)
    for _ in range(150):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 80)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 150)))
        least, end = d.Pattern(item).best(text)
        assert least == distance(item, text)
        assert least == len(item) or distance(item, text[:end]) == least


def test_matches_are_those_of_brute_force(spark):
    rng = random.Random(6)
    letters = "abcdefghij klmnop"
    items = ["".join(rng.choice(letters) for _ in range(rng.randrange(50, 120))).strip() for _ in range(12)]
    items = [(i, " ".join(t.split())) for i, t in enumerate(items)]
    texts = []
    for i in range(70):
        item = items[i % 12][1]
        around = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 90))) for _ in range(2)]
        texts.append((i, around[0] + " " + edited(item, rng.randrange(0, 16), rng) + "\n" + around[1]))
    want = set()
    for i, text in texts:
        for n, item in items:
            least = distance(item, d.normal(text))
            if least <= d.budget(len(item)):
                want.add((i, n, least))
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = d.contaminated(documents, table, block_chars=200).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and 20 < len(got) < 70
    text_of = dict(texts)
    for r in got:
        assert distance(dict(items)[r.item_id], d.normal(text_of[r.doc_id][r.start : r.end])) == r.distance
    kept = {r.doc_id for r in d.clean(documents, table, block_chars=200).collect()}
    assert kept == {i for i, _ in texts} - {r.doc_id for r in got}


def test_short_items_match_word_for_word(spark):
    items = [(1, "What is the capital of Peru?"), (2, "  boiling\tpoint" + " " * 40), (3, "   "), (4, ""), (5, None), (6, "北京在哪里"), (7, "art")]
    texts = [
        (1, "Q: what is the  CAPITAL of\nPeru? A: Lima"), (2, "the boiling point of tin"), (3, "the boiling points"), (4, "what is the capitol of peru?"),
        (5, "请问北京在哪里呢"), (6, "start, party, smart_art"), (7, "smart art"), (8, None), (9, ""), (10, "x" * 60),
    ]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance): dict(texts)[r.doc_id][r.start : r.end] for r in d.contaminated(documents, table).collect()}
    assert got == {
        (1, 1, 0): "what is the  CAPITAL of\nPeru?", (2, 2, 0): "boiling point", (5, 6, 0): "北京在哪里", (7, 7, 0): "art"
    }
    assert sorted(r.doc_id for r in d.clean(documents, table).collect()) == [3, 4, 6, 8, 9, 10]


@pytest.mark.parametrize("text", ["", "  A\t\n b", "İstanbul  ÉTÉ", "x" * 9 + "  "])
def test_places_lead_back(text):
    normal, at = d.normal(text), d.places(text)
    assert len(at) == len(normal) + 1
    assert all(d.normal(text[at[i] : at[i + 1]])[:1] == normal[i] for i in range(len(normal)))


def test_odd_rows(spark, odd, none):
    items = [(1, "the cat sat on the mat and then it ran away"), (2, None), (None, "x" * 50), (3, "short"), (4, "")]
    table = spark.createDataFrame([(*r, "e") for r in items], "item_id long, text string, distance string")
    assert sorted(r.doc_id for r in d.contaminated(odd, table).collect()) == [1, 1]
    assert d.clean(odd, table).count() == odd.count() - 2 and d.clean(odd, table).columns == odd.columns
    assert d.contaminated(none, table).count() == d.contaminated(odd, table.where("false")).count() == 0
    assert d.clean(odd, table.where("false")).count() == odd.count()
