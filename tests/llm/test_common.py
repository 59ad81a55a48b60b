import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from countersign.llm import common

TEXTS = ["The cat  sat", "", None, " \t\n", "one", "Straße Été 😀 a b", "x\x0by\x0cz\rq", "THE cat sat", "a" * 5000]


def plain(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_words_are_those_of_a_plain_split():
    words = common.Words(pa.array(TEXTS, pa.string()))
    seen = {}
    for d, text in enumerate(TEXTS):
        a, b = words.first[d], words.first[d + 1]
        expected = plain(text)
        assert b - a == len(expected)
        for h, word in zip(words.hash[a:b].tolist(), expected, strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_hash_does_not_depend_on_the_place():
    assert common.word_hash("Cat") == common.Words(pa.array(["zz yy", "a bb cat"])).hash[-1]


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(TEXTS, pa.string()), "i": list(range(len(TEXTS)))})
    rows = [i for piece in common.slices(batch, "text", 8) for i in piece.column("i").to_pylist()]
    assert rows == list(range(len(TEXTS)))


@pytest.mark.parametrize("size", [1, 3, 5])
def test_shingles_are_distinct_runs(size):
    sets = list(common.Words(pa.array(TEXTS, pa.string())).shingles(size))
    for text, got in zip(TEXTS, sets, strict=True):
        w = plain(text)
        want = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        assert len(got) == len(want) and (np.diff(got.astype(float)) > 0).all()
    assert (sets[0] == sets[7]).all()


def test_word_count(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = [r.n for r in frame.select(common.word_count(F.col("text")).alias("n")).collect()]
    assert got == [len(plain(t)) for t in TEXTS]


def test_prefix_sums(spark):
    rows = [(i * 7919 % 101, i % 5) for i in range(101)] + [(None, 3)]
    frame = spark.createDataFrame(rows, "k long, v long")
    got = {r.k: r.s for r in common.prefix_sums(frame, [F.col("k").asc_nulls_last()], F.col("v"), "s").collect()}
    total = 0
    for k, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        assert got[k] == total
        total += v


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)]
    edges += [(5000, i) for i in range(5001, 5200)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_bitmap(spark):
    keys = [0, 5, -1, 2**62 + 12345, -(2**63)]
    bits = common.bitmap(spark.createDataFrame([(k,) for k in keys], "key long"), 16)
    held = np.frombuffer(bits, np.uint8)
    assert common.in_bitmap(np.array(keys, np.int64), held, 16).all()
    assert not common.in_bitmap(np.array([6, 77], np.int64), held, 16).any()


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
