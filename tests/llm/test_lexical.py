"""Ranked search against plain loops over all pairs, with small trees and blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from countersign.llm import lexical as lx

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))


def brute(documents, items, k):
    cut = [(i, Counter(terms(t))) for i, t in documents if terms(t)]
    count, length = len(cut), sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in cut:
            m = 25 + (75 * sum(c.values()) * count) // length
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        best = sorted(scored)[:k]
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(best)]
    return sorted(out, key=repr)


def run(spark, documents, items, k, parts=3):
    clashing = {c: F.lit("x") for c in ("n", "terms", "tf", "row", "first", "item", "score", "rank", "block")}
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(parts).withColumns(clashing)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns(clashing)
    return sorted(map(tuple, lx.search(docs, asked, k).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(rng, docs, words=60):
    names = [f"w{i}" if i % 5 else f"Ä{i}É" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    make = lambda n: " ".join(rng.choices(names, weights, k=n))
    return [(i, make(rng.randrange(1, 40))) for i in range(docs)], [(i, make(rng.randrange(1, 12))) for i in range(25)]


ODD = [
    (None, "w1 w2 w3 W4"),
    (None, "w1 w2 w3 W4"),
    (7000, None),
    (7001, ""),
    (7002, " \t.,!?\x00[]`{}~ "),
    (7003, "w1-w2_w3\x7fw4 " * 4000),
    (2**60 + 1, "w1 w2 w3 w4"),
    (3, "w1 w2 w3 w4"),
    (3, "w1 w2 w3 w4"),
]


@pytest.fixture
def small(monkeypatch):
    """Trees of several levels, chunks and blocks on few rows; workers get the values by fork only
    through what is sent, so the tree itself is tried without Spark below."""
    for name, value in {"LEAF": 2, "FAN": 2, "CHUNK_DOCS": 8, "CHUNK_ENTRIES": 60}.items():
        monkeypatch.setattr(lx, name, value)


def test_equals_brute_force(spark):
    documents, items = corpus(random.Random(1), 400)
    documents += ODD
    items += [(1, "w1 w1 w1 W2"), (1, "w1 w1 w1 W2"), (None, "w3 w59 unknown"), (90, None), (91, "?"), (92, "unknown")]
    assert run(spark, documents, items, 10) == brute(documents, items, 10)
    assert run(spark, documents[:4], items, 10) == brute(documents[:4], items, 10)


def test_blocks_of_items_and_vectors_with_all_terms(spark, monkeypatch):
    monkeypatch.setattr(lx, "BLOCK_TERMS", 40)
    monkeypatch.setattr(lx, "SENT_TERMS", 3)
    documents, items = corpus(random.Random(2), 150)
    assert run(spark, documents, items, 3) == brute(documents, items, 3)


def test_empty_tables(spark):
    documents, items = corpus(random.Random(3), 20)
    assert run(spark, [], items, 5) == run(spark, documents, [], 5) == run(spark, [(1, "")], items, 5) == []


@pytest.mark.parametrize("exact", ["float64", "int64"])
def test_small_trees_prune_and_stay_exact(small, exact):
    rng = np.random.default_rng(5)
    words, docs, asked, k = 40, 300, 30, 4
    impacts = np.where(rng.random((docs, words)) < 0.1, rng.integers(1, 50, (docs, words)), 0)
    impacts[docs // 2 :] = impacts[: docs // 2]  # ties
    impacts[::7, 3] = 10**6  # a few documents far above the others
    weights = np.where(rng.random((asked, words)) < 0.15, rng.integers(1, 9, (asked, words)), 0)
    weights[:, 3] = weights.any(axis=1)
    item, at = np.nonzero(weights)
    items = lx.Items(list(range(asked)), np.arange(words), at, item, weights[item, at], exact, docs, 1)
    search = lx.Search(items, k, np.ones(asked, np.int64))
    for low in range(0, docs, 23):
        rows = [d for d in range(low, min(low + 23, docs)) if impacts[d].any()]
        doc, at = np.nonzero(impacts[rows])
        search.add(lx.Chunk(np.array(rows), doc, at, impacts[rows][doc, at], items))
    scores = impacts @ weights.T
    for i in range(asked):
        want = sorted((-scores[d, i], d) for d in range(docs) if scores[d, i] > 0)[:k]
        assert [(-s, d) for s, d in zip(search.scores[i].astype(int), search.docs[i].astype(int), strict=True)] == want
    assert 0 < search.scored < search.pairs / 2
