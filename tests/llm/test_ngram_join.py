import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from countersign.llm import ngram_join
from countersign.llm.ngram_join import Rule
from tests.llm.test_common import plain


def brute(rows, rule):
    """Components by counting the overlaps of all pairs through plain posting lists."""
    sets, posts, common = {}, defaultdict(list), Counter()
    for i, text in rows:
        w = plain(text)
        grams = [tuple(w[j : j + rule.size]) for j in range(len(w) - rule.size + 1)]
        sets[i] = frozenset(grams if len(w) >= rule.size else [tuple(w)] if w else [])
        for g in sets[i]:
            posts[g].append(i)
    for ids in posts.values():
        common.update(itertools.combinations(ids, 2))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if rule.den * n >= rule.num * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(seed=1):
    """A large group of edited copies around the threshold, a shared passage, and copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    base, passage = [word() for _ in range(120)], [word() for _ in range(55)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows += [" ".join([word() for _ in range(rng.randrange(5, 40))] + passage) for _ in range(60)]
    rows += [" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    rows += rows[:30] + ["", None, " ", "a b", "a b", "a"]
    return list(enumerate(rows))


@pytest.mark.parametrize("paired,block", [(16, 256), (2, 7)])
def test_large_groups_in_small_blocks(spark, monkeypatch, paired, block):
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rows, rule = near_copies(), Rule(3, 90, 100)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(frame, rule).collect()}
    assert got == brute(rows, rule)


def test_given_documents(documents):
    rows, rule = [tuple(r) for r in documents.select("doc_id", "text").collect()], Rule()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(documents, rule).collect()}
    assert got == brute(rows, rule)


def test_odd_rows(odd, none):
    got = sorted(tuple(r) for r in ngram_join.similar(odd).where("doc_id is not null").collect())
    by = {i: (n, c) for i, n, c in got}
    assert len(got) == 9 and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (0, 4) and by[5] == by[6] and by[7] == (1, 7)
    assert ngram_join.similar(none).count() == 0


def test_linked_sets_agree_on_enough_segments():
    """The promise of the fragments, on random pairs at the threshold."""
    rng = np.random.default_rng(3)
    for rule in (Rule(3, 90, 100), Rule(5, 80, 100)):
        for n in (5, 9, 10, 30, 200, 3000):
            for _ in range(12):
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                swap = rng.integers(0, n * (rule.den - rule.num) // (rule.den + rule.num) + 1)
                b = np.unique(np.concatenate([a[swap:], rng.integers(0, 2**64, swap, dtype=np.uint64)]))
                inter = len(np.intersect1d(a, b))
                if rule.den * inter < rule.num * (len(a) + len(b) - inter) or (a == b[: len(a)]).all():
                    continue
                keys = defaultdict(lambda: [set(), set()])
                for found in ngram_join._segment_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), rule):
                    for key, doc, level in zip(found["key"], found["doc"], found["level"], strict=True):
                        keys[level][doc].add(key)
                assert any(x & y for x, y in keys.values())


def test_keys_that_one_set_alone_has_are_left_out_whatever_their_number(monkeypatch):
    """Copies of a set are one set, tasks hand on bounded arrays, and no table of fixed size fills up."""
    monkeypatch.setattr(ngram_join, "HELD_POSTINGS", 500)
    rng, rule = random.Random(4), Rule()
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    texts = [text(rng.randrange(20, 120)) for _ in range(60)]
    near = [t + " " + text(1) for t in texts[:10]]
    given = [texts + near, texts[5:] + [None, "", "a b"] + texts[:30]]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(x, pa.string())}) for x in given]
    tasks = [[batch.slice(0, 30), batch.slice(30)] for batch in batches]
    posted = [row for task in tasks for b in ngram_join._posted(iter(task), rule, 7) for row in b.to_pylist()]
    assert {r["bucket"] for r in posted} == set(range(7)) and len(posted) > 2 * 7 * 3
    posted.sort(key=lambda r: r["bucket"])
    found = ngram_join._repeated(iter([pa.RecordBatch.from_pylist(posted, ngram_join._POSTED)]), rule)
    rows = [row for b in found for row in b.to_pylist()]

    want = defaultdict(set)
    for batch in batches:
        flat, sizes, sets = ngram_join._sets(batch, rule)
        for keys in ngram_join._segment_keys(flat, sizes, rule):
            for key, doc, own in zip(keys["key"], keys["doc"], keys["own"], strict=True):
                want[int(key)].add((int(sets[doc]), bool(own)))
    got = defaultdict(set)
    for r in rows:
        if r["key"] is not None:
            got[r["key"]].add((r["set_key"], r["own"]))
    shared = [x for x in want.values() if len({s for s, _ in x}) > 1]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, shared)) and len(shared) > 20
    told = [(r["set_key"], r["own"]) for r in rows if r["key"] is None]
    assert len(told) == len(set(told)) == len({x for sets in want.values() for x in sets})
    # What travels is a few bytes a key, and the copies of one task are handed on once.
    bytes_ = sum(len(r["keys"]) + len(r["sets"]) for r in posted if r["kind"] != ngram_join._SIZES)
    assert bytes_ <= 13 * 2 * sum(len(x) for x in want.values())


def test_exact_copies_share_no_key_with_another_set(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(40)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string").repartition(4)
    assert ngram_join._members(frame.select("doc_id", "text"), Rule(), 40 * 76).count() == 0
