import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from countersign.llm import class_lm
from countersign.llm.common import Words, word_hash
from tests.llm.test_common import plain


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(class_lm, "SENT_WORDS", 300)


def brute(rows):
    counts = Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*plain(text), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, text in rows:
        tokens = [*plain(text), None]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        out[i] = (zlib.crc32(str(i).encode()) % 7 == 2, len(tokens), sum(counts[t] > 0 for t in tokens), n, base)
    return out


def test_base_scores(documents, small):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = class_lm.score_documents(documents).collect()
    want = brute(rows)
    held = [0.0, 0.0]
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
        if r.held_out:
            held[0] += r.base_score
            held[1] += r.score
    assert len(got) == len(rows) and held[1] > held[0]


def test_class_model_sums_to_one_and_scores_by_its_parts(spark, documents, small):
    texts = documents.select("doc_id", "text", class_lm.held_out(F.col("doc_id")).alias("held_out"))
    model = class_lm.fit(texts)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    counts = {r.word: (r.n, r.ending) for r in model.vocabulary.collect()}
    mass = np.zeros(class_lm.CLASSES)
    keys = np.array(list(counts), np.int64).view(np.uint64)
    unit = model.head.get(keys, -1)
    unit = np.where(unit >= 0, unit, class_lm.UNITS + np.array([e for _, e in counts.values()]))
    of = model.class_of[unit]
    np.add.at(mass, of, np.array([n + 1 for n, _ in counts.values()]) * 10 ** model.emission[of])
    mass[model.class_of[-1]] += (model.ends + 1) * 10 ** model.emission[model.class_of[-1]]
    assert np.allclose(mass + 10**model.emission, 1)  # with the slot of unknown words
    row = documents.where("n_chars < 300 and n_chars > 100").orderBy("doc_id").first()
    import pyarrow as pa

    words = Words(pa.array([row.text]))
    unit, _ = class_lm._units(words, model.head)
    total, before = 0.0, model.class_of[-1]
    for word, u in zip([*plain(row.text), None], unit, strict=True):
        now = model.class_of[u]
        n = model.ends if word is None else counts.get(int(np.uint64(word_hash(word)).astype(np.int64)), (0, 0))[0]
        total += model.transition[before, now] + model.emission[now] + math.log10(n + 1)
        before = now
    got = class_lm.score(texts.where(F.col("doc_id") == row.doc_id), model).first()
    assert got.score == pytest.approx(total, rel=1e-9)


def test_exchange_finds_classes_and_raises_the_likelihood():
    rng = np.random.default_rng(1)
    true = np.arange(40) % 4
    rates = np.where((true[:, None] + 1) % 4 == true[None, :], 30.0, 0.3)
    of = class_lm.exchange(rng.poisson(rates), 4)
    assert all(len(set(of[true == c])) == 1 for c in range(4)) and len(set(of)) == 4
    assert (class_lm.exchange(rng.poisson(rates), 4) >= 0).all() and class_lm.exchange(np.zeros((3, 3)), 2).shape == (3,)


def test_lookup():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    found = class_lm.Lookup(keys, np.arange(5000)).get(np.append(keys, rng.integers(0, 2**64, 99, dtype=np.uint64)), -1)
    assert (found[:5000] == np.arange(5000)).all() and (found[5000:] == -1).all()
    assert class_lm.Lookup(keys[:0], np.zeros(0)).get(keys[:3], -1).tolist() == [-1] * 3


def test_odd_rows(odd, none):
    rows = class_lm.score_documents(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count() and by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 1
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert class_lm.score_documents(none).count() == 0


@pytest.mark.parametrize("common", [300, 5000])
def test_every_word_has_the_class_of_its_own_neighbours(documents, monkeypatch, common):
    """Classes, class bigrams and scores against plain loops, for words that are sent and for those that are joined."""
    monkeypatch.setattr(class_lm, "SENT_WORDS", common)
    texts = documents.where("n_chars < 2000").select("doc_id", "text", class_lm.held_out(F.col("doc_id")).alias("held_out"))
    model, k = class_lm.fit(texts), class_lm.CLASSES
    docs = [(r.doc_id, r.held_out, [word_hash(w) for w in plain(r.text)]) for r in texts.collect()]
    got = {r.word % 2**64: r["class"] for r in model.vocabulary.collect()}
    ending = {r.word % 2**64: r.ending for r in model.vocabulary.collect()}
    train = [t for _, held, t in docs if not held]
    counts = Counter(w for t in train for w in t)
    assert set(got) == set(counts) and len(counts) > 5000
    head = sorted(counts, key=lambda w: (-counts[w], w - 2**64 * (w >= 2**63)))[: min(class_lm.UNITS, common)]
    first = class_lm.exchange(class_lm.bigram_counts(texts, class_lm.Lookup(np.array(head, np.uint64), np.arange(len(head)))))
    unit = {w: first[class_lm.UNITS + ending[w]] for w in counts} | {w: first[i] for i, w in enumerate(head)} | {None: first[-1]}
    pairs, around = np.zeros((k, k)), {w: (np.zeros(k), np.zeros(k)) for w in counts}
    for t in train:
        for old, now in zip([None, *t], [*t, None], strict=True):
            pairs[unit[old], unit[now]] += 1
            if now is not None:
                around[now][0][unit[old]] += 1
            if old is not None:
                around[old][1][unit[now]] += 1
    after = np.log((pairs + class_lm.ALPHA) / (pairs.sum(axis=1, keepdims=True) + class_lm.ALPHA * k))
    with np.errstate(divide="ignore"):
        size = np.where(pairs.sum(axis=0) > 0, np.log(pairs.sum(axis=0)), np.inf)
    for i, w in enumerate(head):
        assert got[w] == first[i]
    for w in set(counts) - set(head):
        gain = around[w][0] @ after + after @ around[w][1] - counts[w] * size
        assert gain[got[w]] == pytest.approx(gain.max(), abs=2e-6)
    assert len({got[w] for w in counts if ending[w] == ending[head[0]]}) > 3

    of, final, held = got | {None: first[-1]}, np.zeros((k, k)), 0
    for t in train:
        np.add.at(final, ([of[w] for w in [None, *t]], [of[w] for w in [*t, None]]), 1)
    assert np.allclose(10**model.transition, (final + class_lm.ALPHA) / (final.sum(axis=1, keepdims=True) + class_lm.ALPHA * k))
    scores = {r.doc_id: r for r in class_lm.score(texts, model).collect()}
    for i, _, t in docs:
        t = [(of.get(w), counts[w]) for w in t]
        if any(c is None for c, _ in t):
            held += 1
            continue
        classes, n = [first[-1], *(c for c, _ in t), first[-1]], [c for _, c in t] + [len(train)]
        want = sum(model.transition[a, b] + model.emission[b] + math.log10(c + 1) for a, b, c in zip(classes, classes[1:], n, strict=False))
        assert scores[i].score == pytest.approx(want, rel=1e-9) and scores[i].n_known == len(n)
    assert held < len(docs) / 2
