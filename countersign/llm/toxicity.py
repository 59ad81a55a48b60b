"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

    P(grade <= j | text) = sigmoid(threshold_j - score),  score = sum of weights of words present

Features are words and beginnings of words. One weight per feature is shared by all thresholds, which stay ordered; the result is the expected
grade, from 0 (clean) to ``GRADES - 1``.

Labels say toxic or not. The grades of toxic rows are made from how many of their words are
*marked*: words that toxic rows hold far more often than others. Rows with few of them are of
grade 1, the upper parts of the rest of grades 2 and 3. Words are features if they are common
enough in the sample and tell the label apart best, far above chance; of texts that look alike
(same least hash of 3-word shingles) one row counts, so that the words of a text with many copies
are not taken for marks. The sample is bounded: ``SAMPLE_ROWS``
labelled rows with the least hash of their id, half of them from each label where there are so
many; whole texts are read, in the tasks.

Edge cases: a NULL or empty text has no features and the grade of a text without any; labels of
NULL, or without a document, are left out; rows of one id that occur repeatedly are labelled and
scored alike; with no labels, or labels of one kind only, every severity is 0; other columns pass
through, columns of the result's names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, slices

GRADES = 4
SAMPLE_ROWS = 20_000
FEATURES = 2000
#: A feature stands in so many rows of the sample, and tells the label so far above chance (chi squared).
LEAST_ROWS, LEAST_CHI = 5, 20.0
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
#: How much more than any one longer feature a beginning must tell.
STEM_GAIN = 1.3
PENALTY = 0.01
ROUNDS = 300


#: Lengths of word beginnings that are features besides whole words, so that inflected forms count.
BEGINNINGS = (3, 4, 5, 6, 7)


def words_of(text: str | None) -> set[str]:
    """Distinct words of letters in lower case, and beginnings of longer ones, marked by a dash."""
    if not text:
        return set()
    words = set(_WORD.findall(text.lower()))
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in BEGINNINGS))


class Ordinal(NamedTuple):
    """Weights by word and ordered thresholds; ``cut`` is the least severity called toxic."""

    weights: dict[str, float]
    thresholds: np.ndarray
    cut: float

    def score(self, text: str | None) -> float:
        held = words_of(text)
        if len(held) > len(self.weights):
            return sum(w for word, w in self.weights.items() if word in held)
        return sum(self.weights.get(word, 0.0) for word in sorted(held))

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each grade."""
        below = 1 / (1 + np.exp(-(self.thresholds[None, :] - scores[:, None])))
        return np.diff(np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], axis=1), axis=1)

    def severity(self, scores: np.ndarray) -> np.ndarray:
        """Expected grade."""
        return self.grades(scores) @ np.arange(len(self.thresholds) + 1)


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, features: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalized likelihood, by accelerated gradient steps.

    ``rows`` has the feature numbers of each row. Thresholds are a first value and positive gaps, so they
    stay in order.
    """
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    tops = GRADES - 1
    w, start, gap = np.zeros(features), 1.0, np.zeros(tops - 1)
    moment = [np.zeros(features + tops), np.zeros(features + tops)]
    total = weight.sum()
    for step in range(1, ROUNDS + 1):
        cuts = start + np.concatenate([[0], np.cumsum(np.exp(gap))])
        score = np.bincount(of, w[flat], len(rows))
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper = 1 / (1 + np.exp(-np.clip(edge[grades + 1] - score, -40, 40)))
        lower = 1 / (1 + np.exp(-np.clip(edge[grades] - score, -40, 40)))
        upper, lower = np.where(grades == tops, 1.0, upper), np.where(grades == 0, 0.0, lower)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_score = weight * (du - dl) / total  # derivative of -log p by the score
        by_cut = np.zeros(tops)
        np.add.at(by_cut, np.minimum(grades, tops - 1), np.where(grades < tops, -weight * du / total, 0))
        np.add.at(by_cut, np.maximum(grades - 1, 0), np.where(grades > 0, weight * dl / total, 0))
        g_w = np.bincount(flat, by_score[of], features) + PENALTY * w / len(rows) ** 0.5
        g_gap = np.array([by_cut[j + 1 :].sum() * np.exp(gap[j]) for j in range(tops - 1)])
        g = np.concatenate([g_w, [by_cut.sum()], g_gap])
        moment[0] = 0.9 * moment[0] + 0.1 * g
        moment[1] = 0.999 * moment[1] + 0.001 * g * g
        move = 0.1 * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.999**step)) + 1e-8)
        w -= move[:features]
        start -= move[features]
        gap -= move[features + 1 :]
    return w, start + np.concatenate([[0], np.cumsum(np.exp(gap))])


def _sample(documents: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """A bounded number of labelled rows (doc_id, text, toxic), toxic ones first up to half."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.where(F.col("toxic") == t).orderBy(*order).limit(sample_rows // 2) for t in (1, 0)]
    chosen = parts[0].union(parts[1])
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


    def looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                least = [int(s[0]) >> 1 if len(s) else 0 for s in Words(piece.column("text")).shingles(3)]
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in ("doc_id", "text", "toxic")), pa.array(least, pa.int64())],
                    ["doc_id", "text", "toxic", "look"],
                )

    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")  # at most sample_rows ids
    rows = rows.mapInArrow(looks, "doc_id long, text string, toxic int, look long")
    first = rows.groupBy("look", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    return first.select("r.doc_id", "r.text", "toxic")


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Ordinal:
    nothing = Ordinal({}, np.arange(1, GRADES) * 10.0, np.inf)
    sample = _sample(documents, labels, sample_rows)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                for word in words_of(text.as_py()):
                    counts.setdefault(word, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array(counts, pa.string()), "clean": pa.array([c[0] for c in counts.values()], pa.int64()),
             "bad": pa.array([c[1] for c in counts.values()], pa.int64())}
        )

    by_label = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not (by_label.get(0) and by_label.get(1)):
        return nothing
    clean_rows, bad_rows = by_label[0], by_label[1]
    found = (
        sample.select("text", "toxic")
        .mapInArrow(presence, "word string, clean long, bad long")
        .groupBy("word")
        .agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
        .where(F.col("clean") + F.col("bad") >= LEAST_ROWS)
    )
    a, b = F.col("bad") + 0.5, F.col("clean") + 0.5
    share = (F.col("bad") + F.col("clean")) / float(clean_rows + bad_rows)
    gap = F.col("bad") / float(bad_rows) - F.col("clean") / float(clean_rows)
    chi = gap * gap / (share * (1.0001 - share) * (1 / clean_rows + 1 / bad_rows))
    odds = F.log(a / (bad_rows + 1.0)) - F.log(b / (clean_rows + 1.0))
    found = found.select("word", odds.alias("odds"), chi.alias("chi")).where(F.col("chi") >= LEAST_CHI)
    best = _apart(found.orderBy(F.desc("chi"), "word").limit(4 * features).collect())[:features]
    if not best:
        return nothing
    place = {r.word: i for i, r in enumerate(best)}
    marked = np.array([r.odds > 1.5 for r in best], bool)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(place[w] for w in words_of(t.as_py()) if w in place) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column("toxic")], ["held", "toxic"])

    # At most sample_rows rows of at most `features` numbers each.
    frame = sample.select("text", "toxic").mapInArrow(sparse, "held array<int>, toxic int").toArrow().to_pandas()
    rows = [np.asarray(r, np.int64) for r in frame["held"]]
    toxic = frame["toxic"].to_numpy()
    order = sorted(range(len(rows)), key=lambda i: (toxic[i], rows[i].tolist()))  # rows arrive in any order
    rows, toxic = [rows[i] for i in order], toxic[order]
    hits = np.array([marked[r].sum() for r in rows])
    grades = np.zeros(len(rows), np.int64)
    bad = toxic == 1
    levels = np.quantile(hits[bad], [1 / 3, 2 / 3])
    grades[bad] = 1 + (hits[bad] > levels[0]) + (hits[bad] > levels[1])
    weight = np.where(bad, 0.5 / bad.mean(), 0.5 / (1 - bad.mean()))
    w, cuts = fit_ordinal(rows, grades, len(best), weight)
    model = Ordinal({word: float(w[i]) for word, i in place.items() if abs(w[i]) > 1e-4}, cuts, 0.5)
    severity = model.severity(np.array([w[r].sum() for r in rows]))
    return model._replace(cut=_best_cut(severity, bad))


def _apart(best: list) -> list:
    """Features by falling chi squared, one for each stem.

    A beginning stays if it tells clearly more than every longer feature that begins so;
    what begins with a feature that stays is left out.
    """
    longest: dict[str, float] = {}
    for row in best:
        word = row.word.rstrip("-")
        for n in BEGINNINGS:
            if n < len(word) or (n == len(word) and row.word == word):
                key = word[:n] + "-"
                longest[key] = max(longest.get(key, 0.0), row.chi)
    best = [r for r in best if not r.word.endswith("-") or r.chi > STEM_GAIN * longest.get(r.word, 0.0)]
    held = {r.word for r in best if r.word.endswith("-")}

    def begins(row) -> bool:
        word = row.word.rstrip("-")
        return any(word[:n] + "-" in held and word[:n] + "-" != row.word for n in BEGINNINGS if n <= len(word))

    return [r for r in best if not begins(r)]


def _best_cut(severity: np.ndarray, bad: np.ndarray) -> float:
    """The severity from which a row is called toxic: the one with the most right decisions."""
    order = np.argsort(-severity, kind="stable")
    s, y = severity[order], bad[order]
    right = np.cumsum(y) - np.cumsum(~y)
    last = np.append(s[1:] != s[:-1], True)
    at = int(np.argmax(np.where(last, right, -len(s))))
    return float((s[at] + s[at + 1]) / 2 if at + 1 < len(s) else s[at])


def rate(documents: DataFrame, model: Ordinal, text: Column | None = None) -> DataFrame:
    """``documents`` with ``severity`` (expected grade), ``grade`` (likeliest) and ``toxic``."""
    text = F.col("text") if text is None else text
    made = ("severity", "grade", "toxic")

    @F.pandas_udf("struct<severity:double,grade:int>")
    def rated(texts: pd.Series) -> pd.DataFrame:
        scores = np.array([model.score(t) for t in texts], float)
        grade = model.grades(scores).argmax(axis=1) if len(scores) else np.zeros(0)
        severity = model.severity(scores) if model.weights else np.zeros(len(scores))
        return pd.DataFrame({"severity": severity, "grade": grade.astype("int32")})

    carried = [c for c in documents.columns if c not in made]
    out = documents.select(*carried, rated(text.cast("string")).alias("_r"))
    return out.select(
        *carried, F.col("_r.severity").alias("severity"), F.col("_r.grade").alias("grade"),
        (F.col("_r.severity") >= F.lit(float(model.cut))).alias("toxic"),
    )
