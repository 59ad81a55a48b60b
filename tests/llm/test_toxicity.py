import numpy as np
from pyspark.sql import functions as F

from countersign.llm import toxicity as t
from tests.llm.conftest import ROOT


def test_held_out_rows(spark):
    documents = spark.read.parquet(f"{ROOT}/sf0.1/documents.parquet").where("doc_id < 5000")
    labels = spark.read.parquet(f"{ROOT}/sf0.1/labels.parquet")
    model = t.fit(documents, labels.where("doc_id % 5 <> 0"))
    truth = labels.where("doc_id % 5 = 0").withColumnRenamed("toxic", "truth")
    rows = t.rate(documents, model).join(truth, "doc_id").collect()
    bad, clean = [r for r in rows if r.truth], [r for r in rows if not r.truth]
    assert sum(r.toxic for r in bad) >= 0.85 * len(bad) and sum(r.toxic for r in clean) <= 0.05 * len(clean)
    assert np.mean([r.severity for r in bad]) > 5 * np.mean([r.severity for r in clean])
    assert {"stupid", "worthless"} <= set(model.weights) and (np.diff(model.thresholds) > 0).all()


def test_grades_are_recovered():
    """Rows made by a known ordinal model; weights shared by the thresholds come out in order."""
    rng = np.random.default_rng(4)
    true = np.array([3.0, 2.0, 1.0, 0.0, -1.0])
    rows = [np.flatnonzero(rng.random(5) < 0.4) for _ in range(4000)]
    score = np.array([true[r].sum() for r in rows]) + rng.logistic(size=4000)
    grades = np.searchsorted([1.0, 3.0, 5.0], score)
    w, cuts = t.fit_ordinal(rows, grades, 5, np.ones(4000))
    assert np.abs(w - true).max() < 0.4 and np.abs(cuts - [1, 3, 5]).max() < 0.4
    model = t.Ordinal({}, cuts, 0.5)
    parts = model.grades(np.array([-3.0, 0.0, 9.0]))
    assert np.allclose(parts.sum(axis=1), 1) and (np.diff(model.severity(np.array([-3.0, 0.0, 9.0]))) > 0).all()


def test_beginnings():
    assert t.words_of("Loser! losers") == {"loser", "losers", "los-", "lose-", "loser-"} and t.words_of(None) == set()


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None), (99, 1)], "doc_id long, toxic int")
    for table in (labels, labels.where("false"), labels.where("toxic = 1")):
        rows = t.rate(odd, t.fit(odd, table)).collect()
        assert len(rows) == odd.count() and all(r.severity >= 0 for r in rows)
    assert t.rate(none, t.fit(none, labels)).count() == 0
    model = t.Ordinal({"cat": 9.0}, np.array([1.0, 2.0, 3.0]), 1.5)
    flagged = {r.doc_id for r in t.rate(odd, model).where(F.col("toxic")).collect()}
    assert flagged == {1}
