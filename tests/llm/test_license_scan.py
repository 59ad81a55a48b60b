"""License notices: planted quotations, the SQL twin on odd rows, merging and suppression."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from countersign.llm import license_scan as ls

BODY = dict(enumerate(ls.TEMPLATES))
NOTICE = {label: text for label, text in reversed(ls.TEMPLATES)}
FILLER = "the quick brown fox jumps over a lazy dog near an old river bank "


def scanned(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in ls.scan(rows).collect()}


def test_every_template_is_found_inside_other_words(spark):
    found = scanned(spark, [FILLER + text.upper() + " " + FILLER for _, text in ls.TEMPLATES])
    for i, (label, text) in BODY.items():
        assert label in found[i].labels.split(","), text
        best = max(found[i].spans, key=lambda s: s.share)
        assert best.share == 1.0 and best.begin <= 14


def test_changed_words_keep_the_label_and_other_licenses_do_not_take_it(spark):
    mit = NOTICE["mit"].split()
    mit[20] = "anything"
    longer = [*mit[:40], "indeed", "so", *mit[40:]]
    part = mit[: len(mit) // 3]
    found = scanned(spark, [" ".join(mit), " ".join(longer), " ".join(part), NOTICE["lgpl"], FILLER])
    assert found[0].labels == "mit" and 0.9 < found[0].score < 1
    assert found[1].labels == "mit" and len(found[1].spans) == 1
    assert found[2].labels == "" and found[2].score == 0
    assert found[3].labels == "lgpl" and found[3].n_base == 0
    assert found[4].labels == "" and found[4].score == 0 and found[4].n_words == 14


def test_phrases_are_found_word_by_word(spark):
    texts = ["MIT License; mit-license, mit licenses", "cc by", "É gnu General\nPublic License apache  license"]
    found = scanned(spark, texts)
    assert (found[0].n_base, found[0].first_word, found[0].last_word, found[0].base_labels) == (2, 0, 2, "mit")
    assert (found[1].n_base, found[1].score, found[1].labels) == (1, 1.0, "cc-by")
    assert (found[2].n_base, found[2].first_word, found[2].last_word) == (2, 1, 5)
    assert found[2].base_labels == "apache,gpl"


def test_equals_the_sql_on_odd_rows(spark):
    texts = [
        None, "", "   ", "mit", "mit license", "MIT LICENSE\x00mit license", "é" * 5, FILLER * 300,
        NOTICE["mit"] * 3, NOTICE["gpl"] + NOTICE["apache"], "K license apache license",
        "license " * 500, "of this license " * 200 + NOTICE["bsd"], NOTICE["isc"][: len(NOTICE["isc"]) * 4 // 5],
    ]
    rows = [(i % 9 if i % 5 else None, t) for i, t in enumerate([*texts, *texts])]
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    clashing = {c: F.lit("x") for c in ("row", "w", "b", "g", "pos", "gram", "template", "label", "spans", "labels")}
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clashing)
    ours = sorted(map(repr, map(tuple, ls.scan(frame).select(*names).collect())))
    con = duckdb.connect()
    con.register("documents", documents)
    theirs = sorted(map(repr, con.sql(f"SELECT {', '.join(names)} FROM ({ls.oracle_sql()})").fetchall()))
    assert ours == theirs


def test_empty_table_and_join_by_shuffle(spark):
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(1, NOTICE["mit"]), (2, FILLER)], "doc_id long, text string")
    base, found = ls.located(rows, ls.template_grams(spark), broadcast=False)
    assert base.count() == 2 and [r.label for r in found.collect()] == ["mit"]


def test_no_python_worker_in_the_plan(spark):
    rows = spark.createDataFrame([(1, FILLER)], "doc_id long, text string").coalesce(1)
    plan = ls.scan(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text", ["", "one two", "a b c d"])
def test_short_templates_do_no_harm(spark, text):
    rows = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    out = ls.scan(rows, [("x", text)], ()).first()
    assert out.labels == ("x" if text == "a b c d" else "") and out.n_base == 0
