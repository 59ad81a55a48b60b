import re
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from countersign.llm import decontaminate, secrets
from countersign.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import SMALL
from tests.llm.test_ngram_join import Rule, brute


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twins(spark, name):
    base = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        base.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = base.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_one_query_per_operator():
    numbers = [int(m[1]) for m in (re.match(r"op(\d+)_", name) for name in QUERIES) if m]
    assert sorted(numbers) == list(range(1, 14))


def test_pipeline_stages(spark, documents, tmp_path):
    before, rows = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SMALL).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows[name] = before, after
        if name != "mix":
            assert after.columns == documents.columns
        before = after
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    given, kept = map(texts, rows["near_duplicates"])
    want = brute(list(given.items()), Rule(5, 80, 100))
    assert set(kept) == {i for i, (_, c) in want.items() if c == i}

    given, kept = map(texts, rows["benchmark"])
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    matcher = decontaminate.Matcher(items)
    assert set(kept) == {i for i, t in given.items() if not matcher.matches(t)} and len(kept) < len(given)

    given, kept = map(texts, rows["secrets"])
    assert set(kept) == set(given)
    for i, text in given.items():
        assert kept[i] == secrets.redacted(text, secrets.secret_spans(text))
    assert {r.doc_id for r in rows["mix"][1].collect()} == set(kept)


def test_pipeline_takes_odd_rows(spark, odd, none, tmp_path):
    for n, table in enumerate((odd, none)):
        docs = table.selectExpr("doc_id", "text", "lang", "source", "length(text) AS n_chars")
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SMALL).write.parquet(str(tmp_path / f"{n}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}{name}"))
        assert (docs.count() > 0) == (n == 0)


def test_texts_that_share_an_id_are_kept_apart(spark):
    text = lambda x, n=60: " ".join(f"{x}{i}" for i in range(n))
    rows = [
        (1, text("w")), (1, text("z")), (2, text("w") + " more"), (2, text("v")), (3, text("z").upper()),
        (1, text("w").upper()), (4, ""), (4, text("u")), (None, text("w")), (5, None), (5, None), (6, text("t")), (6, text("t")),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rows string").repartition(4)
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns
    got = sorted(map(tuple, kept.select("doc_id", "text").collect()), key=repr)
    want = [(1, text("w").upper()), (1, text("z")), (2, text("v")), (4, ""), (4, text("u")), (None, text("w")), (5, None), (5, None), (6, text("t"))]
    assert got == sorted(want, key=repr)
    again = corpus_pipeline.near_duplicates(spark, docs.repartition(3), SMALL)
    assert sorted(map(tuple, again.select("doc_id", "text").collect()), key=repr) == got
