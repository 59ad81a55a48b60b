"""One JSON document of the whole state, through many tasks."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from countersign import ReviewRules
from countersign import operators as op
from countersign.sources import read_state_document, save_state_document
from tests.plans import plan_of

LABELS = ["A", "B, C", 'say "x"', "{", "}", "[,]", "\\", '\\"', "a\nb", "", "Zürich ☕", "},{", None]


def document(rng, entries, **layout):
    texts = {f"t{i} {rng.choice(LABELS)}": {w: rng.choice(LABELS) for w in rng.sample(["Ann", "Ben", "C, D", "{"], rng.randrange(4))} for i in range(entries)}
    return json.dumps(texts, ensure_ascii=False, **layout), texts


def long_form(states):
    return sorted(((tx, who, label) for state in states for tx, labels in state.items() for who, label in labels.items()), key=repr)


@pytest.mark.parametrize("block", [300, 100_000])
def test_documents_of_one_line_in_blocks(spark, setting, tmp_path, block):
    setting("spark.sql.files.maxPartitionBytes", str(block))
    setting("spark.sql.files.openCostInBytes", "0")
    rng, states = random.Random(block), []
    layouts = ({"separators": (",", ":")}, {}, {"indent": 2})
    for n, size in enumerate((60, 1, 35)):
        text, state = document(rng, size, **layouts[n])
        (tmp_path / f"in/{n}").mkdir(parents=True)
        (tmp_path / f"in/{n}/state.json").write_text(("﻿" if n == 2 else "") + text + "\n" * n, encoding="utf-8")
        states.append(state)
    (tmp_path / "in/empty.json").write_text("{}")
    rows = read_state_document(spark, [str(tmp_path / "in"), *(str(p) for p in (tmp_path / "in").glob("[0-9]"))], str(tmp_path / "land"))
    assert sorted((tuple(r) for r in rows.select("tx_id", "reviewer", "assignment").collect()), key=repr) == long_form(states)
    blocks = spark.read.parquet(str(tmp_path / "land/blocks")).count()
    assert blocks > (10 if block == 300 else 3)


def test_an_entry_that_is_no_state_leaves_the_others_alone(spark, setting, tmp_path):
    setting("spark.sql.files.maxPartitionBytes", "20")
    (tmp_path / "s.json").write_text('{"a":{"Ann":{"deep":[1,2]}},"b":7,"c":{"Ann":"x"},"d":[{"Ann":"y"},{}],"e":{"Ben":"z"}}')
    rows = read_state_document(spark, str(tmp_path / "s.json"), str(tmp_path / "land"))
    got = {(r.tx_id, r.reviewer): r.assignment for r in rows.collect()}
    assert got == {("a", "Ann"): '{"deep":[1,2]}', ("c", "Ann"): "x", ("e", "Ben"): "z"}


def test_parts_are_the_document(spark, setting, tmp_path):
    rng = random.Random(8)
    rows = [(f"t{i:03d}", who, rng.choice(LABELS[:-1])) for i in range(80) for who in ("Ann", "Ben") if rng.random() < 0.8]
    latest = spark.createDataFrame(rows, "tx_id string, reviewer string, assignment string").selectExpr("*", "timestamp'2024-01-01' ts", "0L seq")
    path = str(tmp_path / "state")
    parts = save_state_document(latest, path, parts=4).orderBy("offset").collect()
    files = sorted(Path(path).glob("part-*"))
    assert [p.part for p in parts] == [f.name for f in files] and len(files) == 4
    whole = b"".join(f.read_bytes() for f in files)
    assert [p.offset for p in parts] == [whole.find(f.read_bytes()) for f in files]
    state = json.loads(whole)
    assert list(state) == sorted(state) and {k for k in state} == {r[0] for r in rows}
    setting("spark.sql.files.maxPartitionBytes", "500")
    back = read_state_document(spark, path, str(tmp_path / "land"), in_parts=True)
    assert sorted(map(tuple, back.select("tx_id", "reviewer", "assignment").collect())) == sorted(rows)


def test_empty_document(spark, tmp_path):
    none = spark.createDataFrame([], "tx_id string, reviewer string, assignment string, ts timestamp, seq bigint")
    save_state_document(none, str(tmp_path / "state"))
    assert json.loads("".join(f.read_text() for f in (tmp_path / "state").glob("part-*"))) == {}
    assert read_state_document(spark, str(tmp_path / "state"), str(tmp_path / "land"), in_parts=True).count() == 0


def test_backlog_and_counts_from_one_pass(spark, tmp_path):
    tx = spark.range(500).selectExpr("concat('t', id) AS tx_id", "id AS row_idx")
    labels = [(f"t{i}", who, "A" if i % 3 or who == "A" else "B") for i in range(200) for who in "AB"]
    frame = spark.createDataFrame(labels, "tx_id string, reviewer string, assignment string").selectExpr("*", "timestamp'2024-01-01' ts", "0L seq")
    rules = ReviewRules.of("A", "B", grace_hours=None)
    reviewed = op.with_status(op.with_labels(tx, op.review_state(frame, rules)), rules, F.lit(None), F.current_timestamp())
    counts = op.write_backlog(reviewed, str(tmp_path / "rows"))
    assert counts == op.review_stats(reviewed).first().asDict()
    rows = [r.row_idx for r in spark.read.parquet(str(tmp_path / "rows")).orderBy("rank_key", "row_idx").collect()]
    assert len(rows) == 500 and plan_of(op.backlog(reviewed)).count("Join") == 1
