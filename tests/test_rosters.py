"""Rosters of hundreds against plain loops."""

import random
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

from countersign import operators as op
from countersign.plans.catalog import QUERIES
from countersign.plans.oracle import ORACLE
from tests.plans import plan_of

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
LABELS = "tx_id string, reviewer string, assignment string, ts timestamp, seq bigint"


def brute(events, people, keys, gate):
    last = {}
    for tx, who, label, ts, seq in events:
        if who in people:
            last[tx, who] = max(last.get((tx, who), (START, -1, "")), (ts, seq, "\0" if label is None else label))
    rows, left = {}, dict.fromkeys(people, 0)
    for tx in keys:
        labels = {w: last[tx, w][2] for w in people if (tx, w) in last}
        labels = {w: x for w, x in labels.items() if x != "\0"}
        conflict = gate and len(set(labels.values())) > 1
        submitted = len(labels) == len(people)
        status = "CONFLICT" if conflict else "ASSIGNED" if submitted else "PENDING"
        rows[tx] = (len(labels), submitted, conflict, status)
        for who in people:
            left[who] += not labels.get(who) or conflict
    return rows, left


@pytest.mark.parametrize("size", [1, 3, 64, 65, 150])
def test_equals_loops(spark, size):
    rng = random.Random(size)
    people = [f"r{i:03d}" for i in range(size)]
    keys = [f"t{i}" for i in range(12)]
    events = []
    for n in range(60):
        events.append((rng.choice([*keys, "orphan"]), rng.choice([*people, "guest"]), rng.choice(["A", "B", "", None]), START + timedelta(hours=rng.randrange(9)), n))
    # One transaction that all agree on, one where the last one differs.
    for n, who in enumerate(people):
        events += [("t0", who, "A", START + timedelta(days=1), n), ("t1", who, "A" if n < size - 1 else "B", START + timedelta(days=1), n)]
    frame = spark.createDataFrame(events, LABELS)
    roster = op.roster_places(spark.createDataFrame([(p,) for p in [*people, *people[:2], None]], "reviewer string"))
    tx = spark.createDataFrame([(k,) for k in keys], "tx_id string")
    state = op.roster_state(frame, roster)
    for gate in (True, False):
        rows, left = brute(events, people, keys, gate)
        got = op.roster_review(tx, state, F.lit(gate)).collect()
        assert {r.tx_id: (r.given, r.submitted, r.conflict, r.status) for r in got} == rows
        remaining = op.roster_remaining(tx, state, roster, F.lit(gate)).collect()
        assert {r.reviewer: r.remaining for r in remaining} == left
    assert len(state.columns) == 7 + 2 * -(-size // 64)


def test_no_reviewers(spark):
    roster = op.roster_places(spark.createDataFrame([], "reviewer string"))
    state = op.roster_state(spark.createDataFrame([], LABELS), roster)
    tx = spark.createDataFrame([("a",)], "tx_id string")
    assert op.roster_review(tx, state, F.lit(True)).first().status == "PENDING"
    assert op.roster_remaining(tx, state, roster, F.lit(True)).count() == 0


@pytest.mark.parametrize("size", [0, 1, 3, 70])
def test_labels_as_rows_equal_loops(spark, size):
    rng = random.Random(size)
    people = [f"r{i:03d}" for i in range(size)]
    keys = [f"t{i}" for i in range(12)]
    events = [
        (rng.choice([*keys, "orphan", None]), rng.choice([*people, "guest", None]), rng.choice(["A", "B", "", None]), START + timedelta(hours=rng.randrange(9)), n)
        for n in range(300)
    ]
    events += [("t0", who, "A", START + timedelta(days=1), n) for n, who in enumerate(people)]
    frame = spark.createDataFrame(events, LABELS)
    roster = op.roster_names(spark.createDataFrame([(p,) for p in [*people, *people[:2], None]], "reviewer string"))
    tx = spark.createDataFrame([(k,) for k in keys], "tx_id string")
    labels = op.roster_labels(frame, roster)
    counts = op.roster_counts(labels, roster)
    for gate in (True, False):
        rows, left = brute([e for e in events if e[0] is not None], people, keys, gate)
        if not size:
            rows = dict.fromkeys(keys, (0, False, False, "PENDING"))
        got = op.roster_review(tx, counts, F.lit(gate)).collect()
        assert {r.tx_id: (r.given, r.submitted, r.conflict, r.status) for r in got} == rows
        assert {r.reviewer: r.remaining for r in op.roster_left(tx, labels, counts, roster, F.lit(gate)).collect()} == left


@pytest.mark.parametrize("name", ["large_roster", "large_roster_remaining"])
def test_a_roster_that_grows_with_the_labels(spark, tmp_path, name):
    """Nearly as many reviewers as labels, and one transaction labelled by a third of them."""
    users, kinds = 90_000, F.array(*map(F.lit, ("click", "view", "error")))
    key = F.when(F.col("id") % 3 == 0, F.lit(40)).otherwise(F.col("id"))
    spark.range(0, 100_000, 1, 8).select(
        key.alias("event_id"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"),
        (F.col("id") * 7 % users).alias("user_id"),
        kinds[(F.hash("id") % 3 + 3).cast("int") % 3].alias("event_type"),
    ).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(0, 40_000, 1, 2).select(
        F.col("id").alias("o_orderkey"),
        F.lit("1998-01-01").cast("timestamp_ntz").alias("o_orderdate"),
        F.lit(1.0).alias("o_totalprice"),
        F.lit("x").alias("o_orderpriority"),
    ).write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES[name](spark, str(tmp_path)).collect()
    connection = duckdb.connect()
    for table in ("orders", "events"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = connection.sql(ORACLE[name]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) >= 40_000


@pytest.mark.parametrize("name", ["large_roster", "large_roster_remaining"])
def test_no_step_for_each_place(spark, name):
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "bit_or" not in plan and "Generate" not in plan and "Window" not in plan
