"""Physical plans: shuffles, pruning, skew."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from countersign import ReviewRules
from countersign import operators as op
from tests.plans import exchanges, plan_of

RULES = ReviewRules.of("A", "B")
OPEN = datetime(2024, 1, 31, tzinfo=timezone.utc)
CLOSED = datetime(2024, 1, 30, 12, tzinfo=timezone.utc)
HOT = 10


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Labels of which a third belong to one transaction, in many files."""
    folder = tmp_path_factory.mktemp("tables")
    n = 60_000
    key = F.when(F.col("id") % 3 == 0, F.lit(HOT)).otherwise(F.col("id") % 20_000)
    spark.range(0, n, 1, 12).select(
        key.cast("bigint").alias("row_idx"),
        F.when(F.col("id") % 2 == 0, F.lit("A")).otherwise(F.lit("B")).alias("reviewer"),
        F.concat(F.lit("L"), (F.col("id") % 5).cast("string")).alias("assignment"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("ts"),
        F.col("id").alias("seq"),
    ).write.parquet(f"{folder}/labels")
    spark.range(25_000).select(
        F.col("id").alias("row_idx"), F.lit("x").alias("description"), F.rand(1).alias("amount")
    ).write.parquet(f"{folder}/tx")
    return spark.read.parquet(f"{folder}/tx"), spark.read.parquet(f"{folder}/labels")


@pytest.fixture
def shuffled(setting):
    """As at scale: nothing is small enough to be broadcast."""
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")


def test_stats_move_labels_once(shuffled, tables):
    tx, labels = tables
    state = op.review_state(labels, RULES, "row_idx")
    flags = op.review_flags(tx, state, RULES, F.lit(True), "row_idx")
    stats = op.review_stats(flags)
    # Labels by key, transaction keys by key, partial counts to one task.
    assert sorted(exchanges(stats)) == ["SinglePartition", "hashpartitioning", "hashpartitioning"]
    plan = plan_of(stats)
    assert "ReadSchema: struct<row_idx:bigint>" in plan
    assert "partial_max" in plan and "partial_count" in plan
    # Keys with neither flag are dropped below the join.
    below = plan[plan.index("SortMergeJoin") :]
    assert "Filter ((isnotnull(label_0" in below


def test_roster_filter_reaches_the_scan(tables):
    _, labels = tables
    plan = plan_of(op.review_state(labels, RULES, "row_idx"))
    assert "PushedFilters: [In(reviewer, [A,B])" in plan
    mine = plan_of(op.reviewer_labels(labels, RULES, "A", "row_idx"))
    assert "EqualTo(reviewer,A)" in mine


def test_views_join_once(shuffled, tables):
    tx, labels = tables
    both = op.review_at(tx, labels, RULES, "2024-01-30", [CLOSED, OPEN], "row_idx")
    for frame in (
        op.visible_assignments(both, RULES, "A"),
        op.tx_reviewer_matrix(op.review(tx, labels, RULES, None, OPEN, "row_idx"), RULES),
        op.own_submission(tx, labels, RULES, "A", "row_idx"),
        op.unassigned_by_reviewer(tx, labels, RULES, "A", "row_idx"),
    ):
        plan = plan_of(frame)
        assert plan.count("SortMergeJoin") == 1 and exchanges(frame) == ["hashpartitioning"] * 2
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_closed_gate_folds_away(tables):
    tx, labels = tables
    closed = op.review(tx, labels, RULES, "2024-01-30", CLOSED, "row_idx")
    assert "least(" not in plan_of(closed.select("row_idx", "conflict"))
    assert op.conflicts(closed).isEmpty()


def test_backlog_is_range_partitioned(shuffled, tables):
    tx, labels = tables
    ordered = op.backlog(op.review(tx, labels, RULES, "2024-01-30", OPEN, "row_idx"))
    assert "rangepartitioning" in exchanges(ordered)
    assert "SinglePartition" not in exchanges(ordered)


def test_hot_transaction_is_combined_before_the_shuffle(spark, tables):
    """A third of all labels on one key reaches the shuffle as one row per task."""
    _, labels = tables
    for frame, rows in [
        (op.latest_assignment(labels, "row_idx"), 2),
        (op.review_state(labels, RULES, "row_idx", last_updated=True), 1),
    ]:
        hot = frame.where(f"row_idx = {HOT}")
        assert hot.count() == rows
        tasks = labels.rdd.getNumPartitions()
        assert shuffle_records(hot) <= rows * tasks < 20_000


def shuffle_records(frame):
    """Rows written by the first shuffle of the frame's final plan."""
    execution = frame._jdf.queryExecution()
    execution.executedPlan().execute().count()
    plan = execution.executedPlan()
    node = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan
    stack = [node]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "Exchange":
            return node.metrics().apply("shuffleRecordsWritten").value()
        if name in ("ShuffleQueryStage", "AQEShuffleRead"):
            stack.append(node.children().head() if name == "AQEShuffleRead" else node.plan())
            continue
        children = node.children()
        stack.extend(children.apply(i) for i in range(children.size()))
    raise AssertionError("no shuffle")


def test_hot_key_results_are_whole(tables):
    tx, labels = tables
    last = labels.where(f"row_idx = {HOT}").orderBy(F.desc("ts"))
    expected = {r: last.where(f"reviewer = '{r}'").head().assignment for r in "AB"}
    state = op.review_state(labels, RULES, "row_idx").where(f"row_idx = {HOT}").head()
    assert (state.label_0, state.label_1) == (expected["A"], expected["B"])
