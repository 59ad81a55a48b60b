"""Labels given by reviewers: latest value, merging, filters.

The working form is a long table ``(key, reviewer, assignment, ts, seq)``. An
edit is another row; the row with the greatest ``(ts, seq)`` holds. Every
function works on ``key``, the transaction's id or a surrogate for it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countersign.functions import instant
from countersign.rules import ReviewRules


def _version(condition: Column | None = None) -> Column:
    """One label with its place in time. ``max`` over it combines on the map
    side, so a transaction edited without end ships one row per task. The label
    comes last and breaks a full tie the same way in every run."""
    version = F.struct("ts", "seq", "assignment")
    return version if condition is None else F.when(condition, version)


def submit(
    chosen: DataFrame,
    rules: ReviewRules,
    reviewer: str,
    label: str,
    at: datetime,
    seq: int,
    key: str = "tx_id",
) -> DataFrame:
    """One reviewer's label for the ``chosen`` transactions, as rows to append.

    A first label and an edit are the same thing: labels are never updated in
    place, so what other reviewers gave stays as it is. ``seq`` grows from one
    submission to the next and decides between equal times.
    """
    rules.position(reviewer)
    if label not in rules.options:
        raise ValueError(f"{label!r} is not one of {rules.options}")
    return chosen.select(
        key,
        F.lit(reviewer).alias("reviewer"),
        F.lit(label).alias("assignment"),
        instant(at).alias("ts"),
        F.lit(seq).cast("bigint").alias("seq"),
    )


def roster_filter(submissions: DataFrame, rules: ReviewRules) -> DataFrame:
    """Only labels given by reviewers of the roster."""
    return submissions.where(F.col("reviewer").isin(*rules.roster))


def accepted_label(rules: ReviewRules, label: str = "assignment") -> Column:
    """Is the label one of those offered? False for NULL."""
    return F.coalesce(F.col(label).isin(*rules.options), F.lit(False))


def option_domain(submissions: DataFrame, rules: ReviewRules) -> DataFrame:
    """Only labels that are offered."""
    return submissions.where(accepted_label(rules))


def rejected_labels(submissions: DataFrame, rules: ReviewRules) -> DataFrame:
    """The complement of :func:`option_domain`."""
    return submissions.where(~accepted_label(rules))


def latest_assignment(submissions: DataFrame, key: str = "tx_id") -> DataFrame:
    """The label that holds for each (transaction, reviewer)."""
    latest = submissions.groupBy(key, "reviewer").agg(F.max(_version()).alias("_last"))
    return latest.select(key, "reviewer", "_last.assignment", "_last.ts", "_last.seq")


def merge_state(base: DataFrame, delta: DataFrame, key: str = "tx_id") -> DataFrame:
    """Stored labels overridden by newer ones, per transaction and reviewer."""
    return latest_assignment(base.unionByName(delta), key)


def last_updated(submissions: DataFrame, key: str = "tx_id") -> DataFrame:
    """Newest stamp per transaction, whoever submitted."""
    return submissions.groupBy(key).agg(F.max("ts").alias("last_updated"))


def review_state(
    submissions: DataFrame,
    rules: ReviewRules,
    key: str = "tx_id",
    *,
    last_updated: bool = False,
) -> DataFrame:
    """One row per transaction with every reviewer's latest label.

    One aggregation, so one shuffle, instead of latest-per-reviewer followed by
    a regrouping. The labels are in ``label_0``, ``label_1``, ... in roster
    order. Works on a stream too. Rows of other people matter to
    ``last_updated`` only; without it they are dropped before the shuffle.
    """
    if not last_updated:
        submissions = roster_filter(submissions, rules)
    versions = [
        F.max(_version(F.col("reviewer") == F.lit(name))).alias(column)
        for name, column in zip(rules.roster, rules.label_columns)
    ]
    stamp = [F.max("ts").alias("last_updated")] if last_updated else []
    grouped = submissions.groupBy(key).agg(*versions, *stamp)
    return grouped.select(
        key,
        *(F.col(c).getField("assignment").alias(c) for c in rules.label_columns),
        *(["last_updated"] if last_updated else []),
    )


def reviewer_labels(
    submissions: DataFrame, rules: ReviewRules, viewer: str, key: str = "tx_id"
) -> DataFrame:
    """``(key, own)``: latest label of one reviewer per transaction."""
    rules.position(viewer)
    mine = submissions.where(F.col("reviewer") == F.lit(viewer))
    latest = mine.groupBy(key).agg(F.max(_version()).alias("_last"))
    return latest.select(key, F.col("_last.assignment").alias("own"))
