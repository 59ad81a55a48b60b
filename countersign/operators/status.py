"""Transactions joined with their labels and classified."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countersign.functions import conflict_phase, grace_over, instant, is_filled
from countersign.operators.assignments import review_state
from countersign.rules import ReviewRules


def labels_differ(rules: ReviewRules) -> Column:
    """Did two reviewers give different labels? Never NULL.

    Missing labels do not count, the empty text does. The least label differs
    from the greatest exactly when there are two distinct ones.
    """
    labels = [F.col(c) for c in rules.label_columns]
    if len(labels) < 2:
        return F.lit(False)
    return F.coalesce(F.least(*labels) != F.greatest(*labels), F.lit(False))


def all_submitted(rules: ReviewRules) -> Column:
    """Did every reviewer of the roster give a label, be it the empty text?"""
    return reduce(and_, (F.col(c).isNotNull() for c in rules.label_columns))


def status_text(conflict: Column, submitted: Column) -> Column:
    return (
        F.when(conflict, F.lit("CONFLICT"))
        .when(submitted, F.lit("ASSIGNED"))
        .otherwise(F.lit("PENDING"))
    )


def open_item(conflict: Column, submitted: Column) -> Column:
    """Does the transaction still need work?"""
    return conflict | ~submitted


def with_labels(transactions: DataFrame, state: DataFrame, key: str = "tx_id") -> DataFrame:
    """Every transaction with its row of :func:`review_state`.

    A left join from the transactions: labels of ids that no transaction has
    stay stored and are never counted. Both sides have one row per key.
    """
    return transactions.join(state, key, "left")


def with_status(
    labelled: DataFrame,
    rules: ReviewRules,
    csv_date: Column,
    as_of: Column,
) -> DataFrame:
    """Add ``submitted``, ``conflict``, ``status`` and ``phase``.

    While the grace gate is closed a disagreement is no conflict, and the
    transaction then counts as assigned.
    """
    gate = grace_over(csv_date, as_of, rules.grace_hours)
    phase = conflict_phase(csv_date, as_of, rules.grace_hours)
    flags = {"submitted": all_submitted(rules), "conflict": gate & labels_differ(rules)}
    return labelled.withColumns({**flags, "phase": phase}).withColumn(
        "status", status_text(F.col("conflict"), F.col("submitted"))
    )


def review(
    transactions: DataFrame,
    submissions: DataFrame,
    rules: ReviewRules,
    csv_date: str | None,
    as_of: datetime,
    key: str = "tx_id",
) -> DataFrame:
    """Transactions with labels and status at ``as_of``, from raw submissions."""
    labelled = with_labels(transactions, review_state(submissions, rules, key), key)
    return with_status(labelled, rules, F.lit(csv_date).cast("string"), instant(as_of))


def review_at(
    transactions: DataFrame,
    submissions: DataFrame,
    rules: ReviewRules,
    csv_date: str | None,
    moments: list[datetime],
    key: str = "tx_id",
) -> DataFrame:
    """:func:`review` at several moments, told apart by ``as_of``.

    Labels are aggregated and joined once; each joined row is then repeated per
    moment.
    """
    labelled = with_labels(transactions, review_state(submissions, rules, key), key)
    instants = F.array(*(instant(moment) for moment in moments))
    repeated = labelled.withColumn("as_of", F.explode(instants))
    return with_status(repeated, rules, F.lit(csv_date).cast("string"), F.col("as_of"))


def review_flags(
    transactions: DataFrame,
    state: DataFrame,
    rules: ReviewRules,
    gate: Column,
    key: str = "tx_id",
) -> DataFrame:
    """``(key, submitted, conflict)`` per transaction: all that counts need.

    Labels are reduced to two flags before the join, and keys with neither flag
    are left out of it, since a missing row means the same.
    """
    flags = state.select(
        key,
        all_submitted(rules).alias("submitted"),
        (gate & labels_differ(rules)).alias("conflict"),
    ).where("submitted or conflict")
    joined = transactions.select(key).join(flags, key, "left")
    return joined.select(
        key, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("submitted", "conflict"))
    )


def conflicts(reviewed: DataFrame) -> DataFrame:
    return reviewed.where("conflict")


def fully_submitted(reviewed: DataFrame) -> DataFrame:
    return reviewed.where("submitted")


def remaining_for(label: str) -> Column:
    """Own label missing or empty, or in conflict."""
    return ~is_filled(F.col(label)) | F.col("conflict")
