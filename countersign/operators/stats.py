"""Counts over reviewed transactions; each in a single aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countersign.operators.status import open_item, remaining_for
from countersign.rules import ALERT_TEXT, BANNER_TEXT, ReviewRules


def review_counts(conflict: Column, submitted: Column) -> list[Column]:
    """``total, assigned, conflicts, pending`` as aggregates."""
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(submitted & ~conflict).alias("assigned"),
        F.count_if(conflict).alias("conflicts"),
        F.count_if(open_item(conflict, submitted)).alias("pending"),
    ]


def review_stats(flags: DataFrame, *by: str) -> DataFrame:
    """``total, assigned, conflicts, pending``, overall or per ``by``.

    Needs the columns ``submitted`` and ``conflict``.
    """
    return flags.groupBy(*by).agg(*review_counts(F.col("conflict"), F.col("submitted")))


def review_summary(stats: DataFrame) -> DataFrame:
    """``resolved``, ``conflicts`` and ``remaining`` of :func:`review_stats`."""
    return stats.select(
        F.col("assigned").alias("resolved"),
        F.col("conflicts"),
        F.col("pending").alias("remaining"),
    )


def conflict_alert(stats: DataFrame, phase: Column) -> DataFrame:
    """One row if there are conflicts, else none.

    ``alert`` is always given; ``banner`` only while reviewers see each other's
    labels.
    """

    def counted(text: str) -> Column:
        before, after = text.split("{}")
        return F.concat(F.lit(before), F.col("conflicts").cast("string"), F.lit(after))

    return stats.where(F.col("conflicts") > 0).select(
        "conflicts",
        counted(ALERT_TEXT).alias("alert"),
        F.when(phase, counted(BANNER_TEXT)).alias("banner"),
    )


def remaining_by_reviewer(reviewed: DataFrame, rules: ReviewRules, *by: str) -> DataFrame:
    """Open work per reviewer: one count per reviewer over the joined rows, then
    the few result rows are turned; no transaction row is multiplied."""
    counts = [
        F.count_if(remaining_for(label)).alias(label) for label in rules.label_columns
    ]
    turned = F.explode(
        F.array(
            *(
                F.struct(F.lit(name).alias("reviewer"), F.col(label).alias("remaining"))
                for name, label in zip(rules.roster, rules.label_columns)
            )
        )
    )
    return reviewed.groupBy(*by).agg(*counts).select(*by, turned.alias("_r")).select(*by, "_r.*")
