"""What reviewers look at: backlog, own labels, labels of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from countersign.functions import filled, is_filled
from countersign.operators.assignments import reviewer_labels
from countersign.operators.stats import review_counts
from countersign.operators.status import open_item
from countersign.rules import MISSING_IN_OWN_VIEW, MISSING_IN_SHARED_VIEW, ReviewRules


def with_rank_key(reviewed: DataFrame) -> DataFrame:
    """Add ``rank_key``: 0 for open transactions, 1 for finished ones."""
    needs_work = open_item(F.col("conflict"), F.col("submitted"))
    return reviewed.withColumn("rank_key", F.when(needs_work, F.lit(0)).otherwise(F.lit(1)))


def backlog(reviewed: DataFrame) -> DataFrame:
    """Open transactions first, file order within each group.

    A range-partitioned sort; the position is part of the sort key, so the two
    values of ``rank_key`` do not decide how many partitions there are.
    """
    return with_rank_key(reviewed).orderBy("rank_key", "row_idx")


def write_backlog(reviewed: DataFrame, path: str) -> dict[str, int]:
    """Write the backlog and return its ``total, assigned, conflicts, pending``.

    The counts are taken of the rows that are written, as they are written: no second pass, and
    no other rows than those in the files. Above the sort, whose sampling would count rows twice.
    """
    seen = Observation()
    counts = review_counts(F.col("conflict"), F.col("submitted"))
    backlog(reviewed).observe(seen, *counts).write.mode("overwrite").parquet(path)
    return seen.get


def own_submission(
    transactions: DataFrame,
    submissions: DataFrame,
    rules: ReviewRules,
    viewer: str,
    key: str = "tx_id",
) -> DataFrame:
    """Add ``own``: the viewer's label, NULL if missing or empty.

    Only the viewer's rows are aggregated.
    """
    mine = reviewer_labels(submissions, rules, viewer, key)
    mine = mine.select(key, filled(F.col("own")).alias("own")).where("own is not null")
    return transactions.join(mine, key, "left")


def next_action(own: Column) -> Column:
    """What the viewer can do with a transaction."""
    return F.when(own.isNull(), F.lit("Assign")).otherwise(F.lit("Edit"))


def unassigned_by_reviewer(
    transactions: DataFrame,
    submissions: DataFrame,
    rules: ReviewRules,
    viewer: str,
    key: str = "tx_id",
) -> DataFrame:
    """Transactions without a filled label of ``viewer``."""
    mine = reviewer_labels(submissions, rules, viewer, key).where(is_filled(F.col("own")))
    return transactions.join(mine, key, "left_anti")


def tx_reviewer_matrix(labelled: DataFrame, rules: ReviewRules) -> DataFrame:
    """One row per transaction and reviewer: ``reviewer``, ``assignment``.

    The roster is a constant, so each joined row is turned into one row per
    reviewer in place; neither a cross join nor a second lookup is needed.
    """
    pairs = F.explode(
        F.array(
            *(
                F.struct(F.lit(name).alias("reviewer"), F.col(label).alias("assignment"))
                for name, label in zip(rules.roster, rules.label_columns)
            )
        )
    )
    kept = [c for c in labelled.columns if c not in rules.label_columns]
    return labelled.select(*kept, pairs.alias("_pair")).select(*kept, "_pair.*")


def visible_assignments(reviewed: DataFrame, rules: ReviewRules, viewer: str) -> DataFrame:
    """The labels ``viewer`` may see: the own one, or all in the conflict phase.

    ``shown`` holds the label or a placeholder.
    """
    rules.position(viewer)
    pairs = tx_reviewer_matrix(reviewed, rules)
    placeholder = F.when(F.col("phase"), F.lit(MISSING_IN_SHARED_VIEW)).otherwise(
        F.lit(MISSING_IN_OWN_VIEW)
    )
    seen = pairs.where(F.col("phase") | (F.col("reviewer") == F.lit(viewer)))
    return seen.withColumn("shown", F.coalesce(filled(F.col("assignment")), placeholder))
