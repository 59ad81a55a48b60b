"""Reviews by rosters of more than a few: reviewers as rows or bits, not as columns.

For rosters of any size, labels stay rows: ``roster_labels`` are the latest ones, ``roster_counts``
one narrow row per transaction, ``roster_left`` what each reviewer has left. Work and memory follow
the labels; no row or column is as long as the roster.

For rosters of hundreds whose members matter transaction by transaction, ``roster_state`` adds
bitmaps: each reviewer of a roster table has a *place*, and a transaction has a 64-bit word per 64
places. Its width grows with the roster, so it suits no roster that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countersign.functions import is_filled
from countersign.operators.assignments import latest_assignment
from countersign.operators.status import status_text

# A roster up to this size is sent to all tasks.
MOST_REVIEWERS = 100_000
_WORD = 64


def roster_names(reviewers: DataFrame) -> DataFrame:
    """``reviewer``: the distinct names in the column ``reviewer``."""
    return reviewers.select("reviewer").where("reviewer is not null").distinct()


def roster_places(reviewers: DataFrame) -> DataFrame:
    """``reviewer, place`` of the distinct names in the column ``reviewer``, in their order.

    For bitmaps: the names are numbered in one task.
    """
    return roster_names(reviewers).select("reviewer", (F.row_number().over(Window.orderBy("reviewer")) - 1).alias("place"))


def _words(size: int, name: str) -> list[str]:
    return [f"{name}_{n}" for n in range(-(-size // _WORD))]


def _bits(size: int, name: str, held: Column) -> list[Column]:
    """Bitmaps over the places of the rows for which ``held`` is true."""
    bit = F.expr(f"shiftleft(1L, place % {_WORD})")
    word = F.expr(f"place div {_WORD}")
    return [
        F.bit_or(F.when((word == n) & held, bit).otherwise(F.lit(0).cast("bigint"))).alias(column)
        for n, column in enumerate(_words(size, name))
    ]


def _sent(roster: DataFrame, size: int) -> DataFrame:
    return F.broadcast(roster) if size <= MOST_REVIEWERS else roster


def roster_labels(submissions: DataFrame, roster: DataFrame, key: str = "tx_id") -> DataFrame:
    """``key, reviewer, assignment``: the latest label of each reviewer of the roster."""
    names = _sent(roster.select("reviewer"), roster.count())
    latest = latest_assignment(submissions.join(names, "reviewer", "left_semi"), key)
    return latest.select(key, "reviewer", "assignment")


def _judged(size: int) -> dict[str, Column]:
    return {
        "submitted": (F.col("given") == size) & F.lit(size > 0),
        "differ": F.coalesce(F.col("least") != F.col("greatest"), F.lit(False)),
    }


def _counts() -> list[Column]:
    label = F.col("assignment")
    return [
        F.min(label).alias("least"),
        F.max(label).alias("greatest"),
        F.count(label).alias("given"),
        F.count_if(is_filled(label)).alias("filled"),
    ]


def roster_counts(labels: DataFrame, roster: DataFrame, key: str = "tx_id") -> DataFrame:
    """One row per transaction with ``labels`` (see :func:`roster_labels`), whatever the roster's size.

    ``least``, ``greatest``: its labels, NULL left out; ``given``, ``filled``: how many reviewers
    gave a label, be it empty, and a filled one; ``submitted``: all of them did; ``differ``: two
    labels do.
    """
    return labels.groupBy(key).agg(*_counts()).withColumns(_judged(roster.count()))


def roster_state(submissions: DataFrame, roster: DataFrame, key: str = "tx_id") -> DataFrame:
    """:func:`roster_counts` with bitmaps, for rosters of hundreds (``reviewer, place``).

    ``given_0, given_1, ...`` and ``filled_0, ...`` have a bit per place.
    """
    size = roster.count()
    latest = roster_labels(submissions, roster, key).join(_sent(roster, size), "reviewer")
    label = F.col("assignment")
    grouped = latest.groupBy(key).agg(
        *_counts(),
        *_bits(size, "given", label.isNotNull()),
        *_bits(size, "filled", is_filled(label)),
    )
    return grouped.withColumns(_judged(size))


def roster_review(transactions: DataFrame, state: DataFrame, gate: Column, key: str = "tx_id") -> DataFrame:
    """Every transaction with ``given``, ``submitted``, ``conflict`` and ``status``.

    ``state`` is that of :func:`roster_counts` or :func:`roster_state`.
    """
    narrow = state.select(key, "given", "submitted", "differ")
    no = F.lit(False)
    joined = transactions.join(narrow, key, "left").withColumns(
        {
            "given": F.coalesce("given", F.lit(0)),
            "submitted": F.coalesce("submitted", no),
            "conflict": gate & F.coalesce("differ", no),
        }
    )
    return joined.drop("differ").withColumn("status", status_text(F.col("conflict"), F.col("submitted")))


def _remaining(transactions: DataFrame, roster: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """``reviewer, remaining`` from one row of ``done`` per reviewer and transaction that is done."""
    counts = done.groupBy(on).agg(F.count(F.lit(1)).alias("_done"))
    total = transactions.agg(F.count(F.lit(1))).scalar()
    left = total - F.coalesce("_done", F.lit(0))
    return roster.join(counts, on, "left").select("reviewer", left.alias("remaining"))


def roster_left(
    transactions: DataFrame, labels: DataFrame, counts: DataFrame, roster: DataFrame, gate: Column, key: str = "tx_id"
) -> DataFrame:
    """``reviewer, remaining``: own label missing or empty, or in conflict.

    What is filled and not in conflict is done. ``labels`` and ``counts`` are those of
    :func:`roster_labels` and :func:`roster_counts`; each label is joined once.
    """
    calm = transactions.select(key).join(counts.where(~(gate & F.col("differ"))).select(key), key)
    done = labels.where(is_filled(F.col("assignment"))).select(key, "reviewer").join(calm, key)
    return _remaining(transactions, roster, done, "reviewer")


def roster_remaining(
    transactions: DataFrame, state: DataFrame, roster: DataFrame, gate: Column, key: str = "tx_id"
) -> DataFrame:
    """:func:`roster_left` from the bitmaps of :func:`roster_state`: a step per word, and one per label."""
    words = _words(roster.count(), "filled")
    held = F.array(*words) if words else F.array().cast("array<bigint>")
    done = state.where(~(gate & F.col("differ"))).select(key, held.alias("_words"))
    known = transactions.select(key).join(done, key)
    some = known.select(F.posexplode("_words").alias("_at", "_word")).where("_word != 0")
    bits = F.expr(f"filter(sequence(0, {_WORD - 1}), i -> (shiftright(_word, i) & 1L) = 1L)")
    places = some.select("_at", F.explode(bits).alias("_bit")).select((F.col("_at") * _WORD + F.col("_bit")).alias("place"))
    return _remaining(transactions, roster, places, "place")
