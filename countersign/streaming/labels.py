"""Labels as a stream: live state per transaction, live counts."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from countersign.functions import is_filled
from countersign.operators.assignments import review_state
from countersign.operators.status import all_submitted, labels_differ
from countersign.rules import ReviewRules
from countersign.streaming.runs import (
    BATCH,
    COMPACT_EVERY,
    drop,
    ensure_log,
    newest_per_key,
    numbers,
    start_batches,
)
from countersign.streaming.tiers import KeyIndex, compact, read_log

STATE_LOG = "state"
COUNT_LOG = "counts"
CHANGE = "change"
SNAPSHOT = "snapshot"
INDEX = "index"


def live_state(stream: DataFrame, rules: ReviewRules, key: str = "tx_id") -> DataFrame:
    """Latest labels and newest stamp per transaction, over a stream of labels.

    The batch aggregation, run statefully. A label that arrives late loses
    against one with a later ``(ts, seq)``. Old labels hold forever, so there is
    no watermark: the state has one row per transaction ever labelled.
    """
    return review_state(stream, rules, key, last_updated=True)


def read_state(spark: SparkSession, folder: str, key: str = "tx_id") -> DataFrame:
    """Current state per transaction from the log :func:`run_live_state` keeps."""
    return newest_per_key(read_log(f"{folder}/{STATE_LOG}", spark), key)


def run_live_state(
    stream: DataFrame,
    rules: ReviewRules,
    folder: str,
    key: str = "tx_id",
    *,
    after: Callable[[SparkSession, int], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Process labels; append changed transactions to a log.

    Update mode: each batch writes only the transactions it changed, into a
    folder named by the batch number, so a repeated batch replaces itself. Every
    ``COMPACT_EVERY`` batches are folded into a tier (:mod:`countersign.streaming.tiers`),
    so neither what a reader opens grows with the number of batches nor what a
    fold rewrites with the state. ``trigger`` is Spark's; by default the run ends with the data
    available now.
    ``folder`` must be shared by all executors; it holds the log and the
    checkpoint, which belong together. The number of state partitions is the
    session's ``spark.sql.shuffle.partitions`` at the first start.
    """
    state = live_state(stream, rules, key)
    log = f"{folder}/{STATE_LOG}"
    ensure_log(stream.sparkSession.createDataFrame([], state.schema), log)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/{BATCH}={number}")
        if after is not None:
            after(batch.sparkSession, number)
        if number % COMPACT_EVERY == COMPACT_EVERY - 1:
            compact(log, batch.sparkSession, key, number)

    return start_batches(state, store, f"{folder}/checkpoint", mode="update", trigger=trigger)


def _tallies(rules: ReviewRules) -> dict[str, Column]:
    """What a transaction adds to the counts. All of it is a sum, so a changed
    transaction costs its new share minus its old one; and none of it knows the
    gate, which is applied when the counts are read."""
    differ = labels_differ(rules)
    tests = {
        "submitted": all_submitted(rules),
        "differing": differ,
        "submitted_differing": all_submitted(rules) & differ,
    }
    for column in rules.label_columns:
        tests[f"{column}_filled"] = is_filled(F.col(column))
        tests[f"{column}_filled_differing"] = is_filled(F.col(column)) & differ
    return {name: test.cast("bigint") for name, test in tests.items()}


def run_live_stats(
    stream: DataFrame,
    transactions: DataFrame,
    rules: ReviewRules,
    folder: str,
    key: str = "tx_id",
    *,
    snapshot: str = "",
    trigger: dict | None = None,
) -> StreamingQuery:
    """:func:`run_live_state`, and the counts brought up to date by each batch.

    A second aggregation cannot follow the first one in the same update-mode
    stream, so a batch job takes the difference the changed transactions make.
    The few changed keys are the build side of both joins; of the log, and of an index
    of the transactions' keys that is written once per snapshot, only their buckets are
    read, so a batch costs the same for any number of transactions.

    ``transactions`` have unique keys, and ``snapshot`` names them, such as the
    upload they come from. The counts are kept with that name: labels stay when
    another upload replaces the transactions, so a run under another name counts
    the stored state anew, once, without replaying labels.
    """
    spark = stream.sparkSession
    tallies = _tallies(rules)
    log, counts = f"{folder}/{STATE_LOG}", f"{folder}/{COUNT_LOG}"
    total = F.count(F.lit(1)).alias("total")
    named = F.lit(snapshot).alias(SNAPSHOT)
    zeros = [F.lit(0).cast("bigint").alias(name) for name in tallies]
    ensure_log(transactions.agg(total).select("total", *zeros, named), counts)
    ensure_log(spark.createDataFrame([], live_state(stream, rules, key).schema), log)

    index = KeyIndex(spark, f"{folder}/{INDEX}/{sha256(snapshot.encode()).hexdigest()[:16]}", key)
    index.build(transactions)

    def store(summed: DataFrame, number: int) -> None:
        summed.write.mode("overwrite").parquet(f"{counts}/{BATCH}={number}")
        # The one before is there for a batch that is repeated; -1 marks a log that has begun.
        for old in [n for n in numbers(spark, counts, BATCH) if 0 <= n < number][:-1]:
            drop(spark, f"{counts}/{BATCH}={old}")

    def counted_anew(spark: SparkSession, number: int) -> DataFrame:
        state = newest_per_key(read_log(log, spark, number + 1), key)
        known = transactions.select(key).join(state, key, "left")
        sums = [F.coalesce(F.sum(value), F.lit(0)).alias(name) for name, value in tallies.items()]
        return known.agg(total, *sums).select("total", *tallies, named)

    def count(spark: SparkSession, number: int) -> None:
        before = _newest_counts(spark, folder, number)
        if before.where(F.col(SNAPSHOT) == F.lit(snapshot)).isEmpty():
            store(counted_anew(spark, number), number)
            return
        new = spark.read.parquet(f"{log}/{BATCH}={number}")
        earlier = read_log(log, spark, number, touched=new, key=key)
        old = newest_per_key(earlier.join(new.select(key), key, "left_semi"), key)

        def share(state: DataFrame, sign: int) -> DataFrame:
            parts = [(value * F.lit(sign)).alias(name) for name, value in tallies.items()]
            return state.select(key, *parts)

        change = share(new, 1).unionByName(share(old, -1))
        change.write.mode("overwrite").parquet(f"{folder}/{CHANGE}")
        known = index.near(new).join(spark.read.parquet(f"{folder}/{CHANGE}"), key)
        sums = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in tallies]
        delta = known.agg(F.lit(0).cast("bigint").alias("total"), *sums)
        columns = ["total", *tallies]
        both = before.select(*columns).unionByName(delta.select(*columns))
        store(both.agg(*(F.sum(c).alias(c) for c in columns)).select(*columns, named), number)

    newest = _newest_counts(spark, folder, keep_batch=True).first()
    if newest[SNAPSHOT] != snapshot:
        # The newest batch is counted again under the new name before labels flow.
        store(counted_anew(spark, newest[BATCH]), newest[BATCH])
    return run_live_state(stream, rules, folder, key, after=count, trigger=trigger)


def _newest_counts(
    spark: SparkSession, folder: str, before: int | None = None, *, keep_batch: bool = False
) -> DataFrame:
    """The counts of the newest batch, or of the newest one before a batch."""
    log = f"{folder}/{COUNT_LOG}"
    number = max(n for n in numbers(spark, log, BATCH) if before is None or n < before)
    newest = spark.read.parquet(f"{log}/{BATCH}={number}")
    return newest.withColumn(BATCH, F.lit(number)) if keep_batch else newest


def read_stats(spark: SparkSession, folder: str, gate: Column) -> DataFrame:
    """``total, assigned, conflicts, pending`` after the newest batch.

    ``gate`` tells whether disagreements count as conflicts by now.
    """
    shown = F.when(gate, F.lit(1)).otherwise(F.lit(0))
    assigned = F.col("submitted") - shown * F.col("submitted_differing")
    return _newest_counts(spark, folder).select(
        "total",
        assigned.alias("assigned"),
        (shown * F.col("differing")).alias("conflicts"),
        (F.col("total") - assigned).alias("pending"),
    )


def read_remaining(
    spark: SparkSession, folder: str, rules: ReviewRules, gate: Column
) -> DataFrame:
    """``reviewer, remaining`` after the newest batch."""
    shown = F.when(gate, F.lit(1)).otherwise(F.lit(0))
    pairs = [
        F.struct(
            F.lit(name).alias("reviewer"),
            (
                F.col("total")
                - F.col(f"{column}_filled")
                + shown * F.col(f"{column}_filled_differing")
            ).alias("remaining"),
        )
        for name, column in zip(rules.roster, rules.label_columns)
    ]
    turned = _newest_counts(spark, folder).select(F.explode(F.array(*pairs)).alias("_pair"))
    return turned.select("_pair.*")
