"""Conflicts that become visible because time goes by, without a new label."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from countersign.functions import hours_since
from countersign.operators.status import labels_differ
from countersign.rules import ReviewRules
from countersign.streaming.labels import read_state
from countersign.streaming.runs import BATCH, ensure_log, numbers, start_batches

GATE_LOG = "gate"
TICK = "opened_at"
_BATCHES = "batches"


def ticks(spark: SparkSession, start: datetime, every_ms: int) -> DataFrame:
    """A clock as a stream: one row per micro-batch, ``every_ms`` later than the one before.

    A naive ``start`` is taken as UTC. For a clock that follows the wall, give a trigger of ``every_ms`` to the run.
    """
    start = start if start.tzinfo else start.replace(tzinfo=timezone.utc)
    since = int(start.timestamp() * 1000)
    source = spark.readStream.format("rate-micro-batch").options(
        rowsPerBatch=1, numPartitions=1, startTimestamp=since, advanceMillisPerBatch=every_ms
    )
    return source.load().select(F.col("timestamp").alias("now"))


def gate_opens_at(csv_date: Column, grace_hours: float) -> Column:
    """The instant from which disagreements of a batch date are visible; NULL if there is none."""
    zero = F.timestamp_micros(F.lit(0))
    start = F.timestamp_millis((-hours_since(csv_date, zero) * F.lit(3_600_000.0)).cast("bigint"))
    return start + F.make_dt_interval(secs=F.lit(grace_hours * 3600))


def run_live_gate(
    clock: DataFrame,
    transactions: DataFrame,
    rules: ReviewRules,
    folder: str,
    key: str = "tx_id",
    *,
    csv_date: str = "csv_date",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append the conflicts whose gate has opened since the tick before, at every tick of ``clock``.

    ``clock`` is a stream with the column ``now``. The labels are those of :func:`run_live_state`
    in ``folder``. Each gate opens once, between two ticks, so a tick looks at the transactions of
    the batch dates that come of age, not at all of them: a table partitioned by ``csv_date`` is
    read in these partitions. The state is joined by key. A label that arrives after its gate is
    open changes the state and the counts, as before; this log is for those that nobody touches.
    A batch is stored under its number, so a repeated one replaces itself; a tick that is not
    later than the one before shows nothing.
    """
    if rules.grace_hours is None:
        raise ValueError("without a grace period no gate opens by itself")
    spark = clock.sparkSession
    place = f"{folder}/{GATE_LOG}"
    opens = gate_opens_at(F.col(csv_date), rules.grace_hours)
    start = spark.createDataFrame([], "now timestamp")
    ensure_log(start, f"{place}/clock")

    def store(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        earlier = [n for n in numbers(session, f"{place}/clock", BATCH) if n < number]
        clocks = [f"{place}/clock/{BATCH}={n}" for n in earlier]
        before = session.read.schema("now timestamp").parquet(*clocks).agg(F.max("now")).first()[0]
        now = batch.agg(F.max("now")).first()[0]
        now = max(filter(None, (before, now)), default=None)
        since = opens > F.lit(before) if before is not None else F.lit(True)
        due = transactions.where((opens <= F.lit(now)) & since) if now is not None else transactions.limit(0)
        state = read_state(session, folder, key)
        # Either side may be the small one; Spark picks by its statistics.
        found = due.join(state.where(labels_differ(rules)).select(key, *rules.label_columns), key)
        found.withColumn(TICK, F.lit(now).cast("timestamp")).write.mode("overwrite").parquet(f"{place}/rows/{_BATCHES}={number}")
        # The time goes last: a batch that failed halfway begins anew.
        session.createDataFrame([(now,)], "now timestamp").write.mode("overwrite").parquet(f"{place}/clock/{BATCH}={number}")

    return start_batches(clock, store, f"{place}/checkpoint", mode="append", trigger=trigger)


def read_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The conflicts shown so far, with the tick ``opened_at`` that showed them."""
    return spark.read.parquet(f"{folder}/{GATE_LOG}/rows").drop(_BATCHES)
