"""Shared parts of the streaming jobs: batches, their folders, and starting a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"
# So many batches are folded into a tier at once.
COMPACT_EVERY = 8
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ensure_log(start: DataFrame, log: str) -> None:
    """Make ``log`` readable before its first batch: ``start`` is batch -1."""
    start.write.mode("ignore").parquet(f"{log}/{BATCH}=-1")


def newest_per_key(log: DataFrame, key: str, *, keep_batch: bool = False) -> DataFrame:
    """For each key its row from the newest batch; a batch has a key once."""
    values = [c for c in log.columns if c not in (key, BATCH)]
    newest = log.groupBy(key).agg(F.max(F.struct(BATCH, *values)).alias("_newest"))
    kept = [BATCH, *values] if keep_batch else values
    return newest.select(key, *(F.col("_newest").getField(c).alias(c) for c in kept))


def _store(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def parts_named(spark: SparkSession, folder: str, name: str, *, finished: bool = False) -> list[str]:
    """What follows ``name=`` in the names of the (finished) parts of a folder."""
    store, path = _store(spark, folder)
    if not store.exists(path):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    return [
        part.getPath().getName().partition("=")[2]
        for part in store.listStatus(path)
        if part.getPath().getName().startswith(f"{name}=")
        and (not finished or store.exists(done(part.getPath(), "_SUCCESS")))
    ]


def numbers(spark: SparkSession, folder: str, name: str, *, finished: bool = True) -> list[int]:
    """Numbers of the (finished) parts ``name=<number>`` of a folder, in order."""
    return sorted(map(int, parts_named(spark, folder, name, finished=finished)))


def drop(spark: SparkSession, folder: str) -> None:
    store, path = _store(spark, folder)
    store.delete(path, True)


def start_batches(
    stream: DataFrame,
    store: Callable[[DataFrame, int], None],
    checkpoint: str,
    *,
    mode: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run ``store`` on each micro-batch.

    ``trigger`` are the arguments of Spark's own; by default the run ends when
    the data available now is processed.

    State that never expires outgrows the executors' heap, so a run uses
    RocksDB unless the session names a state store itself. The setting is
    copied when the run starts and put back after.
    """
    spark = stream.sparkSession
    unset = spark.conf.get(_PROVIDER, None) is None
    if unset:
        spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return (
            stream.writeStream.outputMode(mode)
            .foreachBatch(store)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        if unset:
            spark.conf.unset(_PROVIDER)
