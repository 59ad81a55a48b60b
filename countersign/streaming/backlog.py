"""The backlog kept in order: sorted ranges, of which a change rewrites only those it touches.

The rows lie in ranges of the sort key, each a folder of sorted files. A *fence* is the least key
of a range. A changed transaction was and will be at one of two places, among the open or among
the finished ones, so the fences tell which ranges to read. They are merged and written anew, a
range that has grown too large as several; all others are taken over as they are. Which ranges make
up the backlog is written in a manifest under a number of its own, last of all.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countersign.operators.views import with_rank_key
from countersign.streaming.runs import drop, numbers, parts_named

VERSION = "version"
RANGE_ROWS = 1 << 20
_RANGES = "fence bigint, rows bigint, path string"
# Finished transactions come after all open ones.
_FINISHED = 1 << 60


class Range(NamedTuple):
    fence: int
    rows: int
    path: str


def _place(rank: Column) -> Column:
    return rank.cast("bigint") * F.lit(_FINISHED) + F.col("row_idx")


def _range_of(fences: list[int]):
    """A column function: the number of the range of a place."""
    sorted_fences = np.array(fences[1:], np.int64)

    @F.arrow_udf("int")
    def number(places: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(sorted_fences, places.to_numpy(), "right").astype(np.int32))

    return number


def ranges_of(spark: SparkSession, folder: str, version: int | None = None) -> list[Range]:
    """The ranges of the newest manifest, or of a given one, in order."""
    known = numbers(spark, f"{folder}/manifest", VERSION)
    if not known:
        return []
    version = known[-1] if version is None else version
    rows = spark.read.schema(_RANGES).parquet(f"{folder}/manifest/{VERSION}={version}").collect()
    return sorted(Range(*row) for row in rows)


def _stored(
    rows: DataFrame, folder: str, version: int, range_rows: int, lows: dict[int, int] | None = None
) -> list[Range]:
    """Write rows that carry ``range`` and ``place``, large ranges as several; tell their fences.

    The first part of a range keeps the fence ``lows`` has for it.
    """
    spark = rows.sparkSession
    size = F.count("*").over(Window.partitionBy("range"))
    at = F.row_number().over(Window.partitionBy("range").orderBy("place")) - 1
    part = F.when(size > 2 * range_rows, (at / range_rows).cast("int")).otherwise(F.lit(0))
    path = f"{folder}/rows/{version}"
    placed = rows.withColumn("part", part).repartition("range", "part").sortWithinPartitions("range", "part", "place")
    placed.write.mode("overwrite").partitionBy("range", "part").parquet(path)
    if not parts_named(spark, path, "range"):
        return []
    found = spark.read.parquet(path).groupBy("range", "part").agg(F.min("place"), F.count("*")).collect()
    lows = lows or {}
    return [
        Range(lows.get(number, low) if part == 0 else low, count, f"{path}/range={number}/part={part}")
        for number, part, low, count in found
    ]


def _published(spark: SparkSession, folder: str, version: int, ranges: list[Range]) -> None:
    rows = spark.createDataFrame(ranges, _RANGES)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/{VERSION}={version}")
    known = numbers(spark, f"{folder}/manifest", VERSION)
    # What the manifest before the last names stays for readers at work.
    for old in known[:-2]:
        gone = {r.path for r in ranges_of(spark, folder, old)}
        for kept in known[-2:]:
            gone -= {r.path for r in ranges_of(spark, folder, kept)}
        drop(spark, f"{folder}/manifest/{VERSION}={old}")
        for path in gone:
            drop(spark, path)


def build_backlog(reviewed: DataFrame, folder: str, *, range_rows: int = RANGE_ROWS) -> None:
    """Sort the whole backlog once. ``folder`` must be shared by all executors."""
    ranked = with_rank_key(reviewed).withColumn("place", _place(F.col("rank_key")))
    count = max(-(-ranked.count() // range_rows), 1)
    dealt = ranked.repartitionByRange(count, "place").withColumn("range", F.spark_partition_id())
    # Written as dealt: a range must not be computed twice, since its borders come from a sample.
    dealt.write.mode("overwrite").parquet(f"{folder}/dealt")
    spark = reviewed.sparkSession
    _published(spark, folder, 0, _stored(spark.read.parquet(f"{folder}/dealt"), folder, 0, range_rows))
    drop(spark, f"{folder}/dealt")


def merge_backlog(changed: DataFrame, folder: str, key: str = "tx_id", *, range_rows: int = RANGE_ROWS) -> list[str]:
    """Bring changed transactions, reviewed anew, to their places; returns the folders written.

    ``changed`` has one row per transaction and the columns the backlog was built with. Repeating a
    merge changes nothing but the number of the manifest.
    """
    spark = changed.sparkSession
    version = numbers(spark, f"{folder}/manifest", VERSION)[-1] + 1
    ranges = ranges_of(spark, folder)
    number = _range_of([r.fence for r in ranges])
    new = with_rank_key(changed).withColumn("place", _place(F.col("rank_key")))
    new = new.withColumn("range", number("place") if ranges else F.lit(0))
    new.write.mode("overwrite").parquet(f"{folder}/changed")
    new = spark.read.parquet(f"{folder}/changed")
    places = new.select(F.explode(F.array(_place(F.lit(0)), _place(F.lit(1)))).alias("place"))
    touched = [row[0] for row in places.select(number("place").alias("n")).distinct().collect()]
    touched = sorted(n for n in touched if n < len(ranges))  # at most one per range
    merged = new
    if touched:
        old = spark.read.parquet(*(ranges[n].path for n in touched))
        old = old.withColumn("range", number("place")).join(new.select(key), key, "left_anti")
        merged = old.select(*new.columns).unionByName(new)
    lows = {n: ranges[n].fence for n in touched}
    written = _stored(merged, folder, version, range_rows, lows)
    kept = [r for n, r in enumerate(ranges) if n not in set(touched)]
    _published(spark, folder, version, sorted([*kept, *written]))
    drop(spark, f"{folder}/changed")
    return [r.path for r in written]


def read_backlog(spark: SparkSession, folder: str) -> DataFrame:
    """The backlog as of the newest manifest; its ranges are sorted and follow each other."""
    paths = [r.path for r in ranges_of(spark, folder)]
    return spark.read.parquet(*paths).drop("place", "range", "part")
