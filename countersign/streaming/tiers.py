"""A log of changed rows, kept in tiers.

Batches are appended as they come. Every ``COMPACT_EVERY`` of them become a *tier* with one row
per key. A tier is merged with the next older one only when what is merged has at least as many
rows as the buckets of that tier it touches. So a row is rewritten about once per doubling of
the rows that came after it: the work per batch follows the keys it changes and the logarithm of
the state, never the state.

Rows of a tier lie in buckets by the hash of their key, 2 ** ``bits`` of them, as many as the rows
need; a bucket splits in two when the tier has outgrown it. A merge rewrites the buckets it
touches, and takes the files of the others over as they are. What belongs to the log at a batch is
written in a *manifest* of one row per bucket, under the number of the batch.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countersign.streaming.runs import BATCH, drop, newest_per_key, numbers

VERSION = "version"
BUCKET = "bucket"
# Rows of a bucket, above which it splits when it is rewritten.
BUCKET_ROWS = 1 << 20
_PARTS = "tier int, bits int, bucket long, rows long, path string"


class Part(NamedTuple):
    """A bucket of a tier; tiers are counted from the oldest."""

    tier: int
    bits: int
    bucket: int
    rows: int
    path: str


def bits_for(rows: int, bucket_rows: int) -> int:
    """The least number of bits whose buckets hold ``bucket_rows`` each, on average."""
    return max(-(-rows // bucket_rows) - 1, 0).bit_length()


def bucket_of(key: str, bits: int) -> Column:
    """Bucket of a key, by its text. Those of more bits split those of fewer."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << bits))


def touched_buckets(keys: DataFrame, key: str, bits: int) -> list[int]:
    """Buckets that hold any of ``keys``: at most one row per bucket comes to the driver."""
    return [row[0] for row in keys.select(bucket_of(key, bits)).distinct().collect()]


def parts_of(log: str, spark: SparkSession, before: int | None = None) -> tuple[int | None, list[Part]]:
    """The newest manifest, or the newest before a batch: its number and parts."""
    known = [n for n in numbers(spark, f"{log}-manifest", VERSION) if before is None or n < before]
    if not known:
        return None, []
    rows = spark.read.schema(_PARTS).parquet(f"{log}-manifest/{VERSION}={known[-1]}").collect()
    return known[-1], sorted(Part(*row) for row in rows)


def _near(parts: list[Part], keys: DataFrame, key: str) -> list[Part]:
    """The parts that can hold one of ``keys``."""
    if not parts:
        return []
    sought = touched_buckets(keys, key, max(part.bits for part in parts))
    held = {b: {x % (1 << b) for x in sought} for b in {part.bits for part in parts}}
    return [part for part in parts if part.bucket in held[part.bits]]


def _read(spark: SparkSession, parts: Iterable[Part]) -> DataFrame | None:
    paths = [part.path for part in parts]
    return spark.read.parquet(*paths) if paths else None


def read_log(
    log: str, spark: SparkSession, before: int | None = None, *, touched: DataFrame | None = None, key: str = ""
) -> DataFrame:
    """Rows of the log with their batch numbers; the newest of a key holds.

    With ``before``, the log as it was ahead of that batch. With ``touched``, a table of keys,
    only the buckets that can hold one of them are opened.
    """
    newest, parts = parts_of(log, spark, before)
    if touched is not None:
        parts = _near(parts, touched, key)
    frames = [
        spark.read.parquet(f"{log}/{BATCH}={n}").withColumn(BATCH, F.lit(n).cast("bigint"))
        for n in numbers(spark, log, BATCH)
        if (newest is None or n > newest) and (before is None or n < before)
    ]
    tiers = _read(spark, parts)
    if tiers is not None:
        frames.insert(0, tiers)
    if not frames:
        # The empty batch that a log begins with has the columns of the others.
        return spark.read.parquet(f"{log}/{BATCH}=-1").withColumn(BATCH, F.lit(-1).cast("bigint"))
    return _union(frames)


def compact(
    log: str, spark: SparkSession, key: str, number: int, *, bucket_rows: int | None = None
) -> int:
    """Fold the batches up to ``number`` into a tier; returns the number of rows written.

    The manifest is written last, and what the one before it needs stays, so readers at work and
    a repeated batch still find their files. A repeated fold replaces itself.
    """
    bucket_rows = bucket_rows or BUCKET_ROWS
    earlier, parts = parts_of(log, spark, number)
    since = [n for n in numbers(spark, log, BATCH) if (earlier is None or n > earlier) and n <= number]
    place = f"{log}-tiers/{number}"
    fresh = newest_per_key(
        _union(spark.read.parquet(f"{log}/{BATCH}={n}").withColumn(BATCH, F.lit(n).cast("bigint")) for n in since),
        key,
        keep_batch=True,
    )
    fresh.write.mode("overwrite").parquet(f"{place}/fresh")
    fresh = spark.read.parquet(f"{place}/fresh")
    rows = written = fresh.count()
    merged, tier = [fresh], max((part.tier for part in parts), default=-1)
    kept: list[Part] = []
    while tier >= 0:
        next_tier = [part for part in parts if part.tier == tier]
        touched = _near(next_tier, _union(f.select(key) for f in merged), key)
        if touched and sum(part.rows for part in touched) > rows:
            break
        # The buckets that nothing is merged into stay where they are.
        kept += [part for part in next_tier if part not in touched]
        if touched:
            merged.append(_read(spark, touched))
            rows += sum(part.rows for part in touched)
        tier -= 1
    bits = max(bits_for(rows + sum(part.rows for part in kept), bucket_rows), *(part.bits for part in kept), 0)
    whole = newest_per_key(_union(merged), key, keep_batch=True) if len(merged) > 1 else fresh
    target = f"{place}/rows"
    spread = whole.withColumn(BUCKET, bucket_of(key, bits)).repartition(F.col(BUCKET))
    spread.write.mode("overwrite").partitionBy(BUCKET).parquet(target)
    sizes = spark.read.parquet(target).groupBy(BUCKET).count().collect() if rows else []
    tier += 1
    found = [Part(tier, bits, int(r[0]), r[1], f"{target}/{BUCKET}={r[0]}") for r in sizes]
    written += sum(part.rows for part in found)
    below = [part for part in parts if part.tier < tier]
    moved = [part._replace(tier=tier) for part in kept]
    rows_of = spark.createDataFrame([*below, *moved, *found], _PARTS)
    rows_of.coalesce(1).write.mode("overwrite").parquet(f"{log}-manifest/{VERSION}={number}")
    drop(spark, f"{place}/fresh")
    _clean(log, spark, number)
    return written


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    first, *others = frames
    for frame in others:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def _clean(log: str, spark: SparkSession, number: int) -> None:
    """Drop what neither this manifest nor the one before it needs."""
    known = [n for n in numbers(spark, f"{log}-manifest", VERSION) if n <= number]
    if len(known) < 2:
        return
    for old in known[:-2]:
        _, parts = parts_of(log, spark, old + 1)
        drop(spark, f"{log}-manifest/{VERSION}={old}")
        needed = {p.path for n in known[-2:] for p in parts_of(log, spark, n + 1)[1]}
        for part in parts:
            if part.path not in needed:
                drop(spark, part.path)
    for n in numbers(spark, log, BATCH):
        if 0 <= n <= known[-2]:
            drop(spark, f"{log}/{BATCH}={n}")


class KeyIndex:
    """The keys of a snapshot in buckets, opened only where a batch touches them."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self._spark, self._folder, self._key = spark, folder, key

    def build(self, transactions: DataFrame, bucket_rows: int | None = None) -> None:
        """Write the keys once; an index that is there already stays."""
        if numbers(self._spark, self._folder, "bits"):
            return
        rows = transactions.select(self._key)
        bits = bits_for(rows.count(), bucket_rows or BUCKET_ROWS)
        spread = rows.withColumn(BUCKET, bucket_of(self._key, bits)).repartition(F.col(BUCKET))
        spread.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self._folder}/bits={bits}")

    def near(self, keys: DataFrame) -> DataFrame:
        """The indexed keys of the buckets that hold any of ``keys``."""
        bits = numbers(self._spark, self._folder, "bits")[-1]
        place = f"{self._folder}/bits={bits}"
        there = set(numbers(self._spark, place, BUCKET, finished=False))
        paths = [f"{place}/{BUCKET}={b}" for b in touched_buckets(keys, self._key, bits) if b in there]
        if not paths:
            return keys.select(self._key).limit(0)
        return self._spark.read.parquet(*paths)
