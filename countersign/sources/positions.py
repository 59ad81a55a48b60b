"""Row numbers in file order, without sorting or shuffling the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countersign.sources.ledgers import SOURCE_BLOCK, SOURCE_PATH

# A table of block offsets up to this size is broadcast; a larger one is joined
# by shuffle.
BROADCAST_OFFSETS_BYTES = 32 * 1024 * 1024
_BYTES_PER_OFFSET = 64
_SALTS = 16


def with_row_position(
    rows: DataFrame,
    landing: str,
    *,
    position: str = "row_idx",
    across_files: bool = False,
    broadcast_up_to: int = BROADCAST_OFFSETS_BYTES,
) -> DataFrame:
    """Add the zero-based place of each row within its file.

    With ``across_files`` the files count as parts of one, in order of their
    paths, and the numbers go on from one to the next.

    ``rows`` come from a scan that kept ``source_path`` and ``source_block``;
    rows filtered out before do not count. They are written once to
    ``landing``, numbered as they stream by: one task reads a block from start
    to end, so the numbers of a block's rows are consecutive. What a block
    lacks is the number of rows before it, and that follows from the row counts
    per block, a table with one line per block of input. The written rows fix
    the numbers: a lost executor, or a cluster that grows between two scans and
    so cuts the files differently, cannot change them.
    """
    spark = rows.sparkSession
    numbered = rows.withColumn("_seq", F.monotonically_increasing_id())
    numbered.write.mode("overwrite").parquet(f"{landing}/rows")
    landed = spark.read.parquet(f"{landing}/rows")

    counts = landed.groupBy(SOURCE_PATH, SOURCE_BLOCK).agg(
        F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    shift = F.col("_before") - F.col("_first")
    within = counts.withColumn("_before", _sum_before("_rows", SOURCE_BLOCK, SOURCE_PATH))
    if across_files:
        totals = counts.groupBy(SOURCE_PATH).agg(F.sum("_rows").alias("_total"))
        starts = totals.select(SOURCE_PATH, _sum_before("_total", SOURCE_PATH).alias("_start"))
        within = within.join(starts, SOURCE_PATH)
        shift = shift + F.col("_start")
    within.select(SOURCE_PATH, SOURCE_BLOCK, shift.alias("_shift")).write.mode(
        "overwrite"
    ).parquet(f"{landing}/offsets")
    offsets = spark.read.parquet(f"{landing}/offsets")

    size = offsets.agg(
        F.coalesce(F.sum(F.length(SOURCE_PATH) + F.lit(_BYTES_PER_OFFSET)), F.lit(0))
    ).head()[0]
    keys = [SOURCE_PATH, SOURCE_BLOCK]
    if size <= broadcast_up_to:
        offsets = F.broadcast(offsets)
    else:
        # The rows of a block, or of a file that cannot be cut, share a key; salts
        # deal them to several tasks.
        salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
        offsets = offsets.withColumn("_salt", salts)
        landed = landed.withColumn("_salt", (F.col("_seq") % _SALTS).cast("int"))
        keys.append("_salt")
    placed = landed.join(offsets, keys)
    return placed.select(
        *rows.columns, (F.col("_seq") + F.col("_shift")).cast("bigint").alias(position)
    )


def _sum_before(count: str, order: str, *within: str) -> Column:
    """Sum of ``count`` over the earlier rows. Without ``within`` this runs in
    one task; it is meant for one row per block or per file, not for data."""
    window = Window.partitionBy(*within).orderBy(order)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(earlier), F.lit(0))
