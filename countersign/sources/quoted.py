"""CSV records with line breaks inside quotes, from files that are still read in blocks.

A line break ends a record exactly if the number of quotes before it in the file is even
(doubled quotes count as two). So a block need not know the text before it, only its *parity*:

1. One native job counts the quotes of every block, modulo 2. The prefix sum over the blocks of
   a file tells which blocks begin inside quotes.
2. Each block is cut into records where the parity is even. What begins before the block or
   ends after it is kept as a fragment: at most two per block.
3. Fragments are joined per file, in order.

Cut records are written once, so neither a lost executor nor another split of the files can
change them; both jobs run over one and the same split.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The columns that tell where a row came from.
FILE, PATH, BLOCK = "source_file", "source_path", "source_block"
# Blocks that begin inside quotes are sent to all tasks up to this number.
SENT_BLOCKS = 200_000
_WHOLE, _OPEN, _CLOSING, _MIDDLE = range(4)
_CUT = f"kind int, first boolean, value string, {FILE} string, {PATH} string, {BLOCK} bigint"
# One row group per file: a block's records are then read back by one task, in order.
_ROW_GROUP = str(1 << 30)


@contextmanager
def one_split(spark: SparkSession):
    """Files are cut alike in all jobs inside, also if executors come or go."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def _quotes() -> Column:
    """Number of quotes in a line, modulo 2."""
    return ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).cast("tinyint")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of blocks in file order to records and fragments.

    Lines come as ``value, parity, file, path, block, inside``; a block's lines follow each other.
    """
    at: tuple | None = None
    inside, opened, headed = False, False, True
    held: list[str] = []

    def rows(kinds: list[int], firsts: list[bool], values: pa.Array) -> pa.RecordBatch:
        file, path, block = at
        n = len(values)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(kinds, pa.int32()),
                pa.array(firsts, pa.bool_()),
                values,
                pa.array([file] * n, pa.string()),
                pa.array([path] * n, pa.string()),
                pa.array([block] * n, pa.int64()),
            ],
            ["kind", "first", "value", FILE, PATH, BLOCK],
        )

    def block_end() -> Iterator[pa.RecordBatch]:
        if at is not None and inside:
            text = pa.array(["\n".join(held)], pa.string())
            yield rows([_OPEN if opened else _MIDDLE], [opened and not headed], text)

    for batch in batches:
        if not batch.num_rows:
            continue
        path, block = batch.column(3), batch.column(4).to_numpy()
        places = path.dictionary_encode().indices.to_numpy()
        change = np.flatnonzero((places[1:] != places[:-1]) | (block[1:] != block[:-1])) + 1
        borders = [0, *change.tolist(), batch.num_rows]
        for i, j in zip(borders[:-1], borders[1:], strict=True):
            here = (batch.column(2)[i].as_py(), path[i].as_py(), int(block[i]))
            if here != at:
                yield from block_end()
                at, held, opened = here, [], False
                inside = bool(batch.column(5)[i].as_py())
                headed = here[2] != 0
            values = batch.column(0).slice(i, j - i)
            parity = batch.column(1).slice(i, j - i).to_numpy().astype(bool)
            after = np.logical_xor.accumulate(np.append(inside, parity))
            plain = not after.any()
            if plain and headed:
                yield rows([_WHOLE] * len(values), [False] * len(values), values)
                continue
            kinds: list[int] = []
            texts: list[str] = []
            for text, was, now in zip(values.to_pylist(), after[:-1].tolist(), after[1:].tolist(), strict=True):
                if was or now:
                    if not was:
                        held, opened = [], True
                    held.append(text)
                    if now:
                        continue
                    text = "\n".join(held)
                    held = []
                    if not opened:
                        kinds.append(_CLOSING)
                        texts.append(text)
                        continue
                if not headed and text.removeprefix("\ufeff").strip():
                    headed = True
                    continue
                kinds.append(_WHOLE)
                texts.append(text)
            inside = bool(after[-1])
            if texts:
                yield rows(kinds, [False] * len(texts), pa.array(texts, pa.string()))
    yield from block_end()


def quoted_records(
    spark: SparkSession, source: str | list[str], landing: str, options: dict[str, str], *, sent_blocks: int = SENT_BLOCKS
) -> DataFrame:
    """``value, source_file, source_path, source_block``: every record but the header of its file.

    ``landing`` is a new folder that all executors share. A record that runs beyond its block
    has the address of the next byte as its block, which keeps the order of the file. A quote that
    is never closed makes the rest of its file one record, as in any reader.
    """
    with one_split(spark):
        lines = (
            spark.read.options(lineSep="\n", **options)
            .text(source)
            .select(
                "value",
                _quotes().alias("parity"),
                F.col("_metadata.file_name").alias(FILE),
                F.col("_metadata.file_path").alias(PATH),
                F.col("_metadata.file_block_start").alias(BLOCK),
            )
        )
        before = Window.partitionBy(PATH).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        blocks = lines.groupBy(PATH, BLOCK).agg(F.bit_xor("parity").alias("parity"))
        starts = blocks.withColumn("inside", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2 == 1)
        starts.where("inside").select(PATH, BLOCK, "inside").write.parquet(f"{landing}/inside")
        inside = spark.read.parquet(f"{landing}/inside")
        if inside.count() <= sent_blocks:
            told = lines.join(F.broadcast(inside), [PATH, BLOCK], "left")
        else:
            # The order of lines is put on record before they move.
            numbered = lines.withColumn("_line", F.monotonically_increasing_id())
            told = numbered.join(inside, [PATH, BLOCK], "left").repartition(PATH, BLOCK)
            told = told.sortWithinPartitions(PATH, BLOCK, "_line")
        cut = told.select("value", "parity", FILE, PATH, BLOCK, "inside").mapInArrow(_cut, _CUT)
        cut.write.option("parquet.block.size", _ROW_GROUP).parquet(f"{landing}/records")
    records = spark.read.schema(_CUT).parquet(f"{landing}/records")
    # As Spark's own reader of such files does, line breaks of two signs become one.
    kept = [F.regexp_replace("value", "\r(?=\n|$)", "").alias("value"), FILE, PATH, BLOCK]
    whole = records.where(F.col("kind") == _WHOLE).select(*kept)
    tail = (F.col("kind") == _OPEN).cast("int")
    order = Window.partitionBy(PATH).orderBy(BLOCK, tail)
    parts = records.where(F.col("kind") != _WHOLE).withColumn("_record", F.sum(tail).over(order))
    pieces = F.sort_array(F.collect_list(F.struct(F.col(BLOCK), tail.alias("tail"), F.col("value"))))
    joined = parts.groupBy(PATH, FILE, "_record").agg(
        F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("value"),
        (F.min(BLOCK) + 1).alias(BLOCK),
        F.bool_or("first").alias("first"),
    )
    return whole.unionByName(joined.where(~F.col("first")).select(*kept))
