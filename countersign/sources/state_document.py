"""All of the review state as one JSON document, read and written by many tasks.

Reading: a document may be a single line, so it is cut at commas. A comma ends an entry of the
outer object exactly if it stands outside quotes at depth one. What a block of the file adds to
both is known without the text before it, given whether it begins inside quotes; so one job
sums up every block for both cases, prefix sums over the blocks tell how each of them begins, and
a second job cuts the blocks. Entries that run over the end of a block are joined from pieces.

Writing: entries are range-sorted by their id, and each knows from the least and the greatest id
whether it opens or closes the document. The parts, in the order of their names, are the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countersign.rules import ReviewRules
from countersign.sources.quoted import one_split
from countersign.sources.state_json import parse_state, state_lines

_SENT_BLOCKS = 200_000
_PIECES = "path string, block bigint, tail boolean, whole boolean, value string"
# One row group per file: what a task has cut is read back by one task.
_ROW_GROUP = str(1 << 30)


def _depth(segments: str, odd: int) -> Column:
    """What the text outside quotes adds to the depth, if segment ``odd`` is the first outside."""
    count = lambda signs: f"(length(s) - length(translate(s, '{signs}', '')))"
    change = f"{count('{[')} - {count('}]')}"
    outside = f"filter({segments}, (s, i) -> i % 2 = {odd})"
    return F.expr(f"aggregate(transform({outside}, s -> {change}), 0, (a, x) -> a + x)")


def _tokens(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """The text between commas, with the number of quotes and both depth changes."""
    tokens = spark.read.options(lineSep=",").text(source).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"').alias("segments"),
    )
    return tokens.select(
        "value", "path", "block", (F.size("segments") - 1).alias("quotes"),
        _depth("segments", 0).alias("even"), _depth("segments", 1).alias("odd"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Ranges of rows of one block."""
    block = batch.column("block").to_numpy()
    place = batch.column("path").dictionary_encode().indices.to_numpy()
    change = np.flatnonzero((place[1:] != place[:-1]) | (block[1:] != block[:-1])) + 1
    borders = [0, *change.tolist(), batch.num_rows]
    return zip(borders[:-1], borders[1:], strict=True)


def _inside(quotes: np.ndarray, first: bool) -> np.ndarray:
    """Before each token and after the last: inside quotes?"""
    return np.logical_xor.accumulate(np.append(first, quotes % 2 == 1))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of rows: parity, and the depth it adds if it begins outside or inside quotes."""
    for batch in batches:
        for i, j in _runs(batch) if batch.num_rows else ():
            quotes, even, odd = (batch.column(c).slice(i, j - i).to_numpy() for c in ("quotes", "even", "odd"))
            within = _inside(quotes, False)
            yield pa.RecordBatch.from_pydict(
                {
                    "path": [batch.column("path")[i].as_py()],
                    "block": [batch.column("block")[i].as_py()],
                    "seq": [batch.column("seq")[i].as_py()],
                    "parity": [int(within[-1])],
                    "outside": [int(np.where(within[:-1], odd, even).sum())],
                    "inside": [int(np.where(within[:-1], even, odd).sum())],
                }
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the outer object and, of each block, the pieces before its first and after its last cut."""
    at, inside, depth, opened = None, False, 0, False
    held: list[str] = []

    def rows(texts: list[str | None], tail: bool, whole: bool) -> pa.RecordBatch:
        n = len(texts)
        columns = [pa.array([x] * n, t) for x, t in ((at[0], pa.string()), (at[1], pa.int64()), (tail, pa.bool_()), (whole, pa.bool_()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], ["path", "block", "tail", "whole", "value"])

    def block_end() -> Iterator[pa.RecordBatch]:
        """What is left after the last cut; NULL tells that the block ended with a cut."""
        if at is not None and (held or opened):
            yield rows([",".join(held) if held else None], opened, False)

    for batch in batches:
        for i, j in _runs(batch) if batch.num_rows else ():
            here = (batch.column("path")[i].as_py(), batch.column("block")[i].as_py())
            if here != at:
                yield from block_end()
                at, held, opened = here, [], False
                inside = batch.column("begins_inside")[i].as_py()
                depth = batch.column("begins_at")[i].as_py()
            values = batch.column("value").slice(i, j - i).to_pylist()
            quotes, even, odd = (batch.column(c).slice(i, j - i).to_numpy() for c in ("quotes", "even", "odd"))
            within = _inside(quotes, inside)
            depths = depth + np.cumsum(np.where(within[:-1], odd, even))
            # The braces of the outer object are no part of an entry.
            closed = np.flatnonzero((depths == 0) & ~within[1:])
            for n in closed[:1].tolist():
                values[n] = values[n].rstrip().removesuffix("}")
            if depth == 0 and not inside:
                values[0] = values[0].lstrip("\ufeff \t\r\n").removeprefix("{")
            cuts = np.flatnonzero(~within[1:] & (depths == 1)) + 1
            inside, depth = bool(within[-1]), int(depths[-1])
            entries, first = [], 0
            for cut in cuts.tolist():
                text = ",".join([*held, *values[first:cut]])
                held, first = [], cut
                if opened:
                    entries.append(text)
                else:
                    yield rows([text], False, False)
                    opened = True
            held += values[first:]
            if entries:
                yield rows(entries, False, True)
    yield from block_end()


def read_state_document(
    spark: SparkSession, source: str | list[str], landing: str, *, in_parts: bool = False
) -> DataFrame:
    """Documents as the long table of :func:`parse_state`; the blocks of a file are tasks of their own.

    Every file of ``source`` is one JSON object of all transactions; with ``in_parts``, the files in
    the order of their paths are one object, broken between entries, as
    :func:`save_state_document` writes it. ``landing`` is a new folder that all executors share. An
    entry that is no JSON stands for one without labels. Entries are parsed one by one, so of a
    transaction that comes twice in a document both are returned; repeated reviewers of one
    entry are resolved as in :func:`parse_state`.
    """
    whose = [] if in_parts else ["path"]
    with one_split(spark):
        tokens = _tokens(spark, source)
        numbered = tokens.withColumn("seq", F.monotonically_increasing_id())
        sums = numbered.select("path", "block", "seq", "quotes", "even", "odd").mapInArrow(
            _summed, "path string, block bigint, seq bigint, parity bigint, outside bigint, inside bigint"
        )
        sums.write.parquet(f"{landing}/sums")
        order = Window.partitionBy(*whose).orderBy("path", "block", "seq").rowsBetween(Window.unboundedPreceding, -1)
        sums = spark.read.parquet(f"{landing}/sums")
        states = sums.withColumn("begins_inside", F.coalesce(F.sum("parity").over(order), F.lit(0)) % 2 == 1)
        added = F.when(F.col("begins_inside"), F.col("inside")).otherwise(F.col("outside"))
        states = states.withColumn("added", added).withColumn(
            "begins_at", F.coalesce(F.sum("added").over(order), F.lit(0)).cast("int")
        )
        blocks = states.groupBy("path", "block").agg(
            F.min_by("begins_inside", "seq").alias("begins_inside"), F.min_by("begins_at", "seq").alias("begins_at")
        )
        blocks.write.parquet(f"{landing}/blocks")
        blocks = spark.read.parquet(f"{landing}/blocks")
        if blocks.count() <= _SENT_BLOCKS:
            told = tokens.join(F.broadcast(blocks), ["path", "block"])
        else:
            told = numbered.join(blocks, ["path", "block"]).repartition("path", "block").sortWithinPartitions("path", "block", "seq").drop("seq")
        pieces = told.select("value", "path", "block", "quotes", "even", "odd", "begins_inside", "begins_at")
        pieces.mapInArrow(_cut, _PIECES).write.option("parquet.block.size", _ROW_GROUP).parquet(f"{landing}/pieces")
    pieces = spark.read.schema(_PIECES).parquet(f"{landing}/pieces")
    order = Window.partitionBy(*whose).orderBy("path", "block", "tail")
    parts = pieces.where("not whole").withColumn("entry", F.sum(F.col("tail").cast("int")).over(order))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "block", "tail", "value"))), lambda p: p["value"]), ",")
    joined = parts.groupBy(*whose, "entry").agg(text.alias("value")).select("value")
    entries = pieces.where("whole").select("value").union(joined)
    return parse_state(entries.select(F.concat(F.lit("{"), F.coalesce("value", F.lit("")), F.lit("}")).alias("value")))


def save_state_document(
    latest: DataFrame, path: str, key: str = "tx_id", rules: ReviewRules | None = None, *, parts: int | None = None
) -> DataFrame:
    """Replace the document at ``path``; returns ``part, offset, bytes`` of its files.

    Transactions are in the order of their ids as texts, one per line. The files joined in the
    order of their names are the document; ``offset`` tells where each of them begins in it.
    """
    spark = latest.sparkSession
    lines = state_lines(latest, key, rules).select(
        F.col(key).cast("string").alias("id"), F.expr("substring(value, 2, length(value) - 2)").alias("entry")
    )
    ends = lines.agg(F.min("id").alias("first"), F.max("id").alias("last")).first()
    if ends.first is None:
        framed = spark.range(1).select(F.lit("{}").alias("value"))
    else:
        opening = F.when(F.col("id") == ends.first, F.lit("{")).otherwise(F.lit(","))
        closing = F.when(F.col("id") == ends.last, F.lit("}")).otherwise(F.lit(""))
        count = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = lines.repartitionByRange(count, "id").sortWithinPartitions("id")
        framed = ordered.select(F.concat(opening, "entry", closing).alias("value"))
    framed.write.mode("overwrite").text(path)
    files = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_name").alias("part"), F.col("length").alias("bytes")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"), "bytes")
