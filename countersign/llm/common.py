"""Helpers shared by the corpus operators: tables, words as arrays, prefix sums, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word contracts, in Java's and in Python's pattern syntax.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_SLICE_BYTES = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.Generator(np.random.PCG64(20240601))
_LETTER = _random.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_LETTER[_SPACE] = 0
_LETTER_LOWER = _LETTER[_LOWER]


def breaks(*ranges: tuple[int, int]) -> np.ndarray:
    """Bytes that end a word, given as ranges with both ends; blanks must be among them."""
    out = np.zeros(256, bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


_STEP = int(_random.integers(1, 2**63)) * 2 + 1
_PLACES = _random.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)


#: Rows that go to a Python worker at once; texts may be long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """Hand texts to Python workers in batches of few rows, unless the session says how many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) >= 10_000:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the corpus."""
    return small_batches(spark).read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words, 0 for NULL; built-in functions only."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of ``spark.checkpoint.dir``, which all executors share."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what the owner of
    the session has given to ``setCheckpointDir``. There is no other."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and compressed."""
    place = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def prefix_sums(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each row in the given total order.

    Rows are range-sorted and cut into parts; only one sum per part meets in one task, and the
    parts are as many as the shuffle has partitions. The sums do not depend on where parts
    begin. The sorted rows are checkpointed, so a part that is computed again stays as it was.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = checkpointed(
        df.withColumn("_value", value)
        .repartitionByRange(parts, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    sums = ordered.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ordered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_part", "_value", "_offset")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the pairs (a, b): one row (node, root) per node, root the least.

    Alternates the large-star and small-star steps on pairs until they no longer change. A step
    takes a minimum per node, combined before the shuffle, and joins it back, so a node with
    very many partners is no group in one task: Spark splits its join partitions.
    """
    pairs = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    state = None
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select("b", "m").union(lowest.select("a", "m")).toDF("a", "b")
        pairs = checkpointed(small.where("a <> b").distinct())
        seen = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Which of ``2 ** bits`` places the values of the column ``key`` (its low bits) fall on, as bits.

    Its size is fixed by ``bits``, whatever the number of keys: it may be sent to all tasks. It
    comes in slices of 1 MB, so that only the result itself is held as a whole.
    """
    out = np.zeros(max(1 << bits >> 3, 4096), np.uint8)
    place = keys.select((F.col("key").cast("long").bitwiseAND(F.lit((1 << bits) - 1))).alias("p"))
    pages = place.groupBy(F.expr("p div 32768").alias("page")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits"))
    pages = written(pages, "bitmap")
    for low in range(0, len(out) >> 12, 256):
        found = pages.where(F.col("page").between(low, low + 255)).toArrow()
        for page, data in zip(found.column("page").to_pylist(), found.column("bits").to_pylist(), strict=True):
            out[page << 12 : (page << 12) + len(data)] = np.frombuffer(data, np.uint8)
    return out


def in_bitmap(keys: np.ndarray, held: np.ndarray, bits: int) -> np.ndarray:
    place = keys.astype(np.uint64) & np.uint64((1 << bits) - 1)
    return (held[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins; NULL is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = _SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text (or binary), so that arrays over bytes stay small.

    A single longer text is a piece of its own.
    """
    if not batch.num_rows:
        return
    lengths = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + len(lengths) + 1]
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


class Words:
    """Words of several texts as arrays: ``hash`` (64 bit, A-Z in lower case), ``doc``, ``first``
    (place of each document's first word) and byte ranges ``begin``, ``end`` in ``data``."""

    _powers = np.zeros(0, np.uint64)
    _inverse = np.zeros(0, np.uint64)

    @classmethod
    def _grown(cls, n: int) -> None:
        if len(cls._powers) < n:
            step = np.full(n, _STEP, np.uint64)
            step[0] = 1
            cls._powers = np.multiply.accumulate(step)
            back = np.full(n, pow(_STEP, -1, 2**64), np.uint64)
            back[0] = 1
            cls._inverse = np.multiply.accumulate(back)

    def __init__(self, texts: pa.Array, outside: np.ndarray = _SPACE):
        data, offsets = utf8(texts)
        n = len(data)
        self.data, self.offsets, self.docs = data, offsets, len(texts)
        inside = ~outside[data]
        starts_text = np.zeros(n + 1, bool)
        starts_text[offsets] = True
        begins = inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | starts_text[1:n]
        ends = inside.copy()
        if n:
            ends[:-1] &= ~inside[1:] | starts_text[1:n]
        self.begin = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self._grown(max(n, 1))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER_LOWER[data] * self._powers[:n], out=total[1:])
        raw = (total[self.end] - total[self.begin]) * self._inverse[self.begin]
        self.hash = mixed(raw + (self.end - self.begin).astype(np.uint64) * _PLACES[63])
        self.first = np.searchsorted(self.begin, offsets)
        self.doc = np.repeat(np.arange(self.docs), np.diff(self.first))

    def shingles(self, size: int) -> Iterator[np.ndarray]:
        """Per document its distinct runs of ``size`` words as sorted hashes.

        A document with fewer words has its whole sequence as one; without words, none.
        """
        count = len(self.hash)
        whole = np.zeros(max(count - size + 1, 0), np.uint64)
        for i in range(size):
            whole += self.hash[i : i + len(whole)] * _PLACES[i]
        whole = mixed(whole)
        for d in range(self.docs):
            a, b = self.first[d], self.first[d + 1]
            if b - a >= size:
                yield np.unique(whole[a : b - size + 1])
            elif b > a:
                one = (self.hash[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mixed(np.array([one], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def word_hash(word: str) -> int:
    """The hash that ``Words`` gives to one word."""
    return int(Words(pa.array([word])).hash[0])
