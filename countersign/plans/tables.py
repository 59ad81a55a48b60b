"""The benchmark tables seen as ledgers and labels."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countersign.functions import transaction_id
from countersign.rules import ReviewRules
from countersign.sources.ledgers import files_below

RULES = ReviewRules.of("A", "B")
# The label domain without its last entry, so that some labels are rejected.
NARROW_RULES = ReviewRules.of("A", "B", unsure=False)
VIEWER = "A"
KEY = "row_idx"
CSV_DATE = "2024-01-30"
GATE_CLOSED = datetime(2024, 1, 30, 23, 59, 59, tzinfo=timezone.utc)
GATE_OPEN = datetime(2024, 1, 31, tzinfo=timezone.utc)
ORDERS_AS_OF = datetime(2001, 8, 1, 12, tzinfo=timezone.utc)
# A second before midnight, midnight, and after the last order.
TICKS = (
    datetime(1997, 12, 31, 23, 59, 59, tzinfo=timezone.utc),
    datetime(1998, 1, 1, tzinfo=timezone.utc),
    datetime(2002, 1, 1, tzinfo=timezone.utc),
)
EDITED_AT = datetime(2030, 1, 1, tzinfo=timezone.utc)
MERGE_SPLIT = datetime(2024, 1, 16, tzinfo=timezone.utc)
FORWARD_HEADER = ("Date", "Amount", "Description", "Owner")
SHUFFLED_HEADER = ("Amount", "Owner", "Date", "Description")

# Event type -> label.
LABEL_OF_EVENT = {
    "click": "A",
    "view": "B",
    "purchase": "Split",
    "signup": "Other",
    "error": "Unsure",
}


@contextmanager
def block_size(spark: SparkSession, size: int):
    """Files read inside are cut into blocks of ``size`` bytes."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/orders.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def _day(ts: str) -> Column:
    return F.col(ts).cast("date").cast("string")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """``row_idx, tx_id, date, amount, description`` from ``orders``."""
    day = _day("o_orderdate")
    return orders(spark, folder).select(
        F.col("o_orderkey").alias(KEY),
        transaction_id(day, F.col("o_orderkey")).alias("tx_id"),
        day.alias("date"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("description"),
    )


def as_submissions(rows: DataFrame) -> DataFrame:
    """``row_idx, reviewer, assignment, ts, seq`` from ``events``, table or stream."""
    user = F.col("user_id")
    reviewer = (
        F.when(user % 5 == 4, F.lit("guest"))
        .when(user % 2 == 0, F.lit("A"))
        .otherwise(F.lit("B"))
    )
    return submissions_by(rows, reviewer)


def submissions_by(rows: DataFrame, reviewer: Column) -> DataFrame:
    """Labels from ``events``, given by ``reviewer``."""
    pairs = [F.lit(text) for pair in LABEL_OF_EVENT.items() for text in pair]
    return rows.select(
        F.expr("7 * (event_id div 4)").alias(KEY),
        reviewer.alias("reviewer"),
        F.create_map(*pairs)[F.col("event_type")].alias("assignment"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    return as_submissions(events(spark, folder))


def _spoilt_amount(two: Column, key: Column) -> Column:
    """Two-decimal text, bent in a different way for each ``key % 8``."""
    kind = key % 8
    before = F.when(kind == 2, F.lit("$")).when(kind == 4, F.lit(" ")).otherwise(F.lit(""))
    after = F.when(kind == 1, F.lit("abc")).when(kind == 5, F.lit("e-2")).otherwise(F.lit(""))
    body = F.when(kind == 3, F.overlay(two, F.lit(","), F.lit(2), F.lit(0))).otherwise(
        F.replace(two, F.when(kind == 5, F.lit(".")).otherwise(F.lit("")), F.lit(""))
    )
    return F.when(kind == 0, F.lit("")).otherwise(F.concat(before, body, after))


def raw_ledger(spark: SparkSession, folder: str, *, spoilt: bool = True) -> DataFrame:
    """``orders`` as a ledger: ``row_key``, ``upload`` and the four text columns."""
    key = F.col("o_orderkey")
    two = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    description = F.col("o_orderpriority")
    owner = F.lit("Unknown")
    if spoilt:
        description = F.when(key % 5 == 0, F.lit("")).otherwise(description)
        owner = F.when(key % 3 == 0, F.lit("")).otherwise(owner)
    return orders(spark, folder).select(
        key.alias("row_key"),
        F.year("o_orderdate").cast("string").alias("upload"),
        _day("o_orderdate").alias("Date"),
        (_spoilt_amount(two, key) if spoilt else two).alias("Amount"),
        description.alias("Description"),
        owner.alias("Owner"),
    )


def write_uploads(raw: DataFrame, folder: str, *, two_headers: bool) -> str:
    """Write one CSV file per upload, as an export is, rows in key order.

    With ``two_headers``, odd years get their columns in another order.
    """
    odd = F.substring("upload", 4, 1).cast("int") % 2 == 1
    parts = [(raw, FORWARD_HEADER, "one")]
    if two_headers:
        parts = [
            (raw.where(~odd), FORWARD_HEADER, "even"),
            (raw.where(odd), SHUFFLED_HEADER, "odd"),
        ]
    for rows, header, name in parts:
        (
            rows.select("upload", "row_key", *header)
            .repartition("upload")
            .sortWithinPartitions("upload", "row_key")
            .select("upload", *header)
            .write.partitionBy("upload")
            .option("header", "true")
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", "false")
            .option("ignoreTrailingWhiteSpace", "false")
            .csv(f"{folder}/{name}")
        )
    return folder


def with_line_breaks(raw: DataFrame) -> DataFrame:
    """Descriptions over several lines, with quotes and separators among them, for half the rows."""
    kind, text = F.col("row_key") % 6, F.col("Description")
    long = F.concat(text, F.repeat(F.lit("\nmore, \"quoted\""), (F.col("row_key") % 7).cast("int")))
    broken = (
        F.when(kind == 0, F.concat(text, F.lit("\n\nlast line")))
        .when(kind == 2, F.concat(F.lit("said \"yes\",\n"), text))
        .when(kind == 4, F.concat(long, F.lit(".")))
        .otherwise(text)
    )
    return raw.withColumn("Description", broken)


def several_blocks(spark: SparkSession, inbox: str) -> int:
    """A block size at which the larger ones of the files below ``inbox`` take two or three blocks."""
    largest = files_below(spark, inbox).agg(F.max("size")).first()[0]
    return max(1 << 10, -(-largest * 2 // 5))


def upload_of(path: Column) -> Column:
    """The upload a file written by :func:`write_uploads` belongs to."""
    return F.regexp_extract(path, r"/upload=([^/]+)/", 1)
