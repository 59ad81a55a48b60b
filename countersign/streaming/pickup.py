"""Daily ledger files, picked up as they appear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countersign.functions import batch_day
from countersign.operators.transactions import required_fields, transaction_fields, with_tx_id
from countersign.sources.ledgers import LEDGER_COLUMNS, SOURCE_PATH, files_below, read_ledger
from countersign.sources.positions import with_row_position
from countersign.sources.snapshots import upload_id
from countersign.streaming.runs import parts_named

HISTORY = "history"
UPLOADS = "uploads"
UPLOAD_ID = "upload_id"
_UPLOADS = f"{UPLOAD_ID} string, {SOURCE_PATH} string, uploaded_at timestamp, size bigint"
_HISTORY = (
    "row_idx bigint, tx_id string, date string, amount double, description string, "
    f"source_file string, {SOURCE_PATH} string, source_block bigint, uploaded_at timestamp, "
    f"csv_date string, {UPLOAD_ID} string"
)


def new_uploads(spark: SparkSession, inbox: str, folder: str) -> DataFrame:
    """Files below ``inbox`` that no run has taken yet.

    A file is known by its path and time of change: the daily export that
    replaces yesterday's under the same name is a new upload.
    """
    listed = files_below(spark, inbox).withColumn(
        UPLOAD_ID, upload_id(F.col("uploaded_at"), F.col(SOURCE_PATH))
    )
    known = read_uploads(spark, folder).select(UPLOAD_ID)
    return listed.join(known, UPLOAD_ID, "left_anti")


def run_daily_pickup(
    spark: SparkSession,
    inbox: str,
    folder: str,
    *,
    owner: bool = False,
    columns: tuple[str, ...] = LEDGER_COLUMNS,
    delimiter: str = ",",
) -> int:
    """Turn every upload that is new since the last run into stamped transactions.

    Returns how many there were. ``folder`` must be shared by all executors.
    Rows are numbered per file, in file order, and stored in the history by
    upload, so a run that failed halfway and is repeated replaces what it had
    written; uploads count as taken once their rows are stored. Only one run may
    work on a folder at a time.
    """
    log = f"{folder}/{UPLOADS}"
    spark.createDataFrame([], _UPLOADS).write.mode("ignore").parquet(log)
    found = new_uploads(spark, inbox, folder)
    taken = found.select(UPLOAD_ID, SOURCE_PATH, "uploaded_at", "size").collect()
    if not taken:
        return 0
    uploads = spark.createDataFrame(taken, _UPLOADS)
    paths = [row[SOURCE_PATH] for row in taken]
    raw = read_ledger(spark, paths, columns=columns, delimiter=delimiter, listed=True)
    placed = with_row_position(required_fields(raw), f"{folder}/landing")
    named = placed.join(F.broadcast(uploads.drop("size")), SOURCE_PATH)
    transactions = with_tx_id(transaction_fields(named, owner=owner))
    stamped = transactions.withColumn("csv_date", batch_day(F.col("uploaded_at")))
    (
        stamped.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(UPLOAD_ID)
        .parquet(f"{folder}/{HISTORY}")
    )
    uploads.write.mode("append").parquet(log)
    return len(taken)


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """``upload_id, source_path, uploaded_at, size`` of all uploads taken so far."""
    log = f"{folder}/{UPLOADS}"
    spark.createDataFrame([], _UPLOADS).write.mode("ignore").parquet(log)
    return spark.read.schema(_UPLOADS).parquet(log)


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    """The transactions of all uploads; no rows before the first one that has any."""
    history = f"{folder}/{HISTORY}"
    if not parts_named(spark, history, UPLOAD_ID):
        return spark.createDataFrame([], _HISTORY)
    return spark.read.parquet(history)


def current_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The transactions of the newest upload: it replaces all before it.

    Which one is the newest tells the log of uploads, so an upload without a valid row empties the
    snapshot. The history is partitioned by upload, so only that partition is read.
    """
    newest = read_uploads(spark, folder).agg(F.max(UPLOAD_ID)).scalar()
    return read_history(spark, folder).where(F.col(UPLOAD_ID) == newest)
