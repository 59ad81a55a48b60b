"""Stored batches of transactions: replace, stamp, pick the newest."""

from __future__ import annotations

import uuid
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countersign.functions import batch_day, instant

_POINTERS = "published"


def replace_snapshot(transactions: DataFrame, path: str) -> None:
    """A new upload replaces all transactions. For folders nobody reads meanwhile;
    :func:`publish_snapshot` leaves readers their rows."""
    transactions.write.mode("overwrite").parquet(path)


def publish_snapshot(transactions: DataFrame, folder: str, *, keep: int = 2) -> int:
    """A new upload replaces all transactions while others read them; returns its number.

    The rows go to a folder of their own. Then a pointer of the next number is created, only if no
    other writer has put one there: who comes second takes the number after it. A reader that
    has begun goes on with the rows it has found; the ``keep`` newest snapshots are not deleted.
    """
    spark = transactions.sparkSession
    rows = f"rows-{uuid.uuid4().hex}"
    transactions.write.parquet(f"{folder}/{rows}")
    store, path = hadoop_folder(spark, f"{folder}/{_POINTERS}")
    store.mkdirs(path)
    number = max(_pointers(spark, folder), default=-1) + 1
    while not _put_if_absent(spark, f"{folder}/{_POINTERS}/{number:012d}", rows):
        number += 1
    for old in _pointers(spark, folder)[:-keep]:
        target = f"{folder}/{_pointed(spark, folder, old)}"
        # The pointer goes first, so that none is left without its rows.
        for name in (f"{folder}/{_POINTERS}/{old:012d}", target):
            store, path = hadoop_folder(spark, name)
            store.delete(path, True)
    return number


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The transactions published last, as they are at the time of the call."""
    known = _pointers(spark, folder)
    if not known:
        raise ValueError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder}/{_pointed(spark, folder, known[-1])}")


def hadoop_folder(spark: SparkSession, folder: str):
    """A folder's file system and path, as Spark itself sees them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _put_if_absent(spark: SparkSession, name: str, text: str) -> bool:
    """Create a file whole, or not at all: written aside, then renamed to a name that is free."""
    store, path = hadoop_folder(spark, name)
    if store.exists(path):
        return False
    _, aside = hadoop_folder(spark, f"{name}.{uuid.uuid4().hex}.tmp")
    out = store.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    # A rename does not replace a file: the second of two writers is refused.
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        path.toUri(), spark._jsc.hadoopConfiguration()
    )
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(aside, path, options)
    except Py4JJavaError:
        store.delete(aside, False)
        if not store.exists(path):
            raise
        return False
    return True


def _pointers(spark: SparkSession, folder: str) -> list[int]:
    store, path = hadoop_folder(spark, f"{folder}/{_POINTERS}")
    if not store.exists(path):
        return []
    names = [part.getPath().getName() for part in store.listStatus(path)]
    return sorted(int(name) for name in names if name.isdigit())


def _pointed(spark: SparkSession, folder: str, number: int) -> str:
    return spark.read.text(f"{folder}/{_POINTERS}/{number:012d}").first()[0]


def append_submissions(submissions: DataFrame, path: str) -> None:
    """Add labels to the stored ones."""
    submissions.write.mode("append").parquet(path)


def save_bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> None:
    """Replace ``table``, hashed by ``key``, one file per bucket.

    For tables with few rows per key: transactions, latest labels, review state.
    Saved with the same key and bucket count they join without moving a row. A
    raw label log is no such table: a bucket is read by one task, and a
    transaction that holds a third of all labels would be all its own.
    """
    placed = rows.repartition(buckets, key)
    placed.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def stamp_batch(transactions: DataFrame, uploaded_at: datetime | Column) -> DataFrame:
    """Record the UTC day of the upload with every row of the batch."""
    moment = instant(uploaded_at) if isinstance(uploaded_at, datetime) else uploaded_at
    return transactions.withColumn("csv_date", batch_day(moment))


def upload_id(uploaded_at: Column, path: Column) -> Column:
    """A name of an upload that sorts by its time; files of one moment differ by path."""
    moment = F.date_format(uploaded_at, "yyyyMMdd'T'HHmmssSSSSSS")
    return F.concat_ws("-", moment, F.substring(F.sha2(path, 256), 1, 12))


def latest_snapshot(history: DataFrame, batch: str = "upload_id") -> DataFrame:
    """Rows of the greatest ``batch``, by default those of the newest upload.

    The greatest value is a scalar subquery, so on a table partitioned by
    ``batch`` only the newest partition is read.
    """
    newest = history.agg(F.max(batch)).scalar()
    return history.where(F.col(batch) == newest)
