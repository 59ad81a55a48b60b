"""File to transactions, in one call."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from countersign.operators import required_fields, transaction_fields, with_tx_id
from countersign.sources import read_ledger, scratch_folder, stamp_batch, with_row_position


def load_transactions(
    spark: SparkSession,
    source: str | list[str],
    uploaded_at: datetime,
    *,
    landing: str | None = None,
    owner: bool = False,
    **scan,
) -> DataFrame:
    """Scan, drop incomplete rows, number, convert and stamp an upload.

    An upload is one ledger: if ``source`` holds several files, they are its
    parts in order of their paths, and ids stay unique. ``scan`` are options of
    :func:`countersign.sources.read_ledger`. The rows are written once to
    ``landing``, a folder all executors share.
    """
    raw = required_fields(read_ledger(spark, source, **scan))
    folder = landing or scratch_folder(spark, "landing")
    placed = with_row_position(raw, folder, across_files=True)
    return stamp_batch(with_tx_id(transaction_fields(placed, owner=owner)), uploaded_at)
