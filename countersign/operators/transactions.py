"""Raw ledger rows -> transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countersign.functions import is_filled, leading_number, or_default, transaction_id

# Texts that stand in for missing fields.
DEFAULT_DESCRIPTION = "Unknown"
DEFAULT_OWNER = "Unassigned"


def required_fields(raw: DataFrame) -> DataFrame:
    """Rows whose Date and Amount are not empty; ``0`` and a blank pass."""
    return raw.where(is_filled(F.col("Date")) & is_filled(F.col("Amount")))


def transaction_fields(raw: DataFrame, *, owner: bool = False) -> DataFrame:
    """Header names to field names, amount to number, defaults for texts.

    Columns that are no ledger field, such as the position, stay.
    """
    ledger = {"Date", "Amount", "Description", "Owner"}
    kept = [c for c in raw.columns if c not in ledger]
    fields = [
        F.col("Date").alias("date"),
        leading_number(F.col("Amount")).alias("amount"),
        or_default(F.col("Description"), DEFAULT_DESCRIPTION).alias("description"),
    ]
    if owner:
        fields.append(or_default(F.col("Owner"), DEFAULT_OWNER).alias("owner"))
    return raw.select(*kept, *fields)


def with_tx_id(rows: DataFrame) -> DataFrame:
    """Add ``tx_id`` from ``date`` and ``row_idx``.

    Ids are positional on purpose: a row of a new file with the same date at
    the same place inherits the labels given to the old one.
    """
    return rows.withColumn("tx_id", transaction_id(F.col("date"), F.col("row_idx")))


def is_empty(transactions: DataFrame) -> bool:
    """No transactions yet: ask for an upload instead of showing zeros."""
    return transactions.isEmpty()
