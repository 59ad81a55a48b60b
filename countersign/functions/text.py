"""Text expressions: missing values, defaults, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(text: Column) -> Column:
    """``text``, with the empty string turned into NULL. A blank is kept."""
    return F.nullif(text, F.lit(""))


def is_filled(text: Column) -> Column:
    """True for any text but NULL and the empty string; never NULL.

    Two plain comparisons, which a scan can take over as a pushed filter.
    """
    return text.isNotNull() & (text != F.lit(""))


def or_default(text: Column, default: str) -> Column:
    """``text``, or ``default`` where it is NULL or empty."""
    return F.coalesce(filled(text), F.lit(default))


def transaction_id(date: Column, row_idx: Column) -> Column:
    """``<date>-<position in the file>``."""
    return F.concat(date, F.lit("-"), row_idx.cast("string"))
