"""Time expressions. The clock is always an argument, never read in a query."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_MILLIS_PER_HOUR = 3_600_000.0
# The two forms of a batch date, a day and a full ISO stamp.
_DAY = r"^\d{4}-\d{2}-\d{2}$"
_STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})$"


def instant(moment: datetime) -> Column:
    """A timestamp literal; a naive ``datetime`` is taken as UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    since = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    micros = (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds
    return F.timestamp_micros(F.lit(micros))


def iso_stamp(ts: Column) -> Column:
    """UTC text with milliseconds, such as ``2024-01-31T00:00:00.000Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def batch_day(uploaded_at: Column) -> Column:
    """The UTC day of an upload as ``yyyy-MM-dd`` text."""
    return F.to_date(uploaded_at).cast("string")


def hours_since(csv_date: Column, as_of: Column) -> Column:
    """Hours from ``csv_date`` to ``as_of``, as a fraction.

    ``csv_date`` is a date, or text: exactly ``yyyy-MM-dd`` means its UTC
    midnight, a full ISO stamp with its zone that instant. NULL for other text.
    """
    text = csv_date.cast("string")
    day = F.when(F.rlike(text, F.lit(_DAY)), F.concat(text, F.lit("T00:00:00Z")))
    stamp = F.when(F.rlike(text, F.lit(_STAMP)), text)
    start = F.try_to_timestamp(F.coalesce(day, stamp))
    return (F.unix_millis(as_of) - F.unix_millis(start)).cast("double") / F.lit(_MILLIS_PER_HOUR)


def grace_over(csv_date: Column, as_of: Column, grace_hours: float | None) -> Column:
    """May disagreements count as conflicts? Never NULL.

    Closed without a batch date and during the grace period. Open when the
    batch date cannot be read, since no comparison with it can succeed.
    """
    if grace_hours is None:
        return F.lit(True)
    text = csv_date.cast("string")
    has_date = F.coalesce(text != F.lit(""), F.lit(False))
    too_early = F.coalesce(hours_since(csv_date, as_of) < F.lit(grace_hours), F.lit(False))
    return has_date & ~too_early


def conflict_phase(csv_date: Column, as_of: Column, grace_hours: float | None) -> Column:
    """May reviewers see each other's labels? Never NULL.

    Unlike :func:`grace_over`, off when the batch date cannot be read.
    """
    if grace_hours is None:
        return F.lit(True)
    return F.coalesce(hours_since(csv_date, as_of) >= F.lit(grace_hours), F.lit(False))
