"""Column expressions; all of them run inside the JVM."""

from countersign.functions.clock import (
    batch_day,
    conflict_phase,
    grace_over,
    hours_since,
    instant,
    iso_stamp,
)
from countersign.functions.numbers import leading_number, money_text
from countersign.functions.text import filled, is_filled, or_default, transaction_id

__all__ = [
    "batch_day",
    "conflict_phase",
    "filled",
    "grace_over",
    "hours_since",
    "instant",
    "is_filled",
    "iso_stamp",
    "leading_number",
    "money_text",
    "or_default",
    "transaction_id",
]
