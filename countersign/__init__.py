"""Two-party review of transaction ledgers on Spark.

Load ledger files, keep the latest label of each reviewer per transaction, find
disagreements once the grace period is over, count, and order what is left.
"""

from countersign.rules import ReviewRules
from countersign.session import local_session, pin_utc

__all__ = ["ReviewRules", "local_session", "pin_utc"]
