"""Who reviews, which labels they may give, and how long labels stay private."""

from __future__ import annotations

from dataclasses import dataclass

# Labels offered to every roster in addition to its own names.
SHARED_LABELS = ("Split", "Other", "Unsure")
# Fixed value: hours from the batch date until disagreements become visible.
GRACE_HOURS = 24.0
# Placeholders for a missing label.
MISSING_IN_SHARED_VIEW = "—"
MISSING_IN_OWN_VIEW = "Not yet assigned"
# What follows the number of conflicts, and the banner around it.
ALERT_TEXT = "{} transaction(s) have conflicts that need resolution"
BANNER_TEXT = (
    "Conflict Phase: Both users have submitted. {} conflict(s) detected. "
    "Work together to resolve them."
)


@dataclass(frozen=True)
class ReviewRules:
    """Roster, label domain and grace period of one review.

    ``grace_hours=None`` switches the grace gate off: disagreements count at
    once, whatever the batch date is.
    """

    roster: tuple[str, ...]
    options: tuple[str, ...]
    grace_hours: float | None = GRACE_HOURS

    def __post_init__(self) -> None:
        if not self.roster or len(set(self.roster)) != len(self.roster):
            raise ValueError("the roster needs at least one name, each once")

    @classmethod
    def of(
        cls, *roster: str, grace_hours: float | None = GRACE_HOURS, unsure: bool = True
    ) -> ReviewRules:
        """Rules for ``roster`` with the standard label domain."""
        shared = SHARED_LABELS if unsure else SHARED_LABELS[:-1]
        return cls(tuple(roster), (*roster, *shared), grace_hours)

    def position(self, reviewer: str) -> int:
        """Place of ``reviewer`` in the roster, which names its label column."""
        if reviewer not in self.roster:
            raise ValueError(f"{reviewer!r} is not on the roster {self.roster}")
        return self.roster.index(reviewer)

    @property
    def label_columns(self) -> tuple[str, ...]:
        """One column per reviewer; positional, so names may hold any text."""
        return tuple(f"label_{i}" for i in range(len(self.roster)))
