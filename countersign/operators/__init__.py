"""The review, DataFrame in, DataFrame out."""

from countersign.operators.assignments import (
    accepted_label,
    last_updated,
    latest_assignment,
    merge_state,
    option_domain,
    rejected_labels,
    review_state,
    reviewer_labels,
    roster_filter,
    submit,
)
from countersign.operators.rosters import (
    roster_counts,
    roster_labels,
    roster_left,
    roster_names,
    roster_places,
    roster_remaining,
    roster_review,
    roster_state,
)
from countersign.operators.stats import (
    conflict_alert,
    remaining_by_reviewer,
    review_stats,
    review_summary,
)
from countersign.operators.status import (
    conflicts,
    fully_submitted,
    review,
    review_at,
    review_flags,
    with_labels,
    with_status,
)
from countersign.operators.transactions import (
    is_empty,
    required_fields,
    transaction_fields,
    with_tx_id,
)
from countersign.operators.views import (
    backlog,
    next_action,
    own_submission,
    tx_reviewer_matrix,
    unassigned_by_reviewer,
    visible_assignments,
    write_backlog,
)

__all__ = [
    "accepted_label",
    "backlog",
    "conflict_alert",
    "conflicts",
    "fully_submitted",
    "is_empty",
    "last_updated",
    "latest_assignment",
    "merge_state",
    "next_action",
    "option_domain",
    "own_submission",
    "rejected_labels",
    "remaining_by_reviewer",
    "required_fields",
    "review",
    "review_at",
    "review_flags",
    "review_state",
    "review_stats",
    "review_summary",
    "reviewer_labels",
    "roster_counts",
    "roster_filter",
    "roster_labels",
    "roster_left",
    "roster_names",
    "roster_places",
    "roster_remaining",
    "roster_review",
    "roster_state",
    "submit",
    "transaction_fields",
    "tx_reviewer_matrix",
    "unassigned_by_reviewer",
    "visible_assignments",
    "with_labels",
    "with_status",
    "with_tx_id",
    "write_backlog",
]
