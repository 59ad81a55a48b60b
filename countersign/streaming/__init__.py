"""The review over incoming labels and files."""

from countersign.streaming.backlog import build_backlog, merge_backlog, read_backlog
from countersign.streaming.gate import gate_opens_at, read_gate, run_live_gate, ticks
from countersign.streaming.labels import (
    live_state,
    read_remaining,
    read_state,
    read_stats,
    run_live_state,
    run_live_stats,
)
from countersign.streaming.pickup import (
    current_snapshot,
    new_uploads,
    read_history,
    read_uploads,
    run_daily_pickup,
)

__all__ = [
    "build_backlog",
    "current_snapshot",
    "gate_opens_at",
    "live_state",
    "merge_backlog",
    "new_uploads",
    "read_backlog",
    "read_gate",
    "read_history",
    "read_remaining",
    "read_state",
    "read_stats",
    "read_uploads",
    "run_daily_pickup",
    "run_live_gate",
    "run_live_state",
    "run_live_stats",
    "ticks",
]
