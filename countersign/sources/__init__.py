"""Where transactions and states come from and go to."""

from countersign.sources.ledgers import (
    LEDGER_COLUMNS,
    ledger_from_text,
    parse_ledger_lines,
    read_ledger,
)
from countersign.sources.positions import with_row_position
from countersign.sources.scratch import scratch_folder
from countersign.sources.snapshots import (
    append_submissions,
    latest_snapshot,
    publish_snapshot,
    read_snapshot,
    replace_snapshot,
    save_bucketed,
    stamp_batch,
    upload_id,
)
from countersign.sources.state_document import read_state_document, save_state_document
from countersign.sources.state_json import parse_state, save_state, state_lines

__all__ = [
    "LEDGER_COLUMNS",
    "append_submissions",
    "latest_snapshot",
    "ledger_from_text",
    "parse_ledger_lines",
    "parse_state",
    "publish_snapshot",
    "read_ledger",
    "read_snapshot",
    "read_state_document",
    "replace_snapshot",
    "save_bucketed",
    "save_state",
    "save_state_document",
    "scratch_folder",
    "stamp_batch",
    "state_lines",
    "upload_id",
    "with_row_position",
]
