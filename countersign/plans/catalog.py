"""The registered queries, each over the whole benchmark tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countersign import operators as op
from countersign.functions import (
    conflict_phase,
    grace_over,
    hours_since,
    instant,
    iso_stamp,
    leading_number,
    money_text,
    or_default,
)
from countersign.plans import tables as t
from countersign.plans.ingest import load_transactions
from countersign.session import pin_utc
from countersign.sources import (
    append_submissions,
    latest_snapshot,
    parse_ledger_lines,
    parse_state,
    publish_snapshot,
    read_ledger,
    read_snapshot,
    read_state_document,
    save_state,
    save_state_document,
    scratch_folder,
    stamp_batch,
    state_lines,
    with_row_position,
)
from countersign.streaming import (
    build_backlog,
    current_snapshot,
    merge_backlog,
    read_backlog,
    read_gate,
    read_history,
    read_remaining,
    read_state,
    read_stats,
    read_uploads,
    run_daily_pickup,
    run_live_gate,
    run_live_state,
    run_live_stats,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

A, B = t.RULES.label_columns


def query(name: str) -> Callable[[Query], Query]:
    """Register a query under ``name``; it runs with UTC days and stamps."""

    def register(function: Query) -> Query:
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(pin_utc(spark), folder)

        QUERIES[name] = run
        return run

    return register


def _state(spark: SparkSession, folder: str) -> DataFrame:
    return op.review_state(t.submissions(spark, folder), t.RULES, t.KEY)


def _review(spark: SparkSession, folder: str) -> DataFrame:
    tx, labels = t.transactions(spark, folder), t.submissions(spark, folder)
    return op.review(tx, labels, t.RULES, t.CSV_DATE, t.GATE_OPEN, t.KEY)


def _review_at_both(spark: SparkSession, folder: str) -> DataFrame:
    tx, labels = t.transactions(spark, folder), t.submissions(spark, folder)
    moments = [t.GATE_CLOSED, t.GATE_OPEN]
    return op.review_at(tx, labels, t.RULES, t.CSV_DATE, moments, t.KEY)


def _stats(spark: SparkSession, folder: str) -> DataFrame:
    gate = grace_over(F.lit(t.CSV_DATE), instant(t.GATE_OPEN), t.RULES.grace_hours)
    tx = t.transactions(spark, folder)
    return op.review_stats(op.review_flags(tx, _state(spark, folder), t.RULES, gate, t.KEY))


def _as_of() -> Column:
    return iso_stamp(F.col("as_of")).alias("as_of")


# --- sources -----------------------------------------------------------------


def _uploads(spark: SparkSession, folder: str, *, two_headers: bool = True) -> str:
    inbox = scratch_folder(spark, "uploads")
    return t.write_uploads(t.raw_ledger(spark, folder), inbox, two_headers=two_headers)


def _picked_up(spark: SparkSession, folder: str) -> str:
    """Two daily runs: the exports of all years, then new ones of half the rows."""
    inbox, work = scratch_folder(spark, "inbox"), scratch_folder(spark, "pickup")
    raw = t.raw_ledger(spark, folder)
    t.write_uploads(raw, f"{inbox}/first", two_headers=True)
    run_daily_pickup(spark, inbox, work)
    newest = raw.agg(F.max("upload")).scalar()
    again = raw.where(F.col("row_key") % 2 == 0)
    t.write_uploads(again.where(F.col("upload") != newest), f"{inbox}/second", two_headers=True)
    t.write_uploads(again.where(F.col("upload") == newest), f"{inbox}/second/last", two_headers=True)
    run_daily_pickup(spark, inbox, work)
    return work


@query("csv_scan")
def _csv_scan(spark, folder):
    rows = read_ledger(spark, _uploads(spark, folder))
    return rows.select(
        F.col("Date").alias("date"),
        F.col("Amount").alias("amount_text"),
        F.col("Description").alias("description"),
        F.col("Owner").alias("owner"),
    )


@query("csv_text_parse")
def _csv_text_parse(spark, folder):
    quoted = F.when(F.contains("Amount", F.lit(",")), F.concat(F.lit('"'), "Amount", F.lit('"')))
    line = F.concat_ws(",", "Date", F.coalesce(quoted, "Amount"), "Description", "Owner")
    broken = F.when(F.col("row_key") % 13 == 0, F.lit('"two\nlines"')).otherwise(F.col("Description"))
    rows = t.raw_ledger(spark, folder).withColumn("Description", broken)
    lines = rows.select("row_key", line.alias("line"))
    # A record equal to the header is a record like any other.
    alike = rows.where(F.col("row_key") % 17 == 0)
    lines = lines.union(alike.select("row_key", F.lit(",".join(t.FORWARD_HEADER))))
    return parse_ledger_lines(lines, "line").select(
        "row_key",
        F.col("Date").alias("date"),
        F.col("Amount").alias("amount_text"),
        F.col("Description").alias("description"),
        F.col("Owner").alias("owner"),
    )


@query("csv_provenance")
def _csv_provenance(spark, folder):
    rows = read_ledger(spark, _uploads(spark, folder))
    per_file = rows.groupBy("source_path", "source_file").count()
    return per_file.groupBy(t.upload_of(F.col("source_path")).alias("upload")).agg(
        F.count_if(F.endswith("source_file", F.lit(".csv"))).alias("csv_files"),
        F.sum("count").alias("transactions"),
    )


@query("csv_quoted_blocks")
def _csv_quoted_blocks(spark, folder):
    """Descriptions over several lines, in files cut into blocks."""
    inbox = scratch_folder(spark, "uploads")
    t.write_uploads(t.with_line_breaks(t.raw_ledger(spark, folder)), inbox, two_headers=True)
    with t.block_size(spark, t.several_blocks(spark, inbox)):
        rows = read_ledger(spark, inbox, multi_line=True)
    return rows.select(
        t.upload_of(F.col("source_path")).alias("upload"),
        F.col("Date").alias("date"),
        F.col("Amount").alias("amount_text"),
        F.col("Description").alias("description"),
        F.col("Owner").alias("owner"),
    )


@query("row_position")
def _row_position(spark, folder):
    inbox = _uploads(spark, folder)
    with t.block_size(spark, t.several_blocks(spark, inbox)):
        raw = op.required_fields(read_ledger(spark, inbox))
        placed = with_row_position(raw, scratch_folder(spark, "landing"))
    return placed.select(
        t.upload_of(F.col("source_path")).alias("upload"),
        "row_idx",
        F.col("Date").alias("date"),
        F.col("Amount").alias("amount_text"),
    )


@query("daily_pickup")
def _daily_pickup(spark, folder):
    work = _picked_up(spark, folder)
    history = read_history(spark, work)
    path = F.col("source_path")
    # An export that replaces the one of its year is an upload of its own.
    return history.select(
        t.upload_of(path).alias("upload"),
        F.when(F.contains(path, F.lit("/second/")), 1).otherwise(0).alias("round"),
        "row_idx",
        "tx_id",
        "date",
        "amount",
        "description",
    )


@query("current_snapshot")
def _current_snapshot(spark, folder):
    newest = current_snapshot(spark, _picked_up(spark, folder))
    return newest.select("row_idx", "tx_id", "date", "amount")


@query("emptied_snapshot")
def _emptied_snapshot(spark, folder):
    """An export whose rows all lack a field, after the others: it is current, and empty."""
    inbox, work = scratch_folder(spark, "inbox"), scratch_folder(spark, "pickup")
    raw = t.raw_ledger(spark, folder)
    t.write_uploads(raw, f"{inbox}/first", two_headers=True)
    run_daily_pickup(spark, inbox, work)
    empty = raw.where(F.col("row_key") % 8 == 0).withColumns({"Amount": F.lit(""), "upload": F.lit("2002")})
    t.write_uploads(empty, f"{inbox}/second", two_headers=False)
    run_daily_pickup(spark, inbox, work)
    current = current_snapshot(spark, work).agg(F.count("*").alias("current_rows"))
    stored = read_history(spark, work).agg(F.count("*").alias("stored_rows"))
    uploads = read_uploads(spark, work).agg(F.count("*").alias("uploads"))
    return current.select("current_rows", stored.scalar().alias("stored_rows"), uploads.scalar().alias("uploads"))


@query("published_snapshot")
def _published_snapshot(spark, folder):
    """A reader that began before the switch, and one after it."""
    work = scratch_folder(spark, "published")
    tx = t.transactions(spark, folder)
    publish_snapshot(tx.where(F.col(t.KEY) % 2 == 0), work)
    before = read_snapshot(spark, work)
    publish_snapshot(tx.where(F.col(t.KEY) % 3 == 0), work)
    seen = before.withColumn("reader", F.lit("before")).union(read_snapshot(spark, work).withColumn("reader", F.lit("after")))
    return seen.select("reader", "tx_id", "amount")


@query("ledger_in_parts")
def _ledger_in_parts(spark, folder):
    """All files as the parts of one upload, with ids that are unique over them."""
    inbox = _uploads(spark, folder, two_headers=False)
    tx = load_transactions(spark, inbox, t.ORDERS_AS_OF)
    return tx.select("row_idx", "tx_id", "date", "amount", "csv_date")


@query("latest_snapshot")
def _latest_snapshot(spark, folder):
    history = t.transactions(spark, folder).withColumn("batch", F.substring("date", 1, 4))
    return latest_snapshot(history, "batch").select("batch", "tx_id", "amount", "description")


@query("batch_stamp")
def _batch_stamp(spark, folder):
    rows = t.orders(spark, folder)
    batch = F.year("o_orderdate").cast("bigint").alias("batch")
    uploaded = F.max("o_orderdate").cast("timestamp").alias("uploaded_at")
    batches = rows.groupBy(batch).agg(uploaded, F.count(F.lit(1)).alias("transactions"))
    return stamp_batch(batches, F.col("uploaded_at")).select("batch", "csv_date", "transactions")


def _state_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON text per transaction; every eleventh key's is cut short."""
    latest = op.latest_assignment(t.submissions(spark, folder), t.KEY)
    cut = F.col("value").substr(F.lit(1), F.length("value") - 3)
    lines = state_lines(latest, t.KEY)
    return lines.withColumn("value", F.when(F.col(t.KEY) % 11 == 0, cut).otherwise(F.col("value")))


@query("state_from_json")
def _state_from_json(spark, folder):
    return parse_state(_state_texts(spark, folder), "value", "tx_key").select(
        "tx_key", "reviewer", "assignment", iso_stamp(F.col("ts")).alias("stamp")
    )


def _document(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """All labels as one JSON document in several parts; where it is, and its parts."""
    latest = op.latest_assignment(t.submissions(spark, folder), t.KEY)
    path = f"{scratch_folder(spark, 'document')}/state"
    return path, save_state_document(latest, path, t.KEY, t.RULES, parts=5)


@query("state_document_out")
def _state_document_out(spark, folder):
    """Every line of the document with the byte at which it begins."""
    path, parts = _document(spark, folder)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("part"))
    key = F.regexp_extract("value", r'^.?"([^"]*)"', 1)
    before = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(F.octet_length("value") + 1).over(before), F.lit(0))
    placed = lines.withColumn("key", key).withColumn("within", within).join(parts, "part")
    return placed.select((F.col("offset") + F.col("within")).alias("byte"), F.col("value").alias("line"))


@query("state_document_in")
def _state_document_in(spark, folder):
    """The document read back, its parts in several blocks each."""
    path, parts = _document(spark, folder)
    largest = parts.agg(F.max("bytes")).first()[0]
    with t.block_size(spark, max(1 << 10, largest // 3)):
        rows = read_state_document(spark, path, scratch_folder(spark, "landing"), in_parts=True)
    return rows.select(F.col("tx_id").alias("tx_key"), "reviewer", "assignment")


@query("state_repeated_keys")
def _state_repeated_keys(spark, folder):
    """State texts in which transactions and reviewers come more than once."""
    rows = t.orders(spark, folder)
    fields = {"id": F.col("o_orderkey").cast("string"), "label": F.col("o_orderpriority")}
    parts = [
        '{"', "id", '":{"A":"', "label", '","C":"gone"},"', "id", '":{"A":"old","B":"', "label", '","A":"', "label", '"}}'
    ]
    text = F.concat(*(fields.get(part, F.lit(part)) for part in parts))
    return parse_state(rows.select(text.alias("value")), key="tx_key").select("tx_key", "reviewer", "assignment")


@query("state_to_json")
def _state_to_json(spark, folder):
    latest = op.latest_assignment(t.submissions(spark, folder), t.KEY)
    return state_lines(latest, t.KEY).select(t.KEY, F.col("value").alias("state"))


# --- projections, filters, scalar functions ----------------------------------


@query("required_fields")
def _required_fields(spark, folder):
    kept = op.required_fields(t.raw_ledger(spark, folder))
    return kept.select("row_key", F.col("Date").alias("date"), F.col("Amount").alias("amount_text"))


@query("tx_id")
def _tx_id(spark, folder):
    rows = t.transactions(spark, folder).select("row_idx", "date")
    return op.with_tx_id(rows).select("row_idx", "tx_id")


@query("tx_projection")
def _tx_projection(spark, folder):
    raw = t.raw_ledger(spark, folder, spoilt=False).withColumnRenamed("row_key", "row_idx")
    fields = op.with_tx_id(op.transaction_fields(raw))
    return fields.select("tx_id", "row_idx", "date", "amount", "description")


@query("default_text")
def _default_text(spark, folder):
    return t.raw_ledger(spark, folder).select(
        "row_key",
        or_default(F.col("Description"), "Unknown").alias("description"),
        or_default(F.col("Owner"), "Unassigned").alias("owner"),
    )


@query("amount_parse")
def _amount_parse(spark, folder):
    raw = t.raw_ledger(spark, folder)
    return raw.select("row_key", leading_number(F.col("Amount")).alias("amount"))


@query("amount_format")
def _amount_format(spark, folder):
    tx = t.transactions(spark, folder)
    return tx.select("row_idx", money_text(F.col("amount")).alias("amount_text"))


@query("iso_stamp")
def _iso_stamp(spark, folder):
    stamp = iso_stamp(F.col("ts").cast("timestamp"))
    return t.events(spark, folder).select("event_id", stamp.alias("stamp"))


@query("hours_since_batch")
def _hours_since_batch(spark, folder):
    hours = hours_since(F.col("o_orderdate").cast("date"), instant(t.ORDERS_AS_OF))
    return t.orders(spark, folder).select("o_orderkey", hours.alias("hours"))


@query("conflict_phase")
def _conflict_phase(spark, folder):
    day = F.col("o_orderdate").cast("date")
    now = instant(t.ORDERS_AS_OF)
    return t.orders(spark, folder).select(
        "o_orderkey",
        conflict_phase(day, now, t.RULES.grace_hours).alias("phase"),
        grace_over(day, now, t.RULES.grace_hours).alias("gate_open"),
    )


# --- labels ------------------------------------------------------------------


@query("roster_filter")
def _roster_filter(spark, folder):
    kept = op.roster_filter(t.submissions(spark, folder), t.RULES)
    return kept.select("seq", t.KEY, "reviewer", "assignment")


@query("option_domain")
def _option_domain(spark, folder):
    labels = t.submissions(spark, folder)
    offered = op.option_domain(labels, t.NARROW_RULES).withColumn("accepted", F.lit(True))
    others = op.rejected_labels(labels, t.NARROW_RULES).withColumn("accepted", F.lit(False))
    return offered.unionByName(others).select("seq", t.KEY, "assignment", "accepted")


def _latest_columns(latest: DataFrame) -> DataFrame:
    return latest.select(t.KEY, "reviewer", "assignment", iso_stamp("ts").alias("stamp"), "seq")


@query("latest_assignment")
def _latest_assignment(spark, folder):
    return _latest_columns(op.latest_assignment(t.submissions(spark, folder), t.KEY))


@query("merge_state")
def _merge_state(spark, folder):
    labels = t.submissions(spark, folder)
    early = F.col("ts") < instant(t.MERGE_SPLIT)
    base = op.latest_assignment(labels.where(early), t.KEY)
    return _latest_columns(op.merge_state(base, labels.where(~early), t.KEY))


@query("last_updated")
def _last_updated(spark, folder):
    newest = op.last_updated(t.submissions(spark, folder), t.KEY)
    return newest.select(t.KEY, iso_stamp("last_updated").alias("last_updated"))


# --- status and counts -------------------------------------------------------


@query("tx_with_state")
def _tx_with_state(spark, folder):
    labels = t.submissions(spark, folder)
    state = op.review_state(labels, t.RULES, t.KEY, last_updated=True)
    joined = op.with_labels(t.transactions(spark, folder), state, t.KEY)
    return joined.select(
        t.KEY,
        "tx_id",
        "amount",
        F.col(A).alias("label_a"),
        F.col(B).alias("label_b"),
        iso_stamp("last_updated").alias("last_updated"),
    )


@query("conflicts")
def _conflicts(spark, folder):
    found = op.conflicts(_review(spark, folder))
    return found.select("tx_id", F.col(A).alias("label_a"), F.col(B).alias("label_b"))


@query("fully_submitted")
def _fully_submitted(spark, folder):
    return op.fully_submitted(_review(spark, folder)).select("tx_id", "conflict")


@query("tx_status")
def _tx_status(spark, folder):
    return _review(spark, folder).select("tx_id", "status")


@query("gated_conflicts")
def _gated_conflicts(spark, folder):
    return _review_at_both(spark, folder).select(_as_of(), "tx_id", "conflict", "status")


@query("review_stats")
def _review_stats(spark, folder):
    return _stats(spark, folder)


@query("review_summary")
def _review_summary(spark, folder):
    return op.review_summary(_stats(spark, folder))


@query("conflict_alert")
def _conflict_alert(spark, folder):
    phase = conflict_phase(F.lit(t.CSV_DATE), instant(t.GATE_OPEN), t.RULES.grace_hours)
    return op.conflict_alert(_stats(spark, folder), phase)


@query("remaining_by_reviewer")
def _remaining_by_reviewer(spark, folder):
    counts = op.remaining_by_reviewer(_review_at_both(spark, folder), t.RULES, "as_of")
    return counts.select(_as_of(), "reviewer", "remaining")


# --- large rosters ---


def _large_roster(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Latest labels, counts and roster with every user as a reviewer."""
    named = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    given = t.submissions_by(t.events(spark, folder), named)
    roster = op.roster_names(given)
    labels = op.roster_labels(given, roster, t.KEY)
    return labels, op.roster_counts(labels, roster, t.KEY), roster


@query("large_roster")
def _large_roster_review(spark, folder):
    _, counts, _ = _large_roster(spark, folder)
    reviewed = op.roster_review(t.transactions(spark, folder), counts, _open_gate(), t.KEY)
    return reviewed.select("tx_id", "given", "submitted", "conflict", "status")


@query("large_roster_remaining")
def _large_roster_remaining(spark, folder):
    labels, counts, roster = _large_roster(spark, folder)
    return op.roster_left(t.transactions(spark, folder), labels, counts, roster, _open_gate(), t.KEY)


# --- views -------------------------------------------------------------------


@query("backlog")
def _backlog(spark, folder):
    ordered = op.backlog(_review(spark, folder))
    return ordered.select("rank_key", "row_idx", "tx_id", "status", "amount", "description")


@query("backlog_with_counts")
def _backlog_with_counts(spark, folder):
    """The backlog as written, beside the counts taken while it was."""
    path = f"{scratch_folder(spark, 'backlog')}/rows"
    counts = op.write_backlog(_review(spark, folder), path)
    columns = [F.lit(value).cast("bigint").alias(name) for name, value in counts.items()]
    return spark.read.parquet(path).select("rank_key", "row_idx", "status", *columns)


@query("own_submission")
def _own_submission(spark, folder):
    tx, labels = t.transactions(spark, folder), t.submissions(spark, folder)
    return op.own_submission(tx, labels, t.RULES, t.VIEWER, t.KEY).select("tx_id", "own")


@query("next_action")
def _next_action(spark, folder):
    tx, labels = t.transactions(spark, folder), t.submissions(spark, folder)
    own = op.own_submission(tx, labels, t.RULES, t.VIEWER, t.KEY)
    return own.select("tx_id", op.next_action(F.col("own")).alias("action"))


@query("unassigned_by_reviewer")
def _unassigned_by_reviewer(spark, folder):
    tx, labels = t.transactions(spark, folder), t.submissions(spark, folder)
    open_rows = op.unassigned_by_reviewer(tx, labels, t.RULES, t.VIEWER, t.KEY)
    return open_rows.select("tx_id", "amount", "description")


@query("tx_reviewer_matrix")
def _tx_reviewer_matrix(spark, folder):
    joined = op.with_labels(t.transactions(spark, folder), _state(spark, folder), t.KEY)
    return op.tx_reviewer_matrix(joined, t.RULES).select("tx_id", "reviewer", "assignment")


@query("visible_assignments")
def _visible_assignments(spark, folder):
    seen = op.visible_assignments(_review_at_both(spark, folder), t.RULES, t.VIEWER)
    return seen.select(_as_of(), "tx_id", "reviewer", "shown")


# --- streams -----------------------------------------------------------------


def _label_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = t.events(spark, folder).schema
    # A pattern admits both a file and a folder of files of that name.
    rows = spark.readStream.schema(schema).parquet(f"{folder}/events*.parquet")
    return t.as_submissions(rows)


@query("stream_state")
def _stream_state(spark, folder):
    work = scratch_folder(spark, "live")
    run_live_state(_label_stream(spark, folder), t.RULES, work, t.KEY).awaitTermination()
    return read_state(spark, work, t.KEY).select(
        t.KEY,
        F.col(A).alias("label_a"),
        F.col(B).alias("label_b"),
        iso_stamp("last_updated").alias("last_updated"),
    )


def _counted_live(spark: SparkSession, folder: str) -> str:
    """Live counts over an older upload first, then over the present one."""
    work = scratch_folder(spark, "live")
    labels, tx = _label_stream(spark, folder), t.transactions(spark, folder)
    older = tx.where(F.col(t.KEY) % 3 == 0)
    run_live_stats(labels, older, t.RULES, work, t.KEY, snapshot="older").awaitTermination()
    run_live_stats(labels, tx, t.RULES, work, t.KEY, snapshot="present").awaitTermination()
    return work


def _open_gate() -> Column:
    return grace_over(F.lit(t.CSV_DATE), instant(t.GATE_OPEN), t.RULES.grace_hours)


@query("stream_stats")
def _stream_stats(spark, folder):
    return read_stats(spark, _counted_live(spark, folder), _open_gate())


@query("live_remaining")
def _live_remaining(spark, folder):
    return read_remaining(spark, _counted_live(spark, folder), t.RULES, _open_gate())


@query("live_backlog")
def _live_backlog(spark, folder):
    """The backlog of the early labels, then the transactions of later labels brought to their places."""
    work = scratch_folder(spark, "backlog")
    tx, labels = t.transactions(spark, folder), t.submissions(spark, folder)
    early = labels.where(F.col("ts") < instant(t.MERGE_SPLIT))
    rows = max(1000, tx.count() // 12)
    review = lambda some, given: op.review(some, given, t.RULES, t.CSV_DATE, t.GATE_OPEN, t.KEY)
    build_backlog(review(tx, early), work, range_rows=rows)
    later = labels.where(F.col("ts") >= instant(t.MERGE_SPLIT)).select(t.KEY).distinct()
    changed = tx.join(later, t.KEY, "left_semi")
    merge_backlog(review(changed, labels), work, range_rows=rows)
    return read_backlog(spark, work).select("rank_key", "row_idx", "tx_id", "status", "amount", "description")


@query("live_gate")
def _live_gate(spark, folder):
    """Conflicts by the tick of the clock that made them visible; no label arrives meanwhile."""
    work = scratch_folder(spark, "live")
    run_live_state(_label_stream(spark, folder), t.RULES, work, t.KEY).awaitTermination()
    for number, tick in enumerate(t.TICKS):
        spark.range(1).select(instant(tick).alias("now")).coalesce(1).write.parquet(f"{work}/ticks/{number}")
    clock = spark.readStream.schema("now timestamp").option("maxFilesPerTrigger", 1).parquet(f"{work}/ticks/*")
    tx = t.transactions(spark, folder)
    run_live_gate(clock, tx, t.RULES, work, t.KEY, csv_date="date").awaitTermination()
    return read_gate(spark, work).select(
        "tx_id", F.col(A).alias("label_a"), F.col(B).alias("label_b"), iso_stamp("opened_at").alias("opened_at")
    )


# --- through stored files and by text ids ------------------------------------


@query("review_stats_by_id")
def _review_stats_by_id(spark, folder):
    """The counts with labels that name a transaction by its text id."""
    tx = t.transactions(spark, folder)
    named = t.submissions(spark, folder).join(tx.select(t.KEY, "tx_id"), t.KEY).drop(t.KEY)
    reviewed = op.review(tx, named, t.RULES, t.CSV_DATE, t.GATE_OPEN)
    return op.review_stats(reviewed)


@query("state_round_trip")
def _state_round_trip(spark, folder):
    """Stored labels, an edit submitted and appended, the state saved and loaded."""
    work = scratch_folder(spark, "state")
    labels = t.submissions(spark, folder)
    append_submissions(labels, f"{work}/labels")
    stored = spark.read.parquet(f"{work}/labels")
    chosen = stored.where(F.col(t.KEY) % 5 == 0).select(t.KEY).distinct()
    edit = op.submit(chosen, t.RULES, "A", "Other", t.EDITED_AT, 1, t.KEY)
    append_submissions(edit, f"{work}/labels")
    latest = op.latest_assignment(spark.read.parquet(f"{work}/labels"), t.KEY)
    save_state(latest, f"{work}/json", t.KEY, t.RULES)
    loaded = parse_state(spark.read.text(f"{work}/json"), key="tx_key")
    return loaded.select("tx_key", "reviewer", "assignment")


@query("money_and_dates")
def _money_and_dates(spark, folder):
    """Large amounts with exact ties, and batch dates with junk or a time of day."""
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 4
    large = (
        F.when(kind == 0, F.lit(2.0**46) + key.cast("double") + F.lit(0.125))
        .when(kind == 1, F.lit(2.0**50) + key.cast("double") + F.lit(0.5))
        .when(kind == 2, F.lit(2.0**60) + key.cast("double") * 256)
        .otherwise(F.lit(2.0**64) + key.cast("double") * 4096)
    )
    day = F.col("o_orderdate").cast("date").cast("string")
    written = (
        F.when(key % 3 == 0, F.concat(day, F.lit(" junk")))
        .when(key % 3 == 1, F.lit(""))
        .otherwise(F.concat(day, F.lit("T10:00:00Z")))
    )
    as_of = instant(t.ORDERS_AS_OF)
    return t.orders(spark, folder).select(
        "o_orderkey",
        money_text(large).alias("money"),
        grace_over(written, as_of, 24.0).alias("gate"),
        conflict_phase(written, as_of, 24.0).alias("phase"),
    )
