"""Ledger files, positions, state text and snapshots."""

import json
from datetime import datetime, timezone
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from countersign import ReviewRules
from countersign import operators as op
from countersign.plans import load_transactions
from countersign.sources import (
    latest_snapshot,
    ledger_from_text,
    parse_ledger_lines,
    parse_state,
    publish_snapshot,
    read_ledger,
    read_snapshot,
    replace_snapshot,
    save_bucketed,
    save_state,
    scratch_folder,
    stamp_batch,
    state_lines,
    with_row_position,
)
from tests.plans import exchanges, plan_of

FIELDS = ["Date", "Amount", "Description", "Owner"]
# Fifteen rows: the shape of a bank export.
SAMPLE = "Date,Amount,Description,Owner\n" + "".join(
    f"2026-04-{3 - i // 6:02d},{10 + i}.{i:02d},Shop {i},Unknown\n" for i in range(15)
)


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_columns_are_found_by_name_in_every_file(spark, tmp_path):
    put(tmp_path, "a.csv", "Date,Amount,Description,Owner\n2024-01-01,1.00,one,X\n")
    put(tmp_path, "b.csv", "Amount,Owner,Date,Description\n2.00,Y,2024-01-02,two\n")
    put(tmp_path, "deep/c.csv", "Date,Amount\n2024-01-03,3.00\n")
    put(tmp_path, "d.csv", "Date,Amount,Extra,Description\n2024-01-04,4.00,?,four\n")
    got = rows_of(read_ledger(spark, str(tmp_path)), *FIELDS, "source_file")
    assert got == [
        ("2024-01-01", "1.00", "one", "X", "a.csv"),
        ("2024-01-02", "2.00", "two", "Y", "b.csv"),
        ("2024-01-03", "3.00", None, None, "c.csv"),
        ("2024-01-04", "4.00", "four", None, "d.csv"),
    ]


def test_one_read_per_distinct_header(spark, tmp_path):
    for i in range(6):
        header = "Date,Amount" if i % 2 else "Amount,Date"
        put(tmp_path, f"{i}.csv", f"{header}\n1,1\n")
    frame = read_ledger(spark, str(tmp_path))
    assert plan_of(frame).count("FileScan csv") == 2
    assert frame.count() == 6


def test_unlike_headers_fail_instead_of_swapping(spark, tmp_path):
    put(tmp_path, "a.csv", "Date,Amount\n2024-01-01,1.00\n")
    put(tmp_path, "b.csv", "Amount,Date\n2.00,2024-01-02\n")
    with pytest.raises(Exception, match="header"):
        read_ledger(spark, str(tmp_path), by_header=False).collect()


def test_only_csv_files(spark, tmp_path):
    put(tmp_path, "a.csv", "Date,Amount\n2024-01-01,1.00\n")
    put(tmp_path, "a.txt", "Date,Amount\n2024-01-01,2.00\n")
    put(tmp_path, "b.CSV.bak", "Date,Amount\n2024-01-01,3.00\n")
    put(tmp_path, "empty.csv", "")
    for by_header in (True, False):
        got = read_ledger(spark, str(tmp_path), by_header=by_header)
        assert rows_of(got, "Amount", "source_file") == [("1.00", "a.csv")]


def test_empty_folder(spark, tmp_path):
    put(tmp_path, "a.txt", "x")
    frame = read_ledger(spark, str(tmp_path))
    assert frame.isEmpty() and op.is_empty(op.required_fields(frame))


def test_awkward_file_names(spark, tmp_path):
    for i, name in enumerate(["a b.csv", "a[1].csv", "a%20b.csv", "a{x,y}.csv", "ä*?.csv"]):
        put(tmp_path, name, f"Date,Amount\n2024-01-01,{i}\n")
    assert len(rows_of(read_ledger(spark, str(tmp_path)), "Amount")) == 5
    one = read_ledger(spark, str(tmp_path / "a b.csv"))
    assert rows_of(one, "Amount") == [("0",)]


def test_text_details(spark, tmp_path):
    put(
        tmp_path,
        "a.csv",
        "\ufeffDate,Amount,Description\r\n"
        '2024-01-01,"1,468.00","say ""hi"", ok"\r\n'
        "\r\n   \r\n"
        '2024-01-02, 5,""\r\n'
        "2024-01-03,6\r\n"
        "2024-01-04,7,x,surplus\r\n",
    )
    put(tmp_path, "b.csv", "Date,Amount,Description\n2024-01-05,8,Zürich ☕\n")
    frame = read_ledger(spark, str(tmp_path))
    assert plan_of(frame).count("FileScan csv") == 1  # the mark at the start is no difference
    assert rows_of(frame, "Date", "Amount", "Description") == [
        ("2024-01-01", "1,468.00", 'say "hi", ok'),
        ("2024-01-02", " 5", None),
        ("2024-01-03", "6", None),
        ("2024-01-04", "7", "x"),
        ("2024-01-05", "8", "Zürich ☕"),
    ]


def test_delimiter_and_line_breaks_in_quotes(spark, tmp_path):
    put(tmp_path, "a.csv", 'Date;Amount;Description\n2024-01-01;1,5;"two\nlines"\n')
    frame = read_ledger(spark, str(tmp_path), delimiter=";", multi_line=True)
    assert rows_of(frame, "Amount", "Description") == [("1,5", "two\nlines")]


def test_header_names_are_exact(spark, tmp_path):
    put(tmp_path, "a.csv", "date,Amount\n2024-01-01,1.00\n")
    assert rows_of(read_ledger(spark, str(tmp_path)), "Date", "Amount") == [(None, "1.00")]


def test_required_fields(spark):
    rows = [("d", "1"), ("d", "0"), ("d", " "), ("d", ""), ("", "1"), (None, "1"), ("d", None)]
    raw = spark.createDataFrame(rows, "Date string, Amount string")
    assert [r.Amount for r in op.required_fields(raw).collect()] == ["1", "0", " "]


def test_load_transactions(spark, tmp_path):
    path = put(tmp_path, "export.csv", SAMPLE)
    moment = datetime(2026, 4, 3, 23, 0, tzinfo=timezone.utc)
    tx = load_transactions(spark, path, moment, owner=True, landing=str(tmp_path / "land"))
    got = tx.orderBy("row_idx").collect()
    assert [r.row_idx for r in got] == list(range(15))
    assert (got[0].tx_id, got[14].tx_id) == ("2026-04-03-0", "2026-04-01-14")
    assert (got[3].amount, got[3].description, got[3].owner) == (13.03, "Shop 3", "Unknown")
    assert {r.csv_date for r in got} == {"2026-04-03"}
    assert {r.source_file for r in got} == {"export.csv"}
    assert stamp_batch(tx, datetime(2026, 4, 4)).head().csv_date == "2026-04-04"


def blocks(tmp_path, sizes):
    """Files of several sizes; every third row lacks its amount."""
    expected = {}
    for name, size in sizes.items():
        lines = [f"2024-01-{1 + i % 28:02d},{'' if i % 3 == 0 else i},row {i}" for i in range(size)]
        put(tmp_path, f"in/{name}", "\n".join(["Date,Amount,Description", *lines]) + "\n")
        kept = [i for i in range(size) if i % 3]
        expected |= {(name, f"row {i}"): place for place, i in enumerate(kept)}
    return expected


SIZES = {"a.csv": 40, "b.csv": 4000, "c.csv": 900, "d.csv": 0}


@pytest.mark.parametrize("broadcast_up_to", [0, 1 << 20])
@pytest.mark.parametrize("two_headers", [False, True])
def test_row_position(spark, setting, tmp_path, broadcast_up_to, two_headers):
    expected = blocks(tmp_path, SIZES)
    if two_headers:
        put(tmp_path, "in/e.csv", "Amount,Date\n1,2024-01-01\n,2024-01-01\n3,2024-01-02\n")
    setting("spark.sql.files.maxPartitionBytes", "9000")
    setting("spark.sql.files.openCostInBytes", "0")
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    raw = op.required_fields(read_ledger(spark, str(tmp_path / "in")))
    assert raw.rdd.getNumPartitions() > 6
    placed = with_row_position(raw, str(tmp_path / "land"), broadcast_up_to=broadcast_up_to)
    got = {(r.source_file, r.Description): r.row_idx for r in placed.collect()}
    if two_headers:
        extra = [r for r in placed.where("source_file = 'e.csv'").collect()]
        assert sorted((r.Amount, r.row_idx) for r in extra) == [("1", 0), ("3", 1)]
        got = {k: v for k, v in got.items() if k[0] != "e.csv"}
    assert got == expected
    assert placed.columns == [*raw.columns, "row_idx"]
    # Rows are not moved when the offsets are small enough to be sent to them.
    moved = [e for e in exchanges(placed) if e == "hashpartitioning"]
    assert len(moved) == (0 if broadcast_up_to else 2)


def test_row_position_across_files(spark, setting, tmp_path):
    within = blocks(tmp_path, SIZES)
    setting("spark.sql.files.maxPartitionBytes", "9000")
    raw = op.required_fields(read_ledger(spark, str(tmp_path / "in")))
    placed = with_row_position(raw, str(tmp_path / "land"), across_files=True)
    got = {(r.source_file, r.Description): r.row_idx for r in placed.collect()}
    kept = {name: sum(key[0] == name for key in within) for name in SIZES}
    starts = {"a.csv": 0, "b.csv": kept["a.csv"], "c.csv": kept["a.csv"] + kept["b.csv"]}
    assert got == {key: starts[key[0]] + place for key, place in within.items()}
    assert sorted(got.values()) == list(range(len(within)))


def test_upload_in_parts_has_unique_ids(spark, tmp_path):
    put(tmp_path, "up/part-1.csv", "Date,Amount\n2024-01-01,1\n2024-01-01,\n2024-01-01,2\n")
    put(tmp_path, "up/part-2.csv", "Amount,Date\n3,2024-01-01\n")
    tx = load_transactions(spark, str(tmp_path / "up"), datetime(2024, 1, 2))
    got = rows_of(tx, "tx_id", "amount")
    assert got == [("2024-01-01-0", 1.0), ("2024-01-01-1", 2.0), ("2024-01-01-2", 3.0)]


def test_row_position_survives_another_split(spark, setting, tmp_path):
    """The numbers are fixed by the landed rows, however those are read back."""
    expected = blocks(tmp_path, SIZES)
    setting("spark.sql.files.maxPartitionBytes", "9000")
    raw = op.required_fields(read_ledger(spark, str(tmp_path / "in")))
    placed = with_row_position(raw, str(tmp_path / "land"))
    setting("spark.sql.files.maxPartitionBytes", "2000")
    got = {(r.source_file, r.Description): r.row_idx for r in placed.collect()}
    assert got == expected


def test_csv_text_in_the_program(spark):
    tx = ledger_from_text(spark, "\n" + SAMPLE.replace("\n", "\r\n") + "\r\n \r\n")
    got = tx.orderBy("line_no").collect()
    assert len(got) == 15 and tuple(got[1]) == (1, "2026-04-03", "11.01", "Shop 1", "Unknown")
    swapped = ledger_from_text(spark, 'Amount,Date\n"1,5",2024-01-01\n')
    assert tuple(swapped.head()) == (0, "2024-01-01", "1,5", None, None)
    with pytest.raises(ValueError):
        ledger_from_text(spark, " \n")


def test_csv_text_in_a_column(spark):
    header = "Amount,Date,Description"
    lines = [header, '7,2024-01-01,"a, ""b"""', "", "  ", header, '"",2024-01-02,']
    rows = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    every = parse_ledger_lines(rows, "line", header).orderBy("n").collect()
    assert [r.n for r in every] == [0, 1, 4, 5]
    assert tuple(every[2]) == (4, "Date", "Amount", "Description", None)
    got = parse_ledger_lines(rows, "line", header, headers_among=True).orderBy("n").collect()
    assert [tuple(r) for r in got] == [
        (1, "2024-01-01", "7", 'a, "b"', None),
        (5, "2024-01-02", None, None, None),
    ]


STATES = [
    '{"t-1": {"A": "Split", "B": null, "lastUpdated": "2024-01-02T03:04:05.678Z"},'
    ' "t-2": {"guest": "", "A": "A"}}',
    '{"t-3": {"A": ',
    "not json",
    "{}",
    "",
    None,
    '{"t-4": {}}',
    '{"t-5": null}',
    '{"t-6": {"A": "Split"}, "t-7": {"A": ',
    "{'t-8': {'A': 'Split'}}",
    '{"t-9": "no object", "t-10": {"A": "B"}}',
]


def test_state_text(spark):
    rows = spark.createDataFrame([(s,) for s in STATES], "value string")
    got = {(r.tx_id, r.reviewer): (r.assignment, r.ts) for r in parse_state(rows).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        ("t-1", "A"): "Split",
        ("t-1", "B"): None,
        ("t-2", "guest"): "",
        ("t-2", "A"): "A",
        ("t-10", "A"): "B",
    }
    assert got["t-1", "A"][1] is not None and got["t-2", "A"][1] is None


def test_state_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(s,) for s in STATES], "value string")
    latest = op.latest_assignment(parse_state(rows))
    texts = {r.tx_id: json.loads(r.value) for r in state_lines(latest).collect()}
    assert texts["t-1"] == {
        "t-1": {"A": "Split", "B": None, "lastUpdated": "2024-01-02T03:04:05.678Z"}
    }
    save_state(latest, str(tmp_path / "state"))
    again = parse_state(spark.read.text(str(tmp_path / "state")))
    columns = ("tx_id", "reviewer", "assignment", "ts")
    assert rows_of(again, *columns) == rows_of(latest, *columns)
    save_state(latest.where("tx_id = 't-1'"), str(tmp_path / "state"))
    assert spark.read.text(str(tmp_path / "state")).count() == 1


def test_stored_state_loses_against_newer_labels(spark):
    stored = parse_state(spark.createDataFrame([(STATES[0],)], "value string"))
    newer = stored.where("reviewer = 'A'").select(
        "tx_id",
        "reviewer",
        F.lit("Other").alias("assignment"),
        F.lit("2024-05-01 00:00:00").cast("timestamp").alias("ts"),
        F.lit(9).cast("bigint").alias("seq"),
    )
    got = rows_of(op.merge_state(stored, newer), "tx_id", "reviewer", "assignment")
    assert got == [
        ("t-1", "A", "Other"),
        ("t-1", "B", None),
        ("t-2", "A", "Other"),
        ("t-2", "guest", ""),
    ]


def test_snapshot_is_replaced(spark, tmp_path):
    path = str(tmp_path / "tx")
    for n in (5, 2):
        replace_snapshot(spark.range(n), path)
    assert spark.read.parquet(path).count() == 2


def test_latest_snapshot_reads_one_partition(spark, tmp_path):
    days = F.concat(F.lit("2024-01-0"), (F.col("id") % 4 + 1).cast("string"))
    spark.range(40).withColumn("csv_date", days).write.partitionBy("csv_date").parquet(
        str(tmp_path / "tx")
    )
    newest = latest_snapshot(spark.read.parquet(str(tmp_path / "tx")), "csv_date")
    assert newest.count() == 10
    assert "PartitionFilters: [isnotnull(csv_date" in plan_of(newest)
    assert "Subquery" in plan_of(newest)


def test_bucketed_tables_join_in_place(spark, setting, tmp_path):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sql(f"CREATE DATABASE bucketed LOCATION '{tmp_path}'")
    rules = ReviewRules.of("A", "B")
    labels = spark.range(1500).select(
        (F.col("id") % 500).alias("row_idx"),
        F.lit("A").alias("reviewer"),
        F.concat(F.lit("L"), F.col("id").cast("string")).alias("assignment"),
        F.lit("2024-01-01").cast("timestamp").alias("ts"),
        F.col("id").alias("seq"),
    )
    tx = spark.range(900).select(F.col("id").alias("row_idx"))
    save_bucketed(tx, "bucketed.tx", "row_idx", 4)
    save_bucketed(op.review_state(labels, rules, "row_idx"), "bucketed.state", "row_idx", 4)
    assert len(list((tmp_path / "state").glob("*.parquet"))) == 4
    joined = op.with_labels(spark.table("bucketed.tx"), spark.table("bucketed.state"), "row_idx")
    assert exchanges(joined) == [] and "SortMergeJoin" in plan_of(joined)
    assert joined.count() == 900
    assert joined.where("label_0 = concat('L', row_idx + 1000)").count() == 500
    spark.sql("DROP DATABASE bucketed CASCADE")


class Session:
    """As much of a session as choosing a folder looks at."""

    def __init__(self, master, named=None, context_dir=None):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = SimpleNamespace(master=master, getCheckpointDir=lambda: context_dir)


def test_scratch_folder_follows_the_session(tmp_path):
    shared = [scratch_folder(Session("yarn", "hdfs://c/points/"), "x") for _ in range(2)]
    assert shared[0].startswith("hdfs://c/points/countersign-x-") and shared[0] != shared[1]
    assert scratch_folder(Session("local[2]", "/points"), "x").startswith("/points/countersign-x-")
    assert scratch_folder(Session("yarn", None, "/set"), "x").startswith("/set/countersign-x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_folder(Session("yarn"), "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_folder(Session("local[2]"), "x")


def test_headers_take_one_job_whatever_the_number_of_files(spark, tmp_path):
    def jobs(files: int) -> int:
        folder = tmp_path / str(files)
        folder.mkdir()
        for i in range(files):
            head = "Date,Amount" if i % 2 else "Amount,Date"
            (folder / f"{i}.csv").write_text(f"{head}\n{'2024-01-01,5' if i % 2 else '5,2024-01-01'}\n")
        tracker, group = spark.sparkContext.statusTracker(), f"headers-{files}"
        spark.sparkContext.setJobGroup(group, "")
        rows = read_ledger(spark, str(folder))
        assert {(r.Date, r.Amount) for r in rows.collect()} == {("2024-01-01", "5")}
        return len(tracker.getJobIdsForGroup(group))

    few, many = jobs(100), jobs(200)  # beyond 32 paths Spark lists them by a job
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many == few <= 12


def test_text_with_line_breaks_in_quotes(spark):
    text = 'Date,Amount,Description\n2024-01-01,5,"two\nlines"\n\nDate,Amount,Description\n2024-01-02,"",x,extra\n'
    rows = ledger_from_text(spark, text).orderBy("line_no").collect()
    assert [tuple(r) for r in rows] == [
        (0, "2024-01-01", "5", "two\nlines", None),
        (1, "Date", "Amount", "Description", None),
        (2, "2024-01-02", None, "x", None),
    ]


def test_a_reviewer_called_like_the_stamp_does_not_end_the_save(spark):
    rows = [("t", "lastUpdated", "A"), ("t", "A", "B"), ("t", "stranger", "A")]
    frame = spark.createDataFrame(rows, "tx_id string, reviewer string, assignment string")
    latest = frame.selectExpr("*", "timestamp'2024-01-01' ts", "0L seq")
    assert "stranger" in state_lines(latest).head().value
    only = state_lines(latest, rules=ReviewRules.of("A", "B")).head().value
    assert only == '{"t":{"A":"B","lastUpdated":"2024-01-01T00:00:00.000Z"}}'


def test_readers_keep_their_rows_while_a_snapshot_is_replaced(spark, tmp_path):
    folder = str(tmp_path / "published")
    with pytest.raises(ValueError, match="nothing is published"):
        read_snapshot(spark, folder)
    assert publish_snapshot(spark.range(5), folder) == 0
    started = read_snapshot(spark, folder)
    assert publish_snapshot(spark.range(9), folder) == 1
    assert started.count() == 5 and read_snapshot(spark, folder).count() == 9
    # Another writer has put its pointer first: the number after it is taken.
    (tmp_path / "published/published/000000000002").write_text("elsewhere")
    snapshots = __import__("countersign.sources.snapshots", fromlist=["x"])
    assert not snapshots._put_if_absent(spark, f"{folder}/published/000000000002", "mine")
    (tmp_path / "published/published/000000000002").write_text((tmp_path / "published/published/000000000001").read_text())
    assert publish_snapshot(spark.range(3), folder) == 3
    assert read_snapshot(spark, folder).count() == 3
    assert not list((tmp_path / "published/published").glob("*.tmp"))


def test_last_of_repeated_keys_holds(spark):
    texts = [
        '{"t1":{"Ann":"Z","Ann":"A","Ben":null},"t2":{"Ann":"x"},"t1":{"Ann":"Q","Ann":"A"}}',
        '{"t3":{"Ann":"","Ann":"B","lastUpdated":"2024-01-01T00:00:00.000Z","lastUpdated":"2024-01-02T00:00:00.000Z"}}',
        '{"t4":{"Ann":"B"},"t4":7}',
    ]
    rows = parse_state(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert rows_of(rows, "tx_id", "reviewer", "assignment", "ts") == [
        ("t1", "Ann", "A", None),
        ("t2", "Ann", "x", None),
        ("t3", "Ann", "B", datetime(2024, 1, 2)),
    ]
    many = "{" + ",".join(f'"k{i % 20000}":{{"A":"{i}"}}' for i in range(40000)) + "}"
    got = parse_state(spark.createDataFrame([(many,)], "value string"))
    assert got.count() == 20000 and got.where("assignment < 20000").count() == 0
