"""Line breaks inside quotes across blocks, and headers by the first bytes of a file."""

import io
import random

import pytest
from pyspark.sql import functions as F

from countersign import operators as op
from countersign.sources import headers, read_ledger, with_row_position
from countersign.sources.ledgers import csv_options
from countersign.sources.quoted import quoted_records

FIELDS = ["Date", "Amount", "Description"]
FIXED = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionBytes": "700"}


def quoted(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def write(folder, name: str, rng: random.Random, rows: int, end: str = "\n") -> list[tuple]:
    out, lines = [], ["Description,Date,Amount" if name == "c.csv" else "Date,Amount,Description"]
    for i in range(rows):
        kind = rng.randrange(5)
        text = f"{name} row {i}"
        if kind == 1:
            text += end * rng.randrange(1, 30) + 'a "b", c' + end + "d"
        elif kind == 2:
            text = f"{end}{text}{end}Date,Amount,Description"
        elif kind == 3:
            text += end.join("x" * rng.randrange(200) for _ in range(12))
        date = f"2024-01-{i % 28 + 1:02d}"
        shown = quoted(text) if kind else text
        lines.append(f"{shown},{date},{i}" if name == "c.csv" else f"{date},{i},{shown}")
        if i % 9 == 0:
            lines.append(" " * (i % 3))
        out.append((name, date, str(i), text.replace("\r\n", "\n")))
    (folder / name).write_bytes((end.join(lines) + (end if rows % 2 else "")).encode())
    return out


@pytest.fixture
def small_blocks(setting):
    for name, value in FIXED.items():
        setting(name, value)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_one_task_per_file(spark, small_blocks, tmp_path, end):
    rng = random.Random(7)
    want = [row for name, rows in (("a.csv", 60), ("b.csv", 33), ("c.csv", 41), ("d.csv", 0)) for row in write(tmp_path, name, rng, rows, end)]
    frame = read_ledger(spark, str(tmp_path), multi_line=True)
    got = sorted(map(tuple, frame.select("source_file", *FIELDS).collect()))
    assert got == sorted(want)
    whole = spark.read.options(**csv_options(), multiLine="true").option("pathGlobFilter", "[ab].csv").csv(str(tmp_path))
    ours = frame.where("source_file in ('a.csv', 'b.csv')").select(*FIELDS)
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, whole.select(*FIELDS).collect()))


@pytest.mark.parametrize("sent_blocks", [0, 1000])
def test_several_tasks_per_file_and_blocks_inside_quotes(spark, small_blocks, tmp_path, sent_blocks):
    write(tmp_path, "a.csv", random.Random(2), 80)
    spark.read.text(str(tmp_path / "a.csv"))
    records = quoted_records(spark, str(tmp_path), str(tmp_path / "land"), {"pathGlobFilter": "*.csv"}, sent_blocks=sent_blocks)
    assert records.count() >= 80
    assert records.select("source_block").distinct().count() > 10
    assert spark.read.parquet(str(tmp_path / "land/inside")).count() > 3
    assert records.where(F.startswith("value", F.lit("Date,Amount"))).count() == 0


def test_positions_follow_the_file(spark, small_blocks, tmp_path):
    want = write(tmp_path, "a.csv", random.Random(3), 70) + write(tmp_path, "b.csv", random.Random(4), 50)
    rows = op.required_fields(read_ledger(spark, str(tmp_path), multi_line=True))
    placed = with_row_position(rows, str(tmp_path / "landing"))
    got = {(r.source_file, r.row_idx): r.Description for r in placed.collect()}
    assert got == {(name, int(amount)): text for name, _, amount, text in want}


def test_open_quote_blank_files_and_a_long_header(spark, small_blocks, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Amount,Description\n2024-01-01,1,"never closed\n' + "2024-01-02,2,x\n" * 200)
    (tmp_path / "b.csv").write_text("\n  \n")
    (tmp_path / "c.csv").write_text(f'"{"long" * 400}\n",Date,Amount,Description\nq,2024-01-03,3,"y\nz"\n')
    rows = read_ledger(spark, str(tmp_path), multi_line=True)
    got = {r.source_file: r for r in rows.select("source_file", *FIELDS).collect()}
    assert rows.count() == 2 and got["c.csv"].Description == "y\nz" and got["a.csv"].Amount == "1"


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


@pytest.mark.parametrize("rows", [10, 500_000])
def test_header_costs_the_same_for_any_length(rows):
    stream = Counted(b"\xef\xbb\xbf\n  \r\nDate,Amount\r\n" + b"2024-01-01,5\n" * rows)
    assert headers.first_record(stream) == "Date,Amount"
    assert stream.taken <= headers.FIRST_BYTES


@pytest.mark.parametrize(
    "data,header",
    [
        (b"", None),
        (b"\n \r\n\r", None),
        (b"Date", "Date"),
        (b'"two\nlines",Date\nx', '"two\nlines",Date'),
        (b'"never\nclosed', '"never'),
        (b"a" * 20000 + b"\rb", "a" * 20000),
        (b'say "hi,Date\n' + b"x\n" * (1 << 20), 'say "hi,Date'),
    ],
)
def test_first_record(data, header):
    stream = Counted(data)
    found = headers.first_record(stream)
    assert found == header or (found or "").lstrip("﻿") == header
    assert stream.taken <= 2 * headers.MOST_BYTES + headers.FIRST_BYTES


def test_stores_that_only_spark_reads_are_scanned(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("Date,Amount\n2024-01-01,1\n")
    paths = spark.createDataFrame([("viewfs://store/a.csv",)], "p string")
    assert [tuple(r) for r in headers.first_records(paths, "p").collect()] == [("viewfs://store/a.csv", None, False)]
    unreached = lambda files, path: files.selectExpr(f"{path} AS path", "string(null) AS header", "false AS reached")
    monkeypatch.setattr("countersign.sources.ledgers.first_records", unreached)
    assert read_ledger(spark, str(tmp_path)).count() == 1
