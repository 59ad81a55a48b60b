"""Every registered query against its SQL, and the known counts."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from countersign.plans import tables as t
from countersign.plans.catalog import QUERIES
from countersign.plans.oracle import ORACLE
from countersign.sources import read_ledger, scratch_folder
from tests.plans import plan_of

DATA = Path("/root/testdata")
SMALL = str(DATA / "sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the benchmark tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}
SQL_TYPES["boolean"] = "BOOLEAN"


@pytest.fixture(scope="module")
def scattered(spark, tmp_path_factory):
    """The same tables as folders of several files, rows in no order."""
    folder = str(tmp_path_factory.mktemp("scattered"))
    for name in ("orders", "events"):
        rows = spark.read.parquet(f"{SMALL}/{name}.parquet")
        rows.orderBy(F.rand(5)).repartition(5).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("layout", ["one file", "scattered"])
@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, sql, scattered, name, layout):
    frame = QUERIES[name](spark, SMALL if layout == "one file" else scattered)
    expected = sql.sql(ORACLE[name])
    types = {column: SQL_TYPES[kind] for column, kind in frame.dtypes}
    assert types == dict(zip(expected.columns, map(str, expected.types)))
    got = comparable(frame.columns, [tuple(r) for r in frame.collect()])
    assert got and got == comparable(expected.columns, expected.fetchall())
    assert "Python" not in plan_of(frame)


def test_contract(spark):
    assert set(ORACLE) == set(QUERIES) <= set(entry_point.oracle_sql())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert tuple(entry_point.entry(spark).head()) == (1500, 34, 118, 1466)


COUNTS = {
    "sf0.001": (1500, 34, 118, 1466),
    "sf0.01": (15000, 297, 1247, 14703),
    "sf0.1": (150000, 3193, 12684, 146807),
}
REMAINING = {
    "sf0.001": {(True, "A"): 1436, (True, "B"): 1433, (False, "A"): 1318, (False, "B"): 1315},
    "sf0.01": {(True, "A"): 14406, (True, "B"): 14407, (False, "A"): 13159, (False, "B"): 13160},
    "sf0.1": {
        (True, "A"): 143997,
        (True, "B"): 144096,
        (False, "A"): 131313,
        (False, "B"): 131412,
    },
}


@pytest.mark.parametrize("scale", COUNTS)
def test_known_counts(spark, scale):
    folder = str(DATA / scale)
    assert tuple(QUERIES["review_stats"](spark, folder).head()) == COUNTS[scale]
    left = QUERIES["remaining_by_reviewer"](spark, folder).collect()
    got = {(r.as_of.startswith("2024-01-31"), r.reviewer): r.remaining for r in left}
    assert got == REMAINING[scale]


def test_row_position_runs_over_files_of_several_blocks(spark):
    inbox = scratch_folder(spark, "uploads")
    raw = t.raw_ledger(spark, "/root/testdata/sf0.01")
    t.write_uploads(raw, inbox, two_headers=True)
    with t.block_size(spark, t.several_blocks(spark, inbox)):
        rows = read_ledger(spark, inbox)
        blocks = rows.select("source_path", "source_block").distinct().count()
    assert blocks >= 2 * rows.select("source_path").distinct().count()
