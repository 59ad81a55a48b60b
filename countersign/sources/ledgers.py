"""Transaction files: CSV scans by header name, and CSV text at hand."""

from __future__ import annotations

import csv
import io
import re
from collections import defaultdict
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countersign.sources.headers import first_records
from countersign.sources.quoted import quoted_records
from countersign.sources.scratch import scratch_folder

# The header names a ledger is read by.
LEDGER_COLUMNS = ("Date", "Amount", "Description", "Owner")
# Where a row came from; needed to number rows in file order.
SOURCE_FILE = "source_file"
SOURCE_PATH = "source_path"
SOURCE_BLOCK = "source_block"
PROVENANCE = (SOURCE_FILE, SOURCE_PATH, SOURCE_BLOCK)
_LISTING = {"pathGlobFilter": "*.csv", "recursiveFileLookup": "true"}


def csv_options(delimiter: str = ",") -> dict[str, str]:
    """Reader options shared by batch and stream: RFC 4180 quotes, checked headers.

    Spark maps the columns of all files of one read by position. With
    ``enforceSchema`` off, a file whose header differs fails the job instead of
    having its columns swapped.
    """
    return {
        "header": "true",
        "sep": delimiter,
        "quote": '"',
        "escape": '"',
        "enforceSchema": "false",
        **_LISTING,
    }


def provenance_columns() -> list[Column]:
    return [
        F.col("_metadata.file_name").alias(SOURCE_FILE),
        F.col("_metadata.file_path").alias(SOURCE_PATH),
        F.col("_metadata.file_block_start").alias(SOURCE_BLOCK),
    ]


def read_ledger(
    spark: SparkSession,
    source: str | list[str],
    *,
    columns: tuple[str, ...] = LEDGER_COLUMNS,
    delimiter: str = ",",
    multi_line: bool = False,
    by_header: bool = True,
    listed: bool = False,
) -> DataFrame:
    """All ``.csv`` files below ``source`` as text columns picked by header name.

    A column no header names is NULL. Adds ``source_file``, ``source_path`` and
    ``source_block``. Files are grouped by their header line, one read per
    distinct header. ``by_header=False`` skips the look at the headers: for
    trees known to share one; a file that does not then fails the job.

    ``listed`` tells that ``source`` holds file addresses as Spark lists them,
    not paths. ``multi_line`` admits line breaks inside quotes: files are still read in blocks,
    but twice, and their records are written once to the shared folder
    (:mod:`countersign.sources.quoted`).
    """
    options = csv_options(delimiter)
    if listed:
        source = [_literal_path(uri) for uri in source]

    def scan(paths: str | list[str]) -> DataFrame:
        raw = spark.read.options(**options).csv(paths)
        named = [
            (F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")).alias(c)
            for c in columns
        ]
        return raw.select(*named, *provenance_columns())

    def cut(header: str, paths: list[str]) -> DataFrame:
        records = quoted_records(spark, paths, scratch_folder(spark, "records"), _LISTING)
        parsed = parse_ledger_lines(records, "value", header, columns=columns, delimiter=delimiter)
        return parsed.select(*(F.col(f"`{c}`") for c in columns), *PROVENANCE)

    if not by_header and not multi_line:
        return scan(source)
    groups = _files_by_header(spark, source)
    if not groups:
        return _no_rows(spark, columns)
    if multi_line:
        return reduce(DataFrame.unionByName, [cut(*group) for group in groups.items()])
    return reduce(DataFrame.unionByName, [scan(paths) for paths in groups.values()])


def _no_rows(spark: SparkSession, columns: tuple[str, ...]) -> DataFrame:
    texts = ", ".join(f"`{c}` string" for c in (*columns, SOURCE_FILE, SOURCE_PATH))
    return spark.createDataFrame([], f"{texts}, {SOURCE_BLOCK} bigint")


def _files_by_header(spark: SparkSession, source: str | list[str]) -> dict[str, list[str]]:
    """Paths by first record that is not blank, found by one job over the listing.

    The driver gets one row per file, as Spark's own file listing does already. Tasks read the
    first bytes of their files. Files in a store that only Spark can read are scanned by Spark.
    """
    found = first_records(files_below(spark, source), SOURCE_PATH).collect()
    first = {row.path: row.header for row in found if row.reached}
    others = [_literal_path(row.path) for row in found if not row.reached]
    if others:
        first |= _scanned_headers(spark, others)
    groups: dict[str, list[str]] = defaultdict(list)
    for path in sorted(first):
        if first[path] is not None:
            groups[first[path].lstrip("\ufeff").rstrip("\r")].append(_literal_path(path))
    return groups


def _scanned_headers(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """First lines by a scan of the files; line breaks inside a header are not looked for."""
    lines = spark.read.options(**_LISTING).text(paths)
    start = (F.col("_metadata.file_block_start") == 0) & (F.length(F.trim("value")) > 0)
    first = (
        lines.where(start)
        .withColumn("_at", F.monotonically_increasing_id())
        .groupBy(F.col("_metadata.file_path").alias("path"))
        .agg(F.min_by("value", "_at").alias("header"))
    )
    return {row.path: row.header for row in first.collect()}


def files_below(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """``source_path, uploaded_at, size`` of all ``.csv`` files below ``source``.

    ``uploaded_at`` is the time of change. Only the listing is read, no content.
    """
    listing = spark.read.format("binaryFile").options(**_LISTING)
    return listing.load(source).select(
        F.col("_metadata.file_path").alias(SOURCE_PATH),
        F.col("modificationTime").alias("uploaded_at"),
        F.col("length").alias("size"),
    )


def _literal_path(uri: str) -> str:
    """A listed URI as a path to read: decoded, pattern characters escaped."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(uri))


def parse_ledger_lines(
    rows: DataFrame,
    line: str,
    header: str = ",".join(LEDGER_COLUMNS),
    *,
    columns: tuple[str, ...] = LEDGER_COLUMNS,
    delimiter: str = ",",
    headers_among: bool = False,
) -> DataFrame:
    """Parse CSV records held in the text column ``line``; other columns stay.

    A record may have line breaks inside quotes. Blank ones are dropped; fields
    are picked by their name in ``header``. A record equal to the header is
    data, unless ``headers_among`` tells that header lines stand among them.
    """
    names = next(csv.reader([header], delimiter=delimiter))
    ddl = ", ".join(f"`{name.replace('`', '``')}` STRING" for name in names)
    parsed = F.from_csv(F.col(line), ddl, {"sep": delimiter, "quote": '"', "escape": '"'})
    kept = [c for c in rows.columns if c != line]
    fields = [
        (F.col("_row").getField(c) if c in names else F.lit(None).cast("string")).alias(c)
        for c in columns
    ]
    body = ~F.trim(F.col(line)).isin(*(["", header.strip()] if headers_among else [""]))
    return rows.where(body).withColumn("_row", parsed).select(*kept, *fields)


def ledger_from_text(
    spark: SparkSession,
    text: str,
    *,
    columns: tuple[str, ...] = LEDGER_COLUMNS,
    delimiter: str = ",",
) -> DataFrame:
    """A block of CSV text given in the program, with the number of each record.

    The first record that is not blank is the header; line breaks inside quotes
    belong to their field.
    """
    parsed = csv.reader(io.StringIO(text.lstrip("\ufeff"), newline=""), delimiter=delimiter)
    records = [fields for fields in parsed if any(field.strip() for field in fields)]
    if not records:
        raise ValueError("no header line")
    header, *body = records
    at = [header.index(c) if c in header else len(header) for c in columns]
    rows = [
        (number, *(fields[i] or None if i < min(len(fields), len(header)) else None for i in at))
        for number, fields in enumerate(body)
    ]
    texts = ", ".join(f"`{c}` string" for c in columns)
    return spark.createDataFrame(rows, f"line_no bigint, {texts}")
