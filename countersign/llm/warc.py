"""WARC archives of web pages: a deterministic sharded writer, and a reader that checks digests.

Records are sorted by page id over all files. A shard is a range of ids, cut where the running
sum of payload bytes passes a multiple of the shard size, so shards follow from the data alone;
inside a shard a file is closed once its compressed size reaches a limit. Every record is a gzip
member of its own with new headers and digests and a fixed date, so equal input gives equal files.

A task writes a file under a temporary name and moves it to its own name when it is whole; a task
that runs again writes the same bytes. The manifest is written last, by Spark, from the rows of
the tasks that ended well; readers open what it lists and nothing else. Files are opened through
``pyarrow.fs`` by the address of the folder, which driver and executors must share.

Edge cases: a NULL html is an empty payload, a NULL url has no target header and is read back as
NULL; a NULL page id sorts first and is read back as NULL; of records of equal payload those with
the smallest id are responses (all of them, if rows repeat) and a NULL id is never referred to;
an empty table writes an empty manifest and reads as no rows; other columns are not archived.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prefix_sums, shared_folder

SHARD_BYTES, MOST_SHARDS = 32 << 20, 100_000
FILE_BYTES = 8 << 20
#: Payloads below this size are never replaced by a revisit.
LEAST_REVISITED = 100
DATE = "2024-01-01T00:00:00Z"
#: Groups of equal payloads up to which the list of first pages is sent to all tasks.
SENT_GROUPS = 200_000
_CHUNK = 1 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "name string, records long, bytes long, sha256 string"


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder)


def _record_id(page: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page}:{digest}:{copy}'.encode()).hexdigest()[:32])}>"


def _member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [f"{k}: {v}\r\n" for k, v in headers if v is not None]
    digest = hashlib.sha256(block).hexdigest()
    head = "WARC/1.1\r\n" + "".join(lines)
    head += f"WARC-Block-Digest: sha256:{digest}\r\nContent-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block + b"\r\n\r\n") + packer.flush()


def page_record(page: int | None, url: str | None, html: str, digest: str, first: int | None, copy: int = 0) -> bytes:
    """A response record, or a revisit of page ``first``."""
    payload = html.encode("utf-8", "replace")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers: list[tuple[str, object]] = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", _record_id(page, digest, copy)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$&'()*+,/:;=?@[]~-._")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Page-Id", page),
        ("Payload-Length", len(payload)),
    ]
    if first is None:
        return _member(headers, http + payload)
    more = [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _record_id(first, digest, 0)), ("Refers-To-Page-Id", first)]
    return _member(headers + more, http)


class _File:
    """A file under a temporary name until it is closed."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = _opened(folder)
        self.name, self.temporary = name, f"{self.folder}/_temporary/{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.sum, self.bytes, self.records = hashlib.sha256(), 0, 0
        self.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, name, 0)), ("WARC-Date", DATE),
                            ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC/1.1\r\n"))
        self.records = 0

    def write(self, member: bytes) -> None:
        self.out.write(member)
        self.sum.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> dict[str, object]:
        self.out.close()
        final = f"{self.folder}/{self.name}"
        try:
            self.fs.move(self.temporary, final)
        except OSError:  # stores that do not replace: another attempt has left the same bytes
            if self.fs.get_file_info(final).type == fs.FileType.NotFound:
                raise
            self.fs.delete_file(self.temporary)
        return {"name": self.name, "records": self.records, "bytes": self.bytes, "sha256": self.sum.hexdigest()}


def _written(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Write sorted rows; a new file for each shard and whenever one is full."""
    file, shard, roll, last, copy = None, None, 0, None, 0

    def row(file: _File) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([file.close()])

    for batch in batches:
        columns = [batch.column(c) for c in ("shard", "page_id", "url", "html", "payload_digest", "refers_to")]
        for values in zip(*columns, strict=True):
            now, page, url, html, digest, first = (v.as_py() for v in values)
            if now != shard or file.bytes >= file_bytes:
                if file:
                    yield row(file)
                roll = roll + 1 if now == shard else 0
                shard, file = now, _File(folder, f"pages-{now:06d}-{roll:04d}.warc.gz")
            copy = copy + 1 if (page, digest) == last else 0
            last = (page, digest)
            file.write(page_record(page, url, html, digest, first, copy))
    if file:
        yield row(file)


def planned(pages: DataFrame, least_revisited: int = LEAST_REVISITED) -> DataFrame:
    """``page_id, url, html`` (never NULL) with the payload's size and digest and ``refers_to``."""
    payload = F.col("html").cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).select("*", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    firsts = (
        rows.where(F.col("payload_bytes") >= least_revisited)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("_n"))
        .where("_n > 1 and first is not null")
        .select("payload_digest", "first")
    ).cache()
    if firsts.count() <= SENT_GROUPS:
        firsts = F.broadcast(firsts)
    revisit = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return rows.join(firsts, "payload_digest", "left").select(*rows.columns, revisit.alias("refers_to"))


def write(
    pages: DataFrame,
    folder: str,
    shard_bytes: int = SHARD_BYTES,
    file_bytes: int = FILE_BYTES,
    least_revisited: int = LEAST_REVISITED,
) -> DataFrame:
    """Archive ``pages`` into ``folder`` and return its manifest; files are ``pages-<shard>-<number>``."""
    spark = pages.sparkSession
    sizes = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)).alias("n")
    )
    total = sizes.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    shard_bytes = max(shard_bytes, -(-total // MOST_SHARDS))
    placed = prefix_sums(sizes, [F.col("page_id").asc_nulls_first(), F.col("n")], F.col("n").cast("long"), "before")
    starts = placed.groupBy(F.floor(F.col("before") / shard_bytes).alias("shard")).agg(F.min("page_id").alias("start"))
    # At most MOST_SHARDS rows, by the choice of the shard size.
    bounds = np.sort(np.array([r.start for r in starts.where("start is not null").collect()], np.int64))

    @F.pandas_udf("long")
    def shard(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        at = np.searchsorted(bounds, ids.where(known, 0).astype("int64"), "right") - 1
        return pd.Series(np.where(known, np.maximum(at, 0), 0), index=ids.index)

    system, path = _opened(folder)
    system.create_dir(f"{path}/_temporary", recursive=True)
    ordered = (
        planned(pages, least_revisited)
        .drop("payload_bytes")
        .withColumn("shard", shard("page_id"))
        .repartitionByRange(max(1, len(bounds)), "shard")
        .sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "url", "payload_digest")
    )
    rows = ordered.mapInArrow(lambda batches: _written(batches, folder, file_bytes), _MANIFEST)
    rows.write.mode("overwrite").json(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).json(f"{folder}/manifest")


def members(stream, chunk: int = _CHUNK) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    rest = stream.read(chunk)
    while rest:
        parts.append(unpack.decompress(rest))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
        rest = rest or stream.read(chunk)
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parsed(record: bytes) -> dict[str, object] | None:
    """A page's record as a row, its digests checked; None for records about the file."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    payload = block.partition(b"\r\n\r\n")[2]
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["Payload-Length"])
    if fields["WARC-Type"] == "response":
        if (digest, size) != (hashlib.sha256(payload).hexdigest(), len(payload)):
            raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number("Page-Id"), "url": None if url is None else unquote(url), "record_type": fields["WARC-Type"],
        "payload_bytes": size, "payload_digest": digest, "refers_to": number("Refers-To-Page-Id"),
        "html": payload.decode() if fields["WARC-Type"] == "response" else None,
    }


_ROW = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string"
_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())]
)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All page records of the files that the manifest of ``folder`` lists."""
    names = spark.read.schema(_MANIFEST).json(f"{folder}/manifest").select("name")
    fields = [f for f in _ROW.split(", ") if payloads or not f.startswith("html ")]
    schema = pa.schema([f for f in _ARROW if payloads or f.name != "html"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    found, size = [], 0
                    for record in members(stream):
                        row = parsed(record)
                        if row:
                            found.append(row if payloads else {k: v for k, v in row.items() if k != "html"})
                            size += len(record)
                        if size >= _CHUNK:
                            yield pa.RecordBatch.from_pylist(found, schema=schema)
                            found, size = [], 0
                    if found:
                        yield pa.RecordBatch.from_pylist(found, schema=schema)

    parts = max(1, min(names.count(), 10_000))
    return names.repartition(parts, "name").mapInArrow(rows, ", ".join(fields))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a fresh folder of the shared store and read the archives back."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    return read(pages.sparkSession, folder, payloads=False)
