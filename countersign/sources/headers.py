"""The first record of every file, by a read of its first bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame

# Bytes read at once, and bytes within which a header has to end.
FIRST_BYTES = 1 << 13
MOST_BYTES = 1 << 20
_LINE = re.compile(rb"\r\n|\n|\r")


def first_record(stream: BinaryIO) -> str | None:
    """The first record that is not blank; None if there is none.

    Line breaks inside quotes belong to it. Only as many bytes are read as it takes, whatever
    the length of the stream; a quote still open after ``MOST_BYTES`` is taken as no quote.
    """
    data, ended = b"", False
    while True:
        # A carriage return at the end may be half of a line break.
        lines = _LINE.split(data if ended or not data.endswith(b"\r") else data[:-1])
        known = lines if ended or len(data) >= MOST_BYTES else lines[:-1]
        for n, line in enumerate(known):
            if not line.removeprefix(b"\xef\xbb\xbf").strip():
                continue
            quotes = 0
            for last in range(n, len(known)):
                quotes += known[last].count(b'"')
                if quotes % 2 == 0:
                    return b"\n".join(known[n : last + 1]).decode(errors="replace")
            if ended or len(data) >= MOST_BYTES:
                return line.decode(errors="replace")
            break
        if ended:
            return None
        piece = stream.read(max(FIRST_BYTES, len(data)))
        data, ended = data + piece, not piece


def _opened(uri: str) -> BinaryIO | None:
    """The file at a listed address, or None if only Spark can reach its store."""
    from pyarrow import fs

    try:
        store, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
        return store.open_input_file(path)
    except (pa.ArrowException, OSError):
        return None


def first_records(files: DataFrame, path: str) -> DataFrame:
    """``path, header, reached`` for the file addresses in the column ``path``.

    Each task opens its files by ranges: what is read does not grow with their size. Files in a
    store that the tasks' Python cannot open come back with ``reached`` false.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            headers, reached = [], []
            for uri in paths:
                stream = _opened(uri)
                reached.append(stream is not None)
                if stream is None:
                    headers.append(None)
                    continue
                with stream:
                    headers.append(first_record(stream))
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(headers, pa.string()), pa.array(reached)],
                ["path", "header", "reached"],
            )

    return files.select(path).mapInArrow(read, "path string, header string, reached boolean")
