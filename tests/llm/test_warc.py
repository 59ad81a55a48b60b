import hashlib
import zlib
from pathlib import Path

import pytest

from countersign.llm import warc

PAGE = "<html>" + "x" * 120
ROWS = [
    (5, "http://a/ü?q=1", PAGE), (3, "http://b/", PAGE), (9, None, PAGE), (1, "http://c\r\nX: y", "short"), (2, "u", "short"),
    (7, "u", None), (8, "u", ""), (None, "n", PAGE), (11, "u", "é😀" * 40), (11, "u", "é😀" * 40), (12, "u", "é😀" * 40),
]
SCHEMA = "page_id long, url string, html string, record_type int"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        refers = first.get(html) if len(data) >= 100 and first.get(html) != i else None
        kind = "response" if refers is None else "revisit"
        out.append((i, url, kind, len(data), hashlib.sha256(data).hexdigest(), refers, (html or "") if refers is None else None))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    manifest = warc.write(frame(spark), str(tmp_path / "w"), shard_bytes=200, file_bytes=600)
    assert manifest.agg({"records": "sum"}).first()[0] == len(ROWS) and manifest.count() > 2
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(ROWS)
    for row in manifest.collect():
        data = (tmp_path / "w" / row.name).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (row.bytes, row.sha256)
    assert not list((tmp_path / "w" / "_temporary").iterdir())


def test_equal_input_gives_equal_files(spark, tmp_path):
    for name, parts in (("a", 1), ("b", 7)):
        warc.write(frame(spark).repartition(parts), str(tmp_path / name), shard_bytes=300, file_bytes=700)
    files = [{p.name: p.read_bytes() for p in Path(tmp_path / n).glob("*.gz")} for n in "ab"]
    assert files[0] == files[1] and len(files[0]) > 1


def test_ids_ascend_over_files(spark, tmp_path):
    pages = spark.range(300).selectExpr("(id * 7919) % 300 AS page_id", "'u' AS url", "repeat(CAST(id AS string), 50) AS html")
    warc.write(pages, str(tmp_path / "w"), shard_bytes=4000, file_bytes=1500)
    ids = []
    for path in sorted((tmp_path / "w").glob("*.gz")):
        with path.open("rb") as stream:
            rows = [warc.parsed(m) for m in warc.members(stream, 100)]
        ids += [r["page_id"] for r in rows if r]
        assert rows[0] is None
    assert ids == list(range(300))


def test_files_outside_the_manifest_are_ignored(spark, tmp_path):
    warc.write(frame(spark), str(tmp_path / "w"))
    (tmp_path / "w" / "pages-999999-0000.warc.gz").write_bytes(b"half a file")
    assert warc.read(spark, str(tmp_path / "w")).count() == len(ROWS)


def test_damage_is_found(spark):
    record = zlib.decompress(warc.page_record(1, "u", "hello", hashlib.sha256(b"hello").hexdigest(), None), 31)
    assert warc.parsed(record)["html"] == "hello"
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(record.replace(b"hello", b"hellO"))


def test_empty_table(spark, tmp_path):
    assert warc.write(frame(spark, []), str(tmp_path / "w")).count() == 0
    assert warc.read(spark, str(tmp_path / "w")).count() == 0
    assert warc.round_trip(frame(spark)).count() == len(ROWS)
