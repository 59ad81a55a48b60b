"""A backlog in sorted ranges stays what a sort of everything would give."""

import random

from pyspark.sql import functions as F

from countersign.streaming import build_backlog, merge_backlog, read_backlog
from countersign.streaming.backlog import ranges_of

COLUMNS = "tx_id string, row_idx bigint, conflict boolean, submitted boolean"


def test_merges_rewrite_only_the_ranges_they_touch(spark, tmp_path):
    rng, folder = random.Random(6), str(tmp_path)
    state = {i: (False, i % 3 == 0) for i in range(900)}
    frame = lambda keys: spark.createDataFrame([(f"t{i}", i, *state[i]) for i in keys], COLUMNS)
    build_backlog(frame(state), folder, range_rows=60)
    built = {r.path for r in ranges_of(spark, folder)}
    assert len(built) >= 14
    for step, keys in enumerate([[5, 6], [7], rng.sample(range(900), 3), [*range(900, 1300)], [1299]]):
        before = {r.path for r in ranges_of(spark, folder)}
        for i in keys:
            state[i] = (step == 2, rng.random() < 0.5)
        written = merge_backlog(frame(keys), folder, range_rows=60)
        ranges = ranges_of(spark, folder)
        after = {r.path for r in ranges}
        assert after == (before & after) | set(written)
        if step != 3:
            assert len(before - after) <= 2 * len(keys) and len(before & after) >= 8
        rows = [(r.row_idx, r.rank_key) for path in (x.path for x in ranges) for r in spark.read.parquet(path).collect()]
        want = sorted((0 if c or not s else 1, i) for i, (c, s) in state.items())
        # File after file, row after row: no sort is needed to read the order.
        assert [(k, i) for i, k in rows] == want
        assert max(r.rows for r in ranges) <= 120
    assert read_backlog(spark, folder).columns == ["tx_id", "row_idx", "conflict", "submitted", "rank_key"]
    assert len(list((tmp_path / "manifest").glob("version=*"))) == 2
    again = merge_backlog(frame([1299]), folder, range_rows=60)
    assert again and read_backlog(spark, folder).count() == len(state)


def test_empty_backlog(spark, tmp_path):
    none = spark.createDataFrame([], COLUMNS)
    build_backlog(none, str(tmp_path))
    merge_backlog(spark.createDataFrame([("a", 0, False, False)], COLUMNS), str(tmp_path))
    assert read_backlog(spark, str(tmp_path)).select(F.col("tx_id")).collect()[0][0] == "a"
