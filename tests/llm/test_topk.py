import math

import pytest
from pyspark.sql import functions as F

from countersign.llm import topk


def brute(rows, k, asked, scale=64):
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in usable:
        if asked(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


SCHEMA = "vec_id long, embedding array<double>, score string, rank string"


def run(spark, rows, k, asked, **options):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {tuple(r) for r in topk.exact_top_k(frame.repartition(3), asked, k, **options).collect()}


@pytest.mark.parametrize("spread,block", [(1.0, 4096), (0.02, 3), (4000.0, 4), (1e7, 4096)])
def test_equals_brute_force(spark, spread, block):
    import random

    rng = random.Random(int(spread))
    rows = [(i, [rng.choice([-1, 0, 0.5, 1, rng.random()]) * spread for _ in range(5)]) for i in range(160)]
    rows += [(200 + i, [spread] * 5) for i in range(40)]  # ties
    rows += [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0]), (502, [math.nan] * 5), (520, [math.inf] * 5), (None, [1.0] * 5)]
    got = run(spark, rows, 7, F.col("vec_id") % 20 == 0, block=block)
    assert got == brute(rows, 7, lambda i: i % 20 == 0)


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (20, [-1.0, 3.0])]
    assert run(spark, rows, 20, F.col("vec_id") % 20 == 0) == brute(rows, 20, lambda i: i % 20 == 0)
    assert run(spark, rows[:1], 20, F.col("vec_id") % 20 == 0) == set()


def test_nothing_usable(spark):
    assert run(spark, [], 3, F.lit(True)) == set()
    assert run(spark, [(1, None), (2, [])], 3, F.lit(True)) == set()
