from fractions import Fraction

from pyspark.sql import functions as F

from countersign.llm import mixing


def level(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    rest, open_, out = Fraction(sum(sizes.values())), set(names), {}
    while open_:
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = Fraction(3 * sizes[s])
            rest -= 3 * sizes[s]
        open_ -= full
    return out


def test_targets_and_budgets(spark):
    rows = [(i, "w " * (1 + i * 37 % 50), s) for i, s in enumerate("aaaaaaaaaabccccccccccccdddeeeffffffffffffffffff")]
    rows += [(100, "x y z", None), (101, "x y", None), (102, None, "z"), (103, "one", "\U0001f600"), (104, "one two", "ﬁ")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.repeats * r.size + r.rest
    want = level(sizes)
    for r in got:
        assert abs(r.target - float(want[r.source])) < 1e-6 and r.source_size == sizes[r.source]
    for s in sizes:
        assert taken[s] == int(want[s] + Fraction(1, 10**6))


def test_runs_agree_and_ranges_do_not_matter(documents):
    first = {r.doc_id: r.taken for r in mixing.mix(documents).collect()}
    again = {r.doc_id: r.taken for r in mixing.mix(documents.repartition(5), ranges=16).collect()}
    assert first == again


def test_odd_rows(odd, none):
    got = mixing.mix(odd, keep_text=True)
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    assert sum(r.taken for r in got.collect()) <= sum(r.size for r in got.collect())
    assert mixing.mix(none).count() == 0


def test_columns_with_inner_names_pass_through(documents):
    names = ("_key", "_range", "_budget", "_left", "_before", "_inside", "row", "key", "Taken")
    wide = documents.select("*", *[F.lit(f"v{n}").alias(n) for n in names])
    got = mixing.mix(wide)
    assert {tuple(r) for r in got.select(*names[:-1]).distinct().collect()} == {tuple(f"v{n}" for n in names[:-1])}
    plain = {(r.doc_id, r.taken) for r in mixing.mix(documents).collect()}
    assert {(r.doc_id, r.taken) for r in got.select("doc_id", "taken").collect()} == plain
