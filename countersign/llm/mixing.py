"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets.

Built-in functions only. Edge cases: a NULL or empty text has size 0 and takes part with 0
words; a NULL source is a source of its own, last in the order; sources of size 0 have target
0; a repeated row is a document of its own; an empty table gives an empty result. Columns
beyond the named ones pass through; result columns of the same name are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, prefix_sums, word_count

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Ranges of the hash-random key; each (source, range) is sorted on its own. More for more data.
RANGES = 4096
_KEY_BITS = 60


def random_key(doc_id: Column) -> Column:
    """A number of 60 bits that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS
) -> DataFrame:
    """One row per source: ``source_size`` and ``target``, from rows of ``source`` and ``size``.

    Weights repeat along the sources in order of code points, NULL last. The targets share the
    total; one that is above ``most_epochs`` times its source's size stops there and the rest is
    shared again by weight. Each round is one distributed sum; the level of the open sources
    only rises, so the rounds end.
    """
    order = [F.col("source").asc_nulls_last()]
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = prefix_sums(totals, order, F.lit(1), "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = checkpointed(
        ranked.select("source", "source_size", (F.col("source_size") * most_epochs).alias("_most"), weight.alias("_weight"))
    )
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    # A source is full once most * open weight <= weight * open words; both sides are whole numbers.
    open_words, open_weight, full = total, None, F.lit(False)
    while True:
        row = ranked.agg(
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0)),
            F.coalesce(F.sum(F.when(full, F.col("_most"))), F.lit(0)),
        ).first()
        if (row[0], total - row[1]) == (open_weight, open_words) or not row[0]:
            break
        open_weight, open_words = row[0], total - row[1]
        wide = F.col("_most").cast("decimal(38,0)") * F.lit(open_weight)
        full = wide <= F.col("_weight").cast("decimal(10,0)") * F.lit(open_words).cast("decimal(25,0)")
    share = F.col("_weight") * F.lit(float(open_words)) / F.lit(float(open_weight or 1))
    return ranked.select(
        "source", "source_size", F.when(full, F.col("_most").cast("double")).otherwise(share).alias("target")
    )


def mix(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    ranges: int = RANGES,
    keep_text: bool = False,
) -> DataFrame:
    """``documents`` (without ``text`` unless asked for) with ``size``, ``source_size``, ``target``, ``taken``, ``repeats``, ``rest``.

    Every source gives its whole text ``repeats`` times, then the documents that come first in
    hash-random order until its budget (the target, rounded down) is used up. The document on
    the cut gives its first ``rest`` words only, so the budget is met to the word.
    """
    made = ("size", "source_size", "target", "taken", "repeats", "rest")
    carried = [c for c in documents.columns if c.lower() not in made and (keep_text or c.lower() != "text")]
    # Columns that only pass through stay in one struct, so that no name clashes with one used here.
    row = F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row")
    narrow = checkpointed(documents.select(row, "doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = source_targets(narrow, weights, most_epochs)
    key = random_key(F.col("doc_id"))
    width = (1 << _KEY_BITS) // ranges
    keyed = narrow.withColumn("_key", key).withColumn("_range", F.expr(f"_key div {width}"))
    same = F.col("k.source").eqNullSafe(F.col("o.source"))
    # One row per (source, range), at most `ranges` rows per source, whatever its size.
    sums = keyed.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    # Rows that tie in key, id and size count alike, in any order.
    inside = Window.partitionBy("source", "_range").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor(F.col("target") + F.lit(1e-6)).cast("long")
    plan = (
        placed.alias("k")
        .join(offsets.alias("o"), same & (F.col("k._range") == F.col("o._range")))
        .select(*[f"k.{c}" for c in narrow.columns], (F.col("_inside") + F.col("_offset")).alias("_before"))
        .alias("k")
        .join(targets.alias("o"), same)
        .select("k.*", "o.source_size", "o.target", budget.alias("_budget"))
        .withColumn("repeats", F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(0))
        .withColumn("_left", F.col("_budget") - F.col("repeats") * F.col("source_size") - F.col("_before"))
        .withColumn("rest", F.least(F.greatest(F.col("_left"), F.lit(0)), F.col("size")).cast("long"))
        .withColumn("taken", F.col("repeats") * F.col("size") + F.col("rest"))
    )
    return plan.select("row.*", *made)
