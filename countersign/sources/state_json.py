"""Stored review state as JSON text: id -> (reviewer -> label, lastUpdated)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countersign.functions import iso_stamp
from countersign.rules import ReviewRules

# Fixed value: the key that shares the inner map with the reviewers.
STAMP_KEY = "lastUpdated"
_TEXTS = "map<string,string>"
_STRICT = {"allowSingleQuotes": "false"}


def _last_of_each(entries: Column) -> Column:
    """The entries of a map without those whose key comes again: in JSON the last one holds.

    Only a map that repeats a key is sorted; sorting, not comparing all with all, keeps the cost
    of a map with very many entries down.
    """
    placed = F.transform(F.map_entries(entries), lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"), e["value"].alias("value")))
    ordered = F.array_sort(placed)
    # Each entry beside the one after it; named inside a lambda, the sorted array would be made per entry.
    pairs = F.arrays_zip(ordered.alias("this"), F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))).alias("next"))
    last = F.filter(pairs, lambda p: ~p["this"]["key"].eqNullSafe(p["next"]["key"]))
    single = F.map_from_entries(F.transform(last, lambda p: F.struct(p["this"]["key"], p["this"]["value"])))
    keys = F.map_keys(entries)
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), single).otherwise(entries)


def parse_state(rows: DataFrame, text: str = "value", key: str = "tx_id") -> DataFrame:
    """State texts as the long table ``(key, reviewer, assignment, ts, seq)``.

    A text that is not valid JSON stands for an empty state, and an entry that
    is no object for one without labels; entries are parsed one by one, so such
    an entry leaves the others alone. Of a key that is repeated the last value holds, for
    transactions as for reviewers. NULL and empty labels are kept apart.
    ``ts`` is the stamp of the whole entry, ``seq`` is 0: the text does not tell
    the order of the labels of one transaction.
    """
    states = rows.select(F.from_json(text, _TEXTS, _STRICT).alias("_state"))
    entries = states.select(F.explode(_last_of_each(F.col("_state"))).alias(key, "_text"))
    parsed = entries.select(key, F.from_json("_text", _TEXTS, _STRICT).alias("_entry"))
    labels = parsed.select(key, _last_of_each(F.col("_entry")).alias("_entry"))
    stamp = F.try_to_timestamp(F.col("_entry")[STAMP_KEY])
    # The outer form keeps Spark from testing the parsed map in a filter of its
    # own, which would parse each entry three times. Rows without a reviewer
    # fall to the filter below.
    exploded = labels.select(
        key, stamp.alias("ts"), F.explode_outer("_entry").alias("reviewer", "assignment")
    )
    return exploded.where(F.col("reviewer") != STAMP_KEY).select(
        key, "reviewer", "assignment", "ts", F.lit(0).cast("bigint").alias("seq")
    )


def state_lines(
    latest: DataFrame, key: str = "tx_id", rules: ReviewRules | None = None
) -> DataFrame:
    """Latest labels as one JSON text per transaction, names in order.

    ``latest`` has one row per (transaction, reviewer), so what is gathered per
    transaction is bounded by the number of its reviewers; with ``rules`` only
    those of the roster are kept, which bounds it by the roster. Nobody can be
    called like the key of the stamp: such a label would be overwritten by it.
    Each text is a state of its own; :func:`parse_state` reads them back.
    """
    if rules is not None:
        latest = latest.where(F.col("reviewer").isin(*rules.roster))
    latest = latest.where(F.col("reviewer") != STAMP_KEY)
    grouped = latest.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("reviewer", "assignment"))).alias("_labels"),
        F.max("ts").alias("_ts"),
    )
    stamp = F.struct(
        F.lit(STAMP_KEY).alias("reviewer"), iso_stamp(F.col("_ts")).alias("assignment")
    )
    entry = F.map_from_entries(F.concat("_labels", F.array(stamp)))
    state = F.create_map(F.col(key).cast("string"), entry)
    return grouped.select(key, F.to_json(state, {"ignoreNullFields": "false"}).alias("value"))


def save_state(
    latest: DataFrame, path: str, key: str = "tx_id", rules: ReviewRules | None = None
) -> None:
    """Replace the state stored at ``path``, one JSON line per transaction.

    Spark refuses to overwrite a folder that ``latest`` is read from: write the
    merged state next to the old one.
    """
    state_lines(latest, key, rules).select("value").write.mode("overwrite").text(path)
