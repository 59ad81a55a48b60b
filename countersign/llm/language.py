"""Language ID by Bayesian fusion of text, declared language, address suffix and host.

    log P(lang | evidence) = log prior(lang | host) + log P(text | lang) + log P(declared | lang) + const

* Text: counts of hashed letter trigrams per language over all labelled rows, add-one smoothed.
  Trigrams overlap, so their log likelihood is divided by three.
* Host prior, smoothed over a hierarchy by grouped aggregation over all rows: all rows, then the
  address suffix, then the host; each level adds the level above as ``STRENGTH`` rows.
* Declared language: how often rows of each language (by text alone) declare it.

The counts of the last two come from the text-only decision on every row, so no row's own
declaration decides how far declarations are believed.

Edge cases: a NULL or empty text, or one without trigrams of letters, has no text evidence, is
undetermined and not accepted; NULL host, suffix or declaration is a value of its own kind (``''``); repeated
rows count as often as they occur; without any labelled row there are no languages and every
``language`` is NULL; other columns pass through, columns of the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices, utf8

BUCKETS = 8192
STRENGTH = 20.0
#: A text is accepted if a language is at least this likely and letters make up this share.
LEAST_POSTERIOR = 0.4
#: Hosts (or kinds of declarations) up to which their priors are sent to all tasks.
SENT_GROUPS = 50_000
LEAST_LETTERS = 0.1
_NOT_TEXT = np.ones(256, bool)
_NOT_TEXT[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_FOLD[_NOT_TEXT] = 32


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document of each trigram that is not blank, and letters per document."""
    data, offsets = utf8(texts)
    letter = ~_NOT_TEXT[data]
    folded = _FOLD[data]
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    letters = np.bincount(doc[letter], minlength=len(texts))
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    code = (folded[:-2] * np.uint64(961748927) ^ folded[1:-1] * np.uint64(573259391) ^ folded[2:]) * np.uint64(0x9E3779B97F4A7C15)
    keep = (doc[:-2] == doc[2:]) & (letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:] >= 2)
    return (code[keep] >> np.uint64(51)).astype(np.int64), doc[:-2][keep], letters


class TextModel:
    """Log probabilities of trigram buckets, one row per language."""

    def __init__(self, languages: Sequence[str], counts: np.ndarray):
        self.languages = list(languages)
        smooth = counts + 1.0
        self.log = (np.log(smooth / smooth.sum(axis=1, keepdims=True)) / 3).astype(np.float64)

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bucket, doc, letters = _trigrams(texts)
        out = np.stack([np.bincount(doc, row[bucket], minlength=len(texts)) for row in self.log], axis=1)
        grams = np.bincount(doc, minlength=len(texts))
        return np.where(grams[:, None] > 0, out, np.nan), letters


def fit(documents: DataFrame, text: Column, label: Column) -> TextModel:
    """Counts over all labelled rows; the model's size follows the number of labels, not of rows."""
    rows = documents.select(text.cast("string").alias("text"), label.cast("string").alias("label"))
    rows = rows.where(F.col("label").isNotNull() & (F.col("label") != "") & F.col("text").isNotNull())
    languages = sorted(r.label for r in rows.select("label").distinct().collect())
    place = {name: i for i, name in enumerate(languages)}

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                lang = np.array([place.get(x, -1) for x in piece.column("label").to_pylist()])
                bucket, doc, _ = _trigrams(piece.column("text"))
                of = lang[doc]
                keep = of >= 0
                flat = np.bincount(of[keep] * BUCKETS + bucket[keep], minlength=total.size)
                total += flat.reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": lang, "bucket": bucket, "n": total[lang, bucket]})

    found = rows.mapInArrow(counts, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((len(languages), BUCKETS))
    frame = found.toArrow()  # at most BUCKETS rows per label
    table[frame["lang"].to_numpy(), frame["bucket"].to_numpy()] = frame["n"].to_numpy()
    return TextModel(languages, table)


def _small(groups: DataFrame) -> DataFrame:
    """Sent to all tasks if its rows are few; otherwise Spark joins by shuffle."""
    groups = checkpointed(groups)
    return F.broadcast(groups) if groups.count() <= SENT_GROUPS else groups


def identify(
    documents: DataFrame,
    model: TextModel,
    text: Column,
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
    strength: float = STRENGTH,
) -> DataFrame:
    """``documents`` with ``language``, ``posterior``, ``text_language`` and ``accepted``."""
    made = ("language", "posterior", "text_language", "accepted")
    # Columns that only pass through stay in one struct, so that no name clashes with one used here.
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c.lower() not in made]).alias("_row")
    languages = model.languages
    if not languages:
        nothing = F.lit(None).cast("string")
        return documents.select(row).select(
            "_row.*", nothing.alias("language"), F.lit(0.0).alias("posterior"), nothing.alias("text_language"),
            F.lit(False).alias("accepted"),
        )

    def known(column: Column | None) -> Column:
        return F.coalesce(column.cast("string"), F.lit("")) if column is not None else F.lit("")

    @F.arrow_udf("struct<s:array<double>,letters:double>")
    def text_scores(texts: pa.Array) -> pa.Array:
        out, letters = [], []
        for piece in slices(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
            s, n = model.scores(piece.column("t"))
            out += [None if np.isnan(row[0]) else row for row in s]
            letters += n.tolist()
        return pa.StructArray.from_arrays(
            [pa.array(out, pa.list_(pa.float64())), pa.array(letters, pa.float64())], ["s", "letters"]
        )

    names = F.array(*map(F.lit, languages))
    top = F.array_max(F.col("_t.s"))
    scored = documents.select(
        row,
        text_scores(text.cast("string")).alias("_t"),
        F.length(F.coalesce(text.cast("string"), F.lit(""))).alias("_chars"),
        known(declared).alias("_declared"),
        known(host).alias("_host"),
        known(suffix).alias("_suffix"),
    ).withColumn("text_language", F.get(names, F.array_position("_t.s", top).cast("int") - 1))
    evidence = checkpointed(
        scored.where(F.col("text_language").isNotNull())
        .groupBy("_declared", "_suffix", "_host", "text_language")
        .agg(F.count("*").alias("n"))
    )
    # One count per language: the top of the hierarchy.
    per_language = {r.text_language: r.n for r in evidence.groupBy("text_language").agg(F.sum("n").alias("n")).collect()}
    whole = sum(per_language.values()) + len(languages)
    overall = F.array(*[F.lit((per_language.get(x, 0) + 1.0) / whole) for x in languages])

    # Counts by place of the language in the model: no column or expression per language.
    place = F.array_position(names, F.col("text_language")).cast("int") - 1
    placed = evidence.withColumn("_place", place)
    places = F.sequence(F.lit(0), F.lit(len(languages) - 1))

    def counted(by: list[str]) -> DataFrame:
        """Per group of ``by`` the rows of each language in model order, and of all."""
        got = placed.groupBy(*by, "_place").agg(F.sum("n").alias("n")).groupBy(*by)
        got = got.agg(F.map_from_entries(F.collect_list(F.struct("_place", "n"))).alias("_n"), F.sum("n").alias("_total"))
        return got.withColumn("_n", F.transform(places, lambda i: F.coalesce(F.try_element_at("_n", i), F.lit(0)).cast("double")))

    def shares(by: list[str], above: DataFrame | None, on: list[str], prior: Column, name: str) -> DataFrame:
        """Per group of ``by`` the share of each language in model order, smoothed by ``prior``."""
        got = counted(by)
        got = got.join(above, on) if above is not None else got
        part = F.zip_with("_n", prior, lambda n, p: (n + strength * p) / (F.col("_total") + strength))
        return got.select(*by, part.alias(name))

    by_suffix = shares(["_suffix"], None, [], overall, "_above")
    by_host = shares(["_suffix", "_host"], by_suffix, ["_suffix"], F.col("_above"), "_prior")
    # P(declared | language), smoothed over the kinds of declarations seen and one unseen.
    kinds = evidence.select("_declared").distinct().count() + 1
    whole_of = F.array(*[F.lit(float(per_language.get(x, 0) + kinds)) for x in languages])
    said = counted(["_declared"]).select(
        "_declared", F.zip_with("_n", whole_of, lambda n, total: F.log((n + 1.0) / total)).alias("_said")
    )
    fused = (
        scored.join(_small(by_host), ["_suffix", "_host"], "left")
        .join(_small(said), "_declared", "left")
        .withColumn(
            "_log",
            F.transform(
                places,
                lambda i: F.coalesce(F.get("_t.s", i), F.lit(0.0))
                + F.log(F.coalesce(F.get("_prior", i), F.get(overall, i)))
                + F.coalesce(F.get("_said", i), F.lit(0.0)),
            ),
        )
        .withColumn("_top", F.array_max("_log"))
        .withColumn("_sum", F.aggregate(F.transform("_log", lambda v: F.exp(v - F.col("_top"))), F.lit(0.0), lambda a, v: a + v))
    )
    posterior = F.lit(1.0) / F.col("_sum")
    decided = F.col("_t.s").isNotNull()
    enough = F.col("_t.letters") >= LEAST_LETTERS * F.col("_chars")
    return fused.select(
        "_row.*",
        F.when(decided, F.get(names, F.array_position("_log", F.col("_top")).cast("int") - 1)).alias("language"),
        F.when(decided, posterior).otherwise(0.0).alias("posterior"),
        "text_language",
        F.coalesce(decided & (posterior >= LEAST_POSTERIOR) & enough, F.lit(False)).alias("accepted"),
    )


# Addresses and markup of web pages.


def markup_language(html: Column) -> Column:
    """The primary subtag of the language that the ``html`` element declares."""
    found = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1)
    return F.lower(F.nullif(found, F.lit("")))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def suffix_of(url: Column) -> Column:
    return F.regexp_extract(host_of(url), r"([^.]+)$", 1)


def visible_text(html: Column) -> Column:
    """The page without scripts, styles and tags; enough to count letters in."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&#?\w+;", " ")
