"""The corpus pipeline: stages over documents, each written and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countersign.llm import decontaminate, mixing, ngram_join, secrets
from countersign.llm.common import checkpointed, shared_folder, small_batches, table
from countersign.llm.queries import document_languages

#: Ids up to which a list of dropped documents is sent to all tasks.
SENT_IDS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough; ``lang`` stays as declared."""
    small_batches(spark)
    # The document goes along as one column: it may have columns that are named like the results.
    whole = docs.select(F.struct(*docs.columns).alias("document"), "text", "lang", "source")
    return document_languages(whole).where("accepted").select("document.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (five words, similarity 0.8): that of the least id.

    Documents without words and with a NULL id stay. Where ids repeat, a row is known by its id and
    its set of word runs: different texts of one id are documents of their own, and of rows that
    repeat both one stays, that of the least text.
    """
    small_batches(spark)
    rule = ngram_join.Rule(5, 80, 100)
    found = ngram_join.grouped(docs, rule)
    known = checkpointed(found.where("doc_id is not null").select("doc_id", "set_key", "first"))
    ids = known.groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_and("first").alias("first"))
    touched = checkpointed(ids.where("rows > 1 or not first").select("doc_id", "rows"))
    few = touched.count() <= SENT_IDS
    touched = F.broadcast(touched) if few else touched
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*docs.columns).alias("row"))
    told = rows.join(touched, rows.id == touched.doc_id, "left").select("id", "row", "rows")
    out = told.where("rows is null").select("row")
    again = known.join(touched.where("rows > 1").select("doc_id"), "doc_id", "left_semi")
    if again.limit(1).count():
        sets = again.where("first and set_key is not null").select("doc_id", "set_key").distinct()
        repeated = told.where("rows > 1").withColumn("key", ngram_join.set_keys(rule)(F.col("row.text")))
        empty = repeated.where("key is null").select("row")
        once = (
            repeated.join(sets, (repeated.id == sets.doc_id) & (repeated.key == sets.set_key))
            .groupBy("id", "key")
            .agg(F.min_by("row", F.struct("row.text", F.xxhash64("row"))).alias("row"))
        )
        out = out.union(empty).union(once.select("row"))
    return out.select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark and ``n_chars`` counted anew."""
    small_batches(spark)
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left."""
    small_batches(spark)
    found = mixing.mix(docs)
    return found.select("doc_id", "lang", "source", "size", "source_size", "target", "taken", "repeats", "rest")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secret_scan),
    ("mix", mix),
]
#: No SQL twin: language, edit distances and guess costs have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other; every result goes through Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
