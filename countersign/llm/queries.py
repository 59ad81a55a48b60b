"""Queries of the corpus operators and their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    class_lm,
    decontaminate,
    html_extract,
    language,
    lexical,
    license_scan,
    mixing,
    ngram_join,
    secrets,
    token_align,
    topk,
    toxicity,
    warc,
)
from .common import table


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix of all documents takes of each."""
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "repeats", "rest")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS key
  FROM documents
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT *, 3 * source_size * sum(weight) OVER later
            <= weight * (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER before, 0)) AS is_full
  FROM ranked
  WINDOW later AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
         before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT sum(source_size)::BIGINT - coalesce(3 * sum(source_size) FILTER (is_full), 0)::BIGINT AS words,
         sum(weight) FILTER (NOT is_full) AS weight
  FROM filled
), targets AS (
  SELECT f.source, f.source_size,
         CASE WHEN is_full THEN (3 * f.source_size)::DOUBLE
              ELSE f.weight::DOUBLE * l.words::DOUBLE / l.weight::DOUBLE END AS target
  FROM filled f, level l
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 1e-6)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS repeats FROM placed
), parts AS (
  SELECT *, least(greatest(budget - repeats * source_size - before, 0), size)::BIGINT AS rest FROM cut
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (repeats * size + rest)::BIGINT AS taken,
       repeats::BIGINT AS repeats, rest
FROM parts
"""

def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.digest(table(spark, folder, "documents"))


def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, folder, "pages")
    found = html_extract.main_text(pages, html_extract.fit(pages))
    return found.select("page_id", "url", "text", "n_chars")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Severity of every document, learnt from a bounded sample of the labels."""
    documents = table(spark, folder, "documents")
    model = toxicity.fit(documents, table(spark, folder, "labels"))
    return toxicity.rate(documents.select("doc_id", "text"), model).select("doc_id", "severity", "grade", "toxic")


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items in every document, with the least number of edits."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles overlap to nine tenths."""
    return ngram_join.similar(table(spark, folder, "documents"), ngram_join.Rule(3, 90, 100))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to WARC archives and read back from them."""
    found = warc.round_trip(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


def op8_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best partners of every vector whose id is divisible by 20."""
    return topk.exact_top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

def op9_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Class-based and plain log10 probabilities of every document."""
    return class_lm.score_documents(table(spark, folder, "documents"))


def document_languages(documents: DataFrame) -> DataFrame:
    """Language of documents: their label is the declared language, their source the host."""
    model = language.fit(documents, F.col("text"), F.col("lang"))
    return language.identify(documents, model, F.col("text"), declared=F.col("lang"), host=F.col("source"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document from text, declared language and source."""
    found = document_languages(table(spark, folder, "documents"))
    return found.select("doc_id", "language", "posterior", "text_language", "accepted")


def page_language(spark: SparkSession, folder: str) -> DataFrame:
    """The same operator over web pages: markup language, address suffix and host."""
    pages = table(spark, folder, "pages")
    documents = table(spark, folder, "documents")
    model = language.fit(documents, F.col("text"), F.col("lang"))
    url, html = F.col("url"), F.col("html")
    found = language.identify(
        pages,
        model,
        language.visible_text(html),
        declared=language.markup_language(html),
        host=language.host_of(url),
        suffix=language.suffix_of(url),
    )
    return found.select("page_id", "language", "posterior", "text_language", "accepted")


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 best documents for every benchmark item."""
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, row_number() OVER () AS doc,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), d AS (
  SELECT doc_id, doc, terms, len(terms)::BIGINT AS n FROM cut WHERE len(terms) > 0
), total AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM d
), tf AS (
  SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(terms) AS term FROM d) GROUP BY ALL
), items AS (
  SELECT item_id, row_number() OVER () AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark
), asked AS (
  SELECT item, term, count(*)::BIGINT AS repeats FROM (SELECT item, unnest(terms) AS term FROM items) GROUP BY ALL
), df AS (
  SELECT term, count(*)::BIGINT AS df FROM tf SEMI JOIN asked USING (term) GROUP BY term
), rare AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total
), scored AS (
  SELECT item, doc, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score
  FROM asked JOIN rare USING (term) JOIN tf USING (term) JOIN d USING (doc), total
  GROUP BY item, doc
), ranked AS (
  SELECT item, doc_id, score,
         row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scored JOIN d USING (doc) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked JOIN items USING (item) WHERE rank <= 10
"""


def op12_token_align(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment of two tokenizers over every document."""
    return token_align.align(table(spark, folder, "documents")).documents


def op13_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License notices of every document."""
    return license_scan.scan(table(spark, folder, "documents")).drop("spans")


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_secrets": op4_secrets,
    "op5_ngram_join": op5_ngram_join,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_topk": op8_topk,
    "op9_class_lm": op9_class_lm,
    "op10_language": op10_language,
    "op11_lexical_search": op11_lexical_search,
    "op12_token_align": op12_token_align,
    "op13_license_scan": op13_license_scan,
    "page_language": page_language,
}
ORACLE = {"op6_mixing": OP6_SQL, "op7_warc": OP7_SQL, "op8_topk": OP8_SQL, "op11_lexical_search": OP11_SQL, "op13_license_scan": license_scan.oracle_sql()}
