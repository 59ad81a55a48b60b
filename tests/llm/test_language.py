import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from countersign.llm import language
from countersign.llm.queries import document_languages, page_language
from tests.llm.conftest import SMALL


def test_given_documents(spark, documents):
    found = document_languages(documents).select("doc_id", "lang", "language", "text_language", "accepted", "posterior").collect()
    assert len(found) == documents.count()
    assert sum(r.lang == r.text_language for r in found) >= 0.97 * len(found)
    assert sum(r.lang == r.language for r in found) >= 0.99 * len(found)
    assert all(r.accepted for r in found) and all(0 < r.posterior <= 1 for r in found)
    pages = page_language(spark, SMALL)
    declared = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", language.markup_language(F.col("html")).alias("d"))
    both = pages.join(declared, "page_id").collect()
    assert sum(r.d == r.language for r in both) >= 0.95 * len(both)


def test_evidence_decides_short_texts(spark, documents):
    """A text of no telling letters takes the language of its declaration, suffix and host."""
    model = language.fit(documents, F.col("text"), F.col("lang"))
    rows = [(i, r.text, r.lang, f"h.{r.lang}") for i, r in enumerate(documents.where("n_chars > 300").collect())]
    rows += [(9000 + i, "xqz", lang, f"h.{lang}") for i, lang in enumerate(("de", "fr", "es", "en"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, said string, host string")
    found = language.identify(frame, model, F.col("text"), F.col("said"), F.col("host"), language.suffix_of(F.col("host")))
    short = {r.said: r.language for r in found.where("doc_id >= 9000").collect()}
    assert short == {x: x for x in ("de", "fr", "es", "en")}


def test_every_label_is_a_language(spark):
    """Of 260 labels, 60 with half the rows of the others, each text gets its own."""
    words = ["".join(chr(97 + (7 * i + 11 * j * (i + 3)) % 26) for j in range(40)) + f"{chr(97 + i % 26)}{chr(97 + i // 26)}" * 20 for i in range(260)]
    rows = [(i, words[i], f"l{i:03}") for i in range(260) for _ in range(1 if i >= 200 else 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(frame, F.col("text"), F.col("lang"))
    assert model.languages == sorted({r[2] for r in rows})
    found = language.identify(frame, model, F.col("text"), F.col("lang"), F.lit("h"), F.lit("s")).collect()
    assert len(found) == len(rows) and all(r.language == r.text_language == r.lang and r.accepted for r in found)


def test_scores_are_the_sums_of_a_plain_loop(spark):
    import pyarrow as pa

    rows = [("a a b", "x"), ("aab ba", "x"), ("ccc", "y")]
    frame = spark.createDataFrame(rows, "text string, lang string")
    model = language.fit(frame, F.col("text"), F.col("lang"))
    texts = pa.array(["abab", "", None, "1 2 3", "ccc c"], pa.string())
    scores, letters = model.scores(texts)
    whole, _ = model.scores(pa.array(["abab"]))
    assert (scores[0] == whole[0]).all() and letters.tolist() == [4, 0, 0, 0, 4]
    assert [bool((s != s).all()) for s in scores] == [False, True, True, True, False]


def test_addresses(spark):
    urls = [("https://user@Www.Example.co.FR:80/a?b", "www.example.co.fr", "fr"), ("nothing", "", ""), (None, "", "")]
    frame = spark.createDataFrame([(u,) for u, _, _ in urls], "u string")
    got = frame.select(language.host_of(F.col("u")), language.suffix_of(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [u[1:] for u in urls]


def test_odd_rows(odd, none):
    rows = document_languages(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count() and by[2].language is None and not by[3].accepted and not by[4].accepted
    assert by[None].language is not None
    assert document_languages(none).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.language for r in document_languages(unlabelled).collect()} == {None}


def test_columns_with_inner_names_pass_through(spark, documents):
    names = ("_t", "_host", "_suffix", "_declared", "_chars", "_row", "_prior", "_said", "_log", "_top", "_sum", "host")
    wide = documents.select("*", *[F.lit(f"v{n}").alias(n) for n in names])
    got = document_languages(wide)
    assert {tuple(r) for r in got.select(*names).distinct().collect()} == {tuple(f"v{n}" for n in names)}
    made = ("doc_id", "language", "posterior")
    assert sorted(got.select(*made).collect()) == sorted(document_languages(documents).select(*made).collect())


def test_stage_hands_on_columns_named_like_results(spark, documents):
    from corpus_pipeline import language as stage

    wide = documents.select("*", F.lit("a").alias("accepted"), F.lit("b").alias("language"), F.lit("c").alias("document"))
    got = stage(spark, wide, SMALL)
    assert got.columns == wide.columns and got.count() == documents.count()
    assert [tuple(r) for r in got.select("accepted", "language", "document").distinct().collect()] == [("a", "b", "c")]


def test_posterior_equals_a_plain_loop(spark):
    """Counts, smoothing and fusion over a small table, by loops over rows and languages."""
    rows = [("aab ba", "x", "h1", "s"), ("abba aa", "x", "h1", "s"), ("ccc cdc", "y", "h1", "s"), ("dcc", "y", "h2", "s"), ("bab", None, "h3", "r"), ("q1", "x", "h2", "s")]
    frame = spark.createDataFrame(rows, "text string, lang string, host string, suffix string")
    model = language.fit(frame, F.col("text"), F.col("lang"))
    assert model.languages == ["x", "y"]
    scores, _ = model.scores(pa.array([r[0] for r in rows]))
    first = [None if math.isnan(s[0]) else int(s[1] > s[0]) for s in scores]

    def count(lang, *equal):
        return sum(f == lang and all((r[i] or "") == v for i, v in equal) for f, r in zip(first, rows, strict=True))

    kinds = len({r[1] or "" for f, r in zip(first, rows, strict=True) if f is not None}) + 1
    want = []
    for (_, lang, host, suffix), s in zip(rows, scores, strict=True):
        logs = []
        for k in (0, 1):
            share = (count(k) + 1) / (count(0) + count(1) + 2)
            for equal in (((3, suffix),), ((3, suffix), (2, host))):
                total = count(0, *equal) + count(1, *equal)
                if total:
                    share = (count(k, *equal) + language.STRENGTH * share) / (total + language.STRENGTH)
            said = math.log((count(k, (1, lang or "")) + 1) / (count(k) + kinds))
            logs.append(s[k] + math.log(share) + said)
        top = max(logs) if first[len(want)] is not None else None
        want.append(0.0 if top is None else 1 / sum(math.exp(v - top) for v in logs))
    found = language.identify(frame, model, F.col("text"), F.col("lang"), F.col("host"), F.col("suffix")).collect()
    got = {(r.text, r.host): r.posterior for r in found}
    for r, p in zip(rows, want, strict=True):
        assert got[r[0], r[2]] == pytest.approx(p)
