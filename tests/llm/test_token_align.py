"""Alignment of two tokenizers against loops over bytes and tokens."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from countersign.llm import token_align as ta

MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def files():
    return ta.Files.read()


@pytest.fixture(scope="module")
def tokenizers(files):
    return ta.Tokenizers(files)


@pytest.fixture(scope="module")
def plain(files):
    found = Tokenizer.from_str(files.vocabulary.decode())
    found.encode_special_tokens = True
    return found


def brute(rows, tokenizers, plain):
    """Measures of (doc_id, text) rows, all by plain loops."""
    links, groups, sizes = {}, {}, {}
    total = Counter()
    for n, (_, text) in enumerate(rows):
        a = plain.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tokenizers._b.encode(text) if text else []
        of_a, of_b = [tokenizers.bytes_a[i] for i in a], [tokenizers.bytes_b[i] for i in b]
        if not text or b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
            a, b, of_a, of_b = [], [], [], []
        spans = []
        for ids, of in ((a, of_a), (b, of_b)):
            at, out = 0, []
            for i, x in zip(ids, of, strict=True):
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        links[n] = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        parts, before = [], 0
        for cut in cuts:
            parts.append("|".join(",".join(str(x[2]) for x in s if before <= x[0] < cut) for s in spans))
            before = cut
        groups[n], sizes[n] = parts, (len(a), len(b))
        total.update(links[n])
    top = Counter()
    for (_, b), k in total.items():
        top[b] = max(top[b], k)
    out = []
    for n, (doc, _) in enumerate(rows):
        digest = hashlib.sha256(";".join(groups[n]).encode()).hexdigest() if groups[n] else ""
        best = sum(total[x] == top[x[1]] for x in links[n])
        out.append((doc, *sizes[n], len(groups[n]), len(links[n]), best, sum(total[x] for x in links[n]), digest))
    return sorted(out, key=repr)


def run(spark, rows, files, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    frame = frame.withColumns({c: F.lit("x") for c in ("key", "copies", "links", "n", "b", "_m", "n_best")})
    found = ta.align(frame, files, **options)
    return sorted(map(tuple, found.documents.select("doc_id", *MEASURES).collect()), key=repr)


def test_ids_are_those_of_the_vocabulary_file(tokenizers, plain):
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(0x180), 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x301, 0x200D, 0x660]]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(500)]
    for text in [*texts, "<|endoftext|> don't", "</s><unk>", "a  b\n\n c", "x" * 5000]:
        assert tokenizers.encode_a(" " + text) == plain.encode(" " + text, add_special_tokens=False).ids


def test_runs_of_white_space_beyond_the_pattern_engine(tokenizers):
    ids = tokenizers.encode_a(" " * 3_000_000 + "x")
    assert b"".join(tokenizers.bytes_a[i] for i in ids) == b" " * 3_000_000 + b"x"


def test_equals_loops(spark, files, tokenizers, plain, documents):
    texts = [r.text for r in documents.orderBy("doc_id").limit(40).collect()]
    odd = [None, "", " ", "  two  blanks ", "é😀中\n\t x", "ﬁ ½", "word", "<|endoftext|>", "<0x41>", "▁", "a\x00b", "a" * 3000]
    rows = [(i if i % 7 else None, t) for i, t in enumerate([*texts, *odd, *texts[:5], *odd])]
    want = brute(rows, tokenizers, plain)
    assert run(spark, rows, files) == want
    assert run(spark, rows, files, sent_pairs=50) == want  # many passes


def test_copies_by_the_thousand_are_tokenised_once(spark, files, tokenizers, plain):
    rows = [(i, "the same words again") for i in range(1500)] + [(5000, "the same other words")]
    want = brute(rows, tokenizers, plain)
    assert run(spark, rows, files) == want
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.copies for r in ta.distinct_texts(frame).collect()) == [1, 1500]


def test_empty_tables(spark, files):
    assert run(spark, [], files) == []
    assert run(spark, [(1, None), (2, "")], files) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_groups_as_text(tokenizers):
    texts = ["hello world", "", "ünï"]
    found = ta.Aligned(*tokenizers.encode(texts), tokenizers)
    written = list(found.written_groups())
    assert len(written) == 3 and written[1] == ""
    for text, groups in zip(texts, written, strict=True):
        for side, table in ((0, tokenizers.bytes_a), (1, tokenizers.bytes_b)):
            ids = [int(i) for g in groups.split(";") if g for i in g.split("|")[side].split(",")]
            assert b"".join(table[i] for i in ids) == ((" " + text).encode() if text else b"")
