"""Alignment of two tokenizers over a corpus, each distinct text tokenised once.

1. Equal texts are brought together by a shuffle of the full text, counted before and after it.
2. Each distinct text is cut by both tokenizers (A: byte-level BPE, B: pieces with byte fallback)
   and aligned: byte offsets at which tokens of both end cut the text into *groups*, and every
   overlap of an A token with a B token is a *link*. Tokens of a text lie end to end, so the links
   are the stretches between neighbouring ends of either side: all are found by counting ends.
   Links are written beside the measures, so nothing is tokenised again.
3. Counts of id pairs are sums over links, weighted by the number of copies of the text. They are
   brought to the texts in *slices* by B id of at most ``SENT_PAIRS`` pairs: a slice is sent to all
   tasks, each pass adds what its pairs give, and the passes are as many as the pairs need.
4. Measures are joined to all documents by the SHA-256 of their text. Texts of very many copies
   are at most ``HOT_TEXTS`` by their number alone and are sent to all tasks, so no join key has
   more than one in ``HOT_TEXTS`` of the rows.

The tokenizers' files are read where the session runs and sent to tasks; they are parameters.

Edge cases: a text that is NULL or empty, or whose tokens do not give back its bytes (one that a
tokenizer normalises, or pieces it does not know), has no tokens: zeros and an empty digest; it
adds nothing to the counts. Rows that repeat, also with one ``doc_id``, are returned one by one
and counted as copies. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: Pairs of ids sent to all tasks at once, and texts whose copies are joined by broadcast.
SENT_PAIRS, HOT_TEXTS = 4_000_000, 100_000
#: Distinct pairs a task gathers before it hands their sums on.
_GATHERED = 1_000_000
#: Fixed value: how the byte-level tokenizer cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Files(NamedTuple):
    """The contents of a byte-level BPE vocabulary (JSON) and of a piece model."""

    vocabulary: bytes
    model: bytes

    @classmethod
    def read(cls, vocabulary: str | None = None, model: str | None = None) -> Files:
        """Files at the given paths, by default those of the installed public tokenizers."""
        if vocabulary is None or model is None:
            import public_tokenizers

            vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
            model = model or public_tokenizers.path("piece_bpe_32k.model")
        return cls(Path(vocabulary).read_bytes(), Path(model).read_bytes())


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable characters stand for themselves; the other bytes, in order, are written from U+0100.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, files: Files):
        import sentencepiece
        import tiktoken

        self._files = files
        spec = json.loads(files.vocabulary)
        special = {t["content"] for t in spec.get("added_tokens", ()) if t.get("special")}
        letter = byte_alphabet()
        vocabulary = {w: i for w, i in spec["model"]["vocab"].items() if w not in special}
        entries = {i: bytes(letter[c] for c in w) for w, i in vocabulary.items()}
        self.bytes_a = [entries.get(i, b"") for i in range(max(entries, default=-1) + 1)]
        # Ids of such a vocabulary are in order of its merges.
        self._a = tiktoken.Encoding(
            "a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in entries.items()}, special_tokens={}
        )
        self._b = sentencepiece.SentencePieceProcessor(model_proto=files.model)
        self.bytes_b = [self._piece(self._b.id_to_piece(i)) for i in range(self._b.get_piece_size())]
        self.length_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.length_b = np.array([len(b) for b in self.bytes_b], np.int64)

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes.fromhex(byte[1]) if byte else piece.replace("▁", " ").encode()

    def encode_a(self, text: str) -> list[int]:
        try:
            return self._a.encode_ordinary(text)
        except BaseException as error:  # the pattern engine gives up on some very long runs
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self._plain.encode(text, add_special_tokens=False).ids

    @cached_property
    def _plain(self):
        from tokenizers import Tokenizer

        plain = Tokenizer.from_str(self._files.vocabulary.decode())
        plain.encode_special_tokens = True
        return plain

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides per text; none on either side where the bytes differ."""
        a, b = [], []
        for text, pieces in zip(texts, self._b.encode(texts, num_threads=1), strict=True):
            spaced = " " + text
            want = spaced.encode()
            ids = self.encode_a(spaced)
            same = b"".join([self.bytes_b[i] for i in pieces]) == want and b"".join([self.bytes_a[i] for i in ids]) == want
            a.append(ids if same else [])
            b.append(pieces if same else [])
        return a, b


@lru_cache(maxsize=1)
def _loaded(files: Files) -> Tokenizers:
    """Built once per Python worker."""
    return Tokenizers(files)


class Aligned:
    """Alignment of several texts: tokens end to end, and per text where they begin."""

    def __init__(self, a: list[list[int]], b: list[list[int]], tokenizers: Tokenizers):
        flat = lambda x: np.fromiter((i for ids in x for i in ids), np.int64, sum(map(len, x)))
        self.a, self.b = flat(a), flat(b)
        self.n_a, self.n_b = (np.array([len(ids) for ids in x], np.int64) for x in (a, b))
        end_a = np.cumsum(tokenizers.length_a[self.a])
        end_b = np.cumsum(tokenizers.length_b[self.b])
        total = int(end_a[-1]) if len(end_a) else 0
        is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        is_a[end_a], is_b[end_b] = True, True
        # How many ends lie at or before each byte offset.
        seen_a, seen_b, both = np.cumsum(is_a), np.cumsum(is_b), np.cumsum(is_a & is_b)
        either = np.cumsum(is_a | is_b)
        ends = np.flatnonzero(is_a | is_b)
        self.link_a, self.link_b = self.a[seen_a[ends - 1]], self.b[seen_b[ends - 1]]
        self.group_a, self.group_b = both[end_a - 1], both[end_b - 1]
        last = np.concatenate([[0], end_a])[np.concatenate([[0], np.cumsum(self.n_a)])]
        self.first_group, self.first_link = both[last], either[last]
        self.n_groups, self.n_links = np.diff(self.first_group), np.diff(self.first_link)

    def written_groups(self) -> Iterator[str]:
        """Per text its groups as ``a1,a2|b1;a3|b2,b3``."""
        n = len(self.a) + len(self.b)
        groups = int(self.first_group[-1])
        in_a = np.bincount(self.group_a, minlength=groups)
        in_b = np.bincount(self.group_b, minlength=groups)
        before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        place_a = np.arange(len(self.a)) + before_b[self.group_a]
        place_b = np.arange(len(self.b)) + (before_a + in_a)[self.group_b]
        ids, after = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        after[before_a + before_b + in_a - 1] = ord("|")
        after[before_a + before_b + in_a + in_b - 1] = ord(";")
        width = len(str(int(ids.max()))) if n else 1
        digits = np.empty((n, width + 1), np.uint8)
        rest = ids.copy()
        for column in range(width - 1, -1, -1):
            rest, digit = np.divmod(rest, 10)
            digits[:, column] = digit + ord("0")
        digits[:, width] = after
        powers = 10 ** np.arange(width - 1, 0, -1)
        shown = np.ones((n, width + 1), bool)
        shown[:, : width - 1] = ids[:, None] >= powers
        lengths = shown.sum(axis=1)
        letters = digits[shown].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield letters[begin : max(end - 1, begin)].decode()


def distinct_texts(documents: DataFrame) -> DataFrame:
    """(text, copies, key): each text that is not empty once."""
    texts = documents.select(F.col("text").cast("string").alias("text")).where("text <> ''")
    return texts.groupBy("text").agg(F.count("*").alias("copies")).withColumn("key", F.unhex(F.sha2("text", 256)))


def align_texts(texts: DataFrame, files: Files) -> DataFrame:
    """Counts, digest and links of distinct texts; ``links`` holds 64-bit numbers, B id * A ids + A id."""
    sent = texts.sparkSession.sparkContext.broadcast(files)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _loaded(sent.value)
        for batch in batches:
            for piece in slices(batch, "text"):
                found = Aligned(*tokenizers.encode(piece.column("text").to_pylist()), tokenizers)
                codes = found.link_b * len(tokenizers.bytes_a) + found.link_a
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in found.written_groups()]
                links = [codes[i:j].tobytes() for i, j in zip(found.first_link[:-1], found.first_link[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("key"),
                        piece.column("copies"),
                        *(pa.array(getattr(found, name), pa.int64()) for name in _COUNTS),
                        pa.array(digests, pa.string()),
                        pa.array(links, pa.binary()),
                    ],
                    ["key", "copies", *_COUNTS, "groups_sha256", "links"],
                )

    counts = ", ".join(f"{name} long" for name in _COUNTS)
    return texts.select("key", "copies", "text").mapInArrow(
        parts, f"key binary, copies long, {counts}, groups_sha256 string, links binary"
    )


def _summed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(codes), 1), bool), codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(weights, first) if len(first) else weights


def _links(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All links of a column of binaries, and how many each row has."""
    rows = [np.frombuffer(x, np.int64) for x in column.to_pylist()]
    return np.concatenate([*rows, np.zeros(0, np.int64)]), np.array([len(x) for x in rows], np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(code, n): links of each pair of ids over all documents, copies counted."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, merged = 0, 0
        out = lambda c, n: pa.RecordBatch.from_pydict({"code": c, "n": n})
        for batch in batches:
            for piece in slices(batch, "links", 1 << 22):
                codes, lengths = _links(piece.column("links"))
                copies = np.repeat(piece.column("copies").to_numpy(), lengths)
                often = copies > 1
                single, counts = np.unique(codes[~often], return_counts=True)
                held += [(single, counts.astype(np.int64)), _summed(codes[often], copies[often])]
                size += sum(len(c) for c, _ in held[-2:])
            if size - merged > _GATHERED:
                held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = merged = len(held[0][0])
                if size > 4 * _GATHERED:
                    yield out(*held[0])
                    held, size, merged = [], 0, 0
        if held:
            yield out(*_summed(*(np.concatenate(x) for x in zip(*held, strict=True))))

    rows = aligned.select("copies", "links").mapInArrow(parts, "code long, n long")
    return rows.groupBy("code").agg(F.sum("n").alias("n"))


def _slices(pairs: DataFrame, limit: int) -> Iterator[DataFrame]:
    """The pairs, cut by B id into tables of at most ``limit`` rows (or of one B id)."""
    sizes = pairs.groupBy("b").count().orderBy("b").collect()  # one row per id of a vocabulary
    first, total = 0, 0
    for row in sizes:
        if total and total + row["count"] > limit:
            yield pairs.where(F.col("b").between(first, row["b"] - 1))
            first, total = row["b"], 0
        total += row["count"]
    if total:
        yield pairs.where(F.col("b") >= first)


def _measured(aligned: DataFrame, part: DataFrame) -> DataFrame:
    """(key, n_best, count_sum) of the links whose pairs are in ``part``."""
    rows = part.select("code", "n", "best").toArrow()
    code = rows.column("code").to_numpy()
    order = np.argsort(code)
    sent = aligned.sparkSession.sparkContext.broadcast(
        (code[order], rows.column("n").to_numpy()[order], rows.column("best").to_numpy()[order])
    )

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = sent.value
        for batch in batches:
            for piece in slices(batch, "links", 1 << 21):
                codes, lengths = _links(piece.column("links"))
                distinct, inverse = np.unique(codes, return_inverse=True)
                at = np.minimum(np.searchsorted(code, distinct), len(code) - 1)
                held = code[at] == distinct
                sums = np.zeros((2, len(codes) + 1), np.int64)
                np.cumsum((held & best[at])[inverse], out=sums[0, 1:])
                np.cumsum(np.where(held, n[at], 0)[inverse], out=sums[1, 1:])
                ends = np.concatenate([[0], np.cumsum(lengths)])
                n_best, count_sum = np.diff(sums[:, ends], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key"), pa.array(n_best), pa.array(count_sum)], ["key", "n_best", "count_sum"]
                )

    return aligned.where("n_links > 0").select("key", "links").mapInArrow(parts, "key binary, n_best long, count_sum long")


class Alignment(NamedTuple):
    """``texts``: one row per distinct text (key, copies, counts, digest, links). ``pairs``: (a, b,
    n, best) with the corpus-wide count of each pair and whether it is the highest of its B id.
    ``documents``: one row per document with all measures."""

    texts: DataFrame
    pairs: DataFrame
    documents: DataFrame


def align(documents: DataFrame, files: Files | None = None, *, sent_pairs: int = SENT_PAIRS) -> Alignment:
    """Align both tokenizers over ``documents`` (doc_id, text)."""
    files = files or Files.read()
    ids_a = len(Tokenizers(files).bytes_a)
    aligned = written(align_texts(distinct_texts(documents), files), "aligned")
    counts = pair_counts(aligned).withColumn("b", F.expr(f"code div {ids_a}")).withColumn("a", F.expr(f"code % {ids_a}"))
    counts = written(counts, "pairs")
    top = counts.groupBy("b").agg(F.max("n").alias("_top"))
    pairs = written(counts.join(top, "b").select("code", "a", "b", "n", (F.col("n") == F.col("_top")).alias("best")), "pairs")
    passes = [_measured(aligned, part) for part in _slices(pairs, sent_pairs)]
    texts = aligned.select("key", "copies", *_COUNTS, "groups_sha256")
    if passes:
        sums = passes[0]
        for more in passes[1:]:
            sums = sums.union(more)
        if len(passes) > 1:
            sums = sums.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        texts = texts.join(sums, "key", "left")
    else:
        texts = texts.withColumns({"n_best": F.lit(None).cast("long"), "count_sum": F.lit(None).cast("long")})
    texts = written(texts, "measures")
    return Alignment(aligned, pairs.select("a", "b", "n", "best"), _joined(documents, texts))


def _joined(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """Measures of every document; texts of very many copies are sent to all tasks."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("text") != "", F.unhex(F.sha2(F.col("text").cast("string"), 256))).alias("key"),
    )
    rows = written(rows, "ids")
    total = texts.agg(F.sum("copies")).first()[0] or 0
    # At most HOT_TEXTS texts can have this many copies.
    hot = F.col("copies") >= max(1000, -(-total // HOT_TEXTS))
    measures = [*_COUNTS, "n_best", "count_sum", "groups_sha256"]
    held = F.struct(*measures).alias("_m")
    often = texts.where(hot).select("key", held)
    seldom = texts.where(~hot).select("key", held)
    rows = rows.join(F.broadcast(often.withColumnRenamed("_m", "_often")), "key", "left")
    # Rows that have their measures already need no partner; each gets a key of its own.
    rows = rows.withColumn("_at", F.when(F.col("_often").isNull(), F.col("key")))
    done = rows.where("_at is null")
    rest = rows.where("_at is not null").join(seldom, "key", "left")
    out = done.withColumn("_m", F.col("_often")).select("doc_id", "_m").union(rest.select("doc_id", "_m"))
    numbers = [F.coalesce(F.col(f"_m.{c}"), F.lit(0)).cast("long").alias(c) for c in measures[:-1]]
    return out.select("doc_id", *numbers, F.coalesce("_m.groups_sha256", F.lit("")).alias("groups_sha256"))
