"""Ranked lexical search by a dual tree over items and documents; exact.

The score of a document for an item is an inner product: per term, the item's weight (repeats
times rarity) times the document's impact (from the term's frequency and the document's length).
Both are never negative, so the product of two *coordinate maxima* bounds the score of every
item of one group with every document of another.

1. One pass over the texts gives sparse vectors, restricted to the items' terms where those are
   few enough to be sent; document counts per term follow from the vectors.
2. Items are taken in blocks of bounded size, whatever their number. A block's items, sorted by
   their rarest terms, are the leaves of a tree whose nodes hold coordinate maxima.
3. Every task reads its documents in chunks of bounded size, sorts a chunk by the documents'
   rarest terms, and builds the same kind of tree over it. Both trees are descended together:
   a pair of nodes whose bound is below the *weakest* k-th score of the node's items is dropped
   with all documents and items below it. What is left is scored exactly, best bounds first,
   which raises the k-th scores for the rest.
4. Documents are searched in two *waves*. The first, one in ``FIRST_WAVE``, gives every item a k-th
   score that holds for all; with it the second prunes from its first chunk on, and hands on
   hardly more than k rows per item from all its tasks together.

A task gives at most k rows per item, so no group grows with the documents. Sums are exact: they
are done in doubles while below 2 ** 53, in 64-bit integers beyond. Two terms with one 64-bit
hash would count as equal.

Edge cases: a text that is NULL, empty or without terms is no document (it counts in no
statistic), and no item. Documents of score 0 are not returned. Equal scores are ordered by
``doc_id``, a NULL id last; repeated rows are documents of their own. Item rows are searched one
by one, also where they share an ``item_id``. Empty tables give an empty result. Columns other
than the ids and ``text`` play no part.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, breaks, prefix_sums, shared_folder, slices, written

#: Items' terms sent to all tasks to restrict the vectors; beyond it vectors keep all terms.
SENT_TERMS = 1 << 20
#: A block of items: distinct terms summed over its items, and items.
BLOCK_TERMS, BLOCK_ITEMS = 1 << 14, 512
#: Documents and entries of a chunk; documents and items under a lowest node; children of a node.
CHUNK_DOCS, CHUNK_ENTRIES, LEAF, FAN = 8192, 1 << 20, 32, 8
#: One document in so many is searched first.
FIRST_WAVE = 16
#: Bytes between terms.
_BREAKS = breaks((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def term_vectors(rows: DataFrame, name: str, vocabulary: np.ndarray | None = None) -> DataFrame:
    """(name, n, terms, tf): terms as hashes in order, all or those of ``vocabulary`` (sorted).

    ``n`` counts all terms with repeats; texts without any are left out.
    """
    spark = rows.sparkSession
    sent = None if vocabulary is None else spark.sparkContext.broadcast(vocabulary)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if sent is None else sent.value
        for batch in batches:
            for piece in slices(batch, "text"):
                words = Words(piece.column("text"), _BREAKS)
                n = np.diff(words.first)
                term, doc = words.hash.view(np.int64), words.doc
                if held is not None:
                    known = held[np.minimum(np.searchsorted(held, term), len(held) - 1)] == term if len(held) else np.zeros(len(term), bool)
                    term, doc = term[known], doc[known]
                order = np.lexsort((term, doc))
                term, doc = term[order], doc[order]
                new = np.ones(len(term), bool)
                new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                tf = np.diff(np.append(at, len(term)))
                offsets = pa.array(np.searchsorted(doc[at], np.arange(words.docs + 1)), pa.int32())
                found = pa.RecordBatch.from_arrays(
                    [
                        piece.column(name),
                        pa.array(n, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(term[at])),
                        pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32())),
                    ],
                    [name, "n", "terms", "tf"],
                )
                yield found.filter(pa.array(n > 0))

    texts = rows.select(F.col(name).cast("long").alias(name), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(parts, f"{name} long, n long, terms array<long>, tf array<int>")


def _nodes(values: np.ndarray, fan: int) -> np.ndarray:
    """Coordinate maxima of every ``fan`` rows."""
    starts = np.arange(0, len(values), fan)
    return np.maximum.reduceat(values, starts, axis=0) if len(values) else values


class Items(NamedTuple):
    """A block of items: ``weights`` is terms x items, both in the order of the tree."""

    ids: list[int | None]
    terms: np.ndarray
    at: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    exact: str
    documents: int
    length: int

    @classmethod
    def of(cls, rows: pa.Table, frequency: dict[int, int], documents: int, length: int) -> Items:
        """From (item_id, terms, tf) rows and the number of documents per term."""
        terms = np.array(sorted(frequency), np.int64)
        # Math.log of doubles, as the definition has it; terms of a block are few.
        rarity = [math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency[t] + 1))) for t in terms.tolist()]
        rarity = np.array(rarity, np.int64)
        vectors = []
        for item_id, words, tf in zip(*(rows.column(c).to_pylist() for c in ("item_id", "terms", "tf")), strict=True):
            words, tf = np.array(words, np.int64), np.array(tf, np.int64)
            known = np.isin(words, terms)
            at = np.searchsorted(terms, words[known])
            weight = rarity[at] * tf[known]
            if weight.any():
                lead = int(at[np.argmax(rarity[at])])
                vectors.append((lead, item_id, at[weight > 0], weight[weight > 0]))
        vectors.sort(key=lambda v: v[0])
        # An impact is below 10 ** 6.
        largest = max((int(v[3].sum()) for v in vectors), default=0) * 10**6
        return cls(
            [v[1] for v in vectors],
            terms,
            np.concatenate([*(v[2] for v in vectors), np.zeros(0, np.int64)]),
            np.repeat(np.arange(len(vectors)), [len(v[2]) for v in vectors]),
            np.concatenate([*(v[3] for v in vectors), np.zeros(0, np.int64)]),
            "float64" if largest < 1 << 53 else "int64",
            documents,
            length,
        )

    def levels(self) -> list[np.ndarray]:
        """Terms x items, then coordinate maxima of items up to one node."""
        out = [np.zeros((len(self.ids), len(self.terms)), self.exact)]
        out[0][self.item, self.at] = self.weight
        while len(out[-1]) > 1:
            out.append(_nodes(out[-1], FAN))
        return [level.T for level in out]


class Chunk:
    """Some documents as a tree of coordinate maxima over the terms of a block of items."""

    def __init__(self, doc_id: np.ndarray, doc: np.ndarray, at: np.ndarray, impact: np.ndarray, items: Items):
        # Terms are numbered in the order of their hashes; the rarest decides on the neighbours.
        self.items, docs = items, len(doc_id)
        scarce = np.zeros(len(items.terms), np.int64)
        np.maximum.at(scarce, items.at, items.weight)
        lead = np.zeros(docs, np.int64)
        first = np.searchsorted(doc, np.arange(docs))
        top = np.maximum.reduceat(scarce[at] * len(items.terms) + at, first) if docs else lead
        order = np.argsort(top % max(len(items.terms), 1), kind="stable")
        self.doc_id = doc_id[order]
        place = np.empty(docs, np.int64)
        place[order] = np.arange(docs)
        doc = place[doc]
        order = np.argsort(doc, kind="stable")
        self.doc, self.at, self.impact = doc[order], at[order], impact[order].astype(items.exact)
        self.first = np.searchsorted(self.doc, np.arange(docs + 1))
        leaves = -(-docs // LEAF)
        self.levels = [np.zeros((leaves, len(items.terms)), items.exact)]
        cell = self.doc // LEAF * len(items.terms) + self.at
        order = np.argsort(cell, kind="stable")
        cell, value = cell[order], self.impact[order]
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        if len(begin):
            self.levels[0].reshape(-1)[cell[begin]] = np.maximum.reduceat(value, begin)
        while len(self.levels[-1]) > 1:
            self.levels.append(_nodes(self.levels[-1], FAN))

    def leaf(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and dense impacts of the documents under a lowest node."""
        low = number * LEAF
        high = min(low + LEAF, len(self.doc_id))
        i, j = self.first[low], self.first[high]
        dense = np.zeros((high - low, len(self.items.terms)), self.items.exact)
        dense[self.doc[i:j] - low, self.at[i:j]] = self.impact[i:j]
        return self.doc_id[low:high], dense


class Search:
    """The k best documents of each item so far; ``least`` are scores known to be reached."""

    def __init__(self, items: Items, k: int, least: np.ndarray):
        self.items, self.k = items, k
        self.levels = items.levels()
        self.least = np.maximum(least, 1).astype(items.exact)
        self.scores = [np.zeros(0, items.exact) for _ in items.ids]
        self.docs = [np.zeros(0, np.int64) for _ in items.ids]
        self.pairs = self.scored = 0

    def weakest(self, level: int) -> np.ndarray:
        out = self.least
        for _ in range(level):
            out = np.minimum.reduceat(out, np.arange(0, len(out), FAN))
        return out

    def bounds(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Leaves of the chunk x items: bounds, and which pairs both descents leave alive."""
        upper = max(len(chunk.levels), len(self.levels)) - 1
        alive = np.ones((1, 1), bool)
        bound = np.zeros((1, 1))
        before = None
        for step in range(upper, -1, -1):
            d, q = min(step, len(chunk.levels) - 1), min(step, len(self.levels) - 1)
            if before is not None:
                # Each side goes down one level once the other's height is reached.
                if before[0] != d:
                    alive = np.repeat(alive, FAN, axis=0)[: len(chunk.levels[d])]
                if before[1] != q:
                    alive = np.repeat(alive, FAN, axis=1)[:, : self.levels[q].shape[1]]
            before = d, q
            rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            bound = np.zeros(alive.shape, self.items.exact)
            if len(rows) and len(columns):
                bound[np.ix_(rows, columns)] = chunk.levels[d][rows] @ self.levels[q][:, columns]
            alive &= bound >= self.weakest(q)
        return bound, alive

    def add(self, chunk: Chunk) -> None:
        if not self.items.ids or not len(chunk.doc_id):
            return
        bound, alive = self.bounds(chunk)
        self.pairs += len(chunk.doc_id) * len(self.items.ids)
        excess = np.where(alive, bound - self.least, -1).max(axis=1)
        for leaf in np.argsort(-excess, kind="stable"):
            if excess[leaf] < 0:
                break
            asked = np.flatnonzero(alive[leaf] & (bound[leaf] >= self.least))
            if not len(asked):
                continue
            ids, dense = chunk.leaf(leaf)
            scores = dense @ self.levels[0][:, asked]
            self.scored += scores.size
            reached = scores >= self.least[asked]
            for column in np.flatnonzero(reached.any(axis=0)):
                rows = reached[:, column]
                self._take(int(asked[column]), ids[rows], scores[rows, column])

    def _take(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.concatenate([self.scores[item], scores])
        ids = np.concatenate([self.docs[item], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.docs[item] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], scores[order[-1]])

    def found(self) -> Iterator[pa.RecordBatch]:
        item = np.repeat(np.arange(len(self.items.ids)), [len(s) for s in self.scores])
        if len(item):
            docs = np.concatenate(self.docs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(item, pa.int32()),
                    pa.array(docs, pa.int64(), mask=docs == _NO_ID),
                    pa.array(np.concatenate(self.scores).astype(np.int64)),
                ],
                ["item", "doc_id", "score"],
            )


#: Stands for a NULL id, after all others.
_NO_ID = np.iinfo(np.int64).max


def _chunks(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[Chunk]:
    """Documents that share a term with a block of items, in chunks of bounded size."""
    held: list[tuple[np.ndarray, ...]] = []
    docs = entries = 0

    def joined() -> Chunk:
        first = np.cumsum([0, *(len(h[0]) for h in held)])[:-1]
        doc = np.concatenate([h[1] + f for h, f in zip(held, first, strict=True)])
        return Chunk(np.concatenate([h[0] for h in held]), doc, *(np.concatenate([h[i] for h in held]) for i in (2, 3)), items)

    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            piece = batch.slice(start, 512)
            terms, tf = piece.column("terms"), piece.column("tf")
            doc = np.repeat(np.arange(len(piece)), np.diff(terms.offsets.to_numpy()))
            term, tf = terms.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(items.terms, term), max(len(items.terms) - 1, 0))
            known = items.terms[at] == term if len(items.terms) else np.zeros(len(term), bool)
            doc, at, tf = doc[known], at[known], tf[known]
            n = piece.column("n").to_numpy()[doc]
            m = 100 - 75 + (75 * n * items.documents) // max(items.length, 1)
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
            kept, doc = np.unique(doc, return_inverse=True)
            ids = piece.column("doc_id").fill_null(_NO_ID).to_numpy()[kept]
            held.append((ids, doc, at, impact))
            docs, entries = docs + len(ids), entries + len(at)
            if docs >= CHUNK_DOCS or entries >= CHUNK_ENTRIES:
                yield joined()
                held, docs, entries = [], 0, 0
    if docs:
        yield joined()


def _wave(vectors: DataFrame, items: Items, k: int, least: np.ndarray) -> DataFrame:
    """(item, doc_id, score): the best of each task that reach ``least``."""
    sent = vectors.sparkSession.sparkContext.broadcast((items, least))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, least = sent.value
        search = Search(items, k, least)
        for chunk in _chunks(batches, items):
            search.add(chunk)
        yield from search.found()

    return vectors.select("doc_id", "n", "terms", "tf").mapInArrow(parts, "item int, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``documents`` for each row of ``items``."""
    spark = documents.sparkSession
    asked = written(term_vectors(items, "item_id").withColumn("row", F.monotonically_increasing_id()), "items")
    least_share = -(-BLOCK_TERMS // BLOCK_ITEMS)
    placed = prefix_sums(asked, [F.col("row")], F.greatest(F.size("terms"), F.lit(least_share)), "before")
    blocks = written(placed.withColumn("block", F.expr(f"before div {BLOCK_TERMS}")), "blocks")
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    few = terms.limit(SENT_TERMS + 1).count() <= SENT_TERMS
    vocabulary = np.sort(terms.toArrow().column("term").to_numpy()) if few else None
    vectors = term_vectors(documents, "doc_id", vocabulary)
    first = F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST_WAVE)) == 0
    vectors = written(vectors.withColumn("first", first), "vectors")
    total = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    held = written(vectors.select(F.explode("terms").alias("term")).groupBy("term").count(), "terms")

    place = f"{shared_folder(spark)}/ranked-{uuid.uuid4().hex}"
    out = "item_id long, rank int, doc_id long, score long"
    spark.createDataFrame([], out).write.parquet(f"{place}/part=-1")
    numbers = [row.block for row in blocks.select("block").distinct().orderBy("block").collect()]
    for number in numbers:
        rows = blocks.where(F.col("block") == number)
        of = rows.select(F.explode("terms").alias("term")).distinct().join(held, "term")
        block = Items.of(
            rows.select("item_id", "terms", "tf").orderBy("row").toArrow(),
            {r["term"]: r["count"] for r in of.collect()},
            total.n,
            total.length,
        )
        least = np.ones(len(block.ids), np.int64)
        early = written(_best(_wave(vectors.where("first"), block, k, least), k), "early")
        for row in early.where(F.col("rank") == k).collect():
            least[row["item"]] = row["score"]
        later = _wave(vectors.where("not first"), block, k, least)
        best = _best(early.drop("rank").union(later), k)
        ids = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
        best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score").write.parquet(f"{place}/part={number}")
    return spark.read.schema(out).parquet(*(f"{place}/part={n}" for n in [-1, *numbers]))
