"""Exact top-k search by integer inner product: distributed histogram selection.

For a block of queries at a time, every score is computed in passes over all candidates. A pass
counts scores in a histogram per query; the bin that holds the k-th best becomes the range of
the next, finer pass, until a bin is one score wide. The last pass keeps what lies above the
k-th score, and of its ties the smallest ids.

Edge cases: vectors that are NULL, hold NULL or a non-finite component, or differ in length from
the longest usable vector take no part, nor do rows without an id; with fewer than k candidates
all are returned; repeated rows are candidates of their own, except that every row with the
query's own id is left out and a repeated query id is asked once, with its least vector; an
empty table gives an empty result. Columns beyond the two named ones play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Queries that one pass holds; what is sent to all tasks is at most this many vectors.
QUERY_BLOCK = 4096
BINS = 256
#: Scores that a task holds at once.
_TILE = 1 << 22


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """Usable vectors as (vec_id, v): v is floor(scale * x) of each component."""
    double = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(double, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"),
    )


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)


def _exact_type(bound: int):
    """The fastest number type in which sums up to ``bound`` are exact."""
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


class _Block:
    """One block of queries, with what is known so far of each query's k-th best score."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, kind, low: int, high: int):
        self.ids, self.matrix, self.kind = ids, matrix.T.astype(kind), kind
        self.low = np.full(len(ids), low, np.int64)
        self.span = high - low + 1
        self.width = -(-self.span // BINS)
        self.above = np.zeros(len(ids), np.int64)

    def tiles(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(candidate ids, scores), candidates by queries; a query's own rows score below all."""
        rows = max(1, _TILE // max(1, len(self.ids)))
        order = np.argsort(self.ids)
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            candidates = _matrix(batch.column("v"), self.matrix.shape[0]).astype(self.kind)
            for i in range(0, len(ids), rows):
                scores = candidates[i : i + rows] @ self.matrix
                at = np.searchsorted(self.ids, ids[i : i + rows], sorter=order)
                at = order[np.minimum(at, len(order) - 1)]
                own = self.ids[at] == ids[i : i + rows]
                if scores.dtype == np.int64:
                    scores[np.flatnonzero(own), at[own]] = np.iinfo(np.int64).min
                else:
                    scores[np.flatnonzero(own), at[own]] = -np.inf
                yield ids[i : i + rows], scores

    def histogram(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        """(query, bin, n) of one task; bins below the task's own k-th best cannot matter."""
        n = len(self.ids)
        counts = np.zeros((n, BINS), np.int64)
        base = np.arange(n) * BINS
        low = self.low.astype(self.kind)
        edge, top = low, (self.low + self.span).astype(self.kind)
        for _, scores in self.tiles(batches):
            row, col = np.nonzero((scores >= edge) & (scores < top))
            place = (scores[row, col] - low[col]).astype(np.int64) // self.width
            counts += np.bincount(base[col] + place, minlength=n * BINS).reshape(n, BINS)
            enough = counts[:, ::-1].cumsum(axis=1)[:, ::-1] >= k
            edge = (self.low + np.maximum(enough.sum(axis=1) - 1, 0) * self.width).astype(self.kind)
        best = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
        query, place = np.nonzero((counts > 0) & (best - counts < k))
        yield pa.RecordBatch.from_pydict({"q": query, "bin": place, "n": counts[query, place]})

    def refine(self, histogram: DataFrame, k: int) -> bool:
        """Narrow each query to the bin of its k-th score; False once bins are one score wide."""
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        kth = (
            histogram.groupBy("q", "bin")
            .agg(F.sum("n").alias("n"))
            .select("q", "bin", (F.sum("n").over(down) - F.col("n")).alias("over"), "n")
        )
        need = self.above  # counted above the present range already
        rows = kth.toArrow().to_pandas()
        rows = rows[(rows["over"] + need[rows["q"]] < k)].sort_values("bin").drop_duplicates("q")
        q = rows["q"].to_numpy()
        # A query with fewer than k scores in reach ends in its lowest bin that holds any.
        self.low[q] += rows["bin"].to_numpy() * self.width
        self.above[q] += rows["over"].to_numpy().astype(np.int64)
        if self.width == 1:
            return False
        self.span, self.width = self.width, -(-self.width // BINS)
        return True

    def winners(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        """Scores above the k-th, and of those equal to it a task's smallest ids, as many as open."""
        ties: dict[int, np.ndarray] = {}
        for ids, scores in self.tiles(batches):
            row, col = np.nonzero(scores >= self.low.astype(self.kind))
            score = scores[row, col].astype(np.int64)
            over = score > self.low[col]
            yield self._rows(col[over], ids[row[over]], score[over])
            order = np.lexsort((ids[row[~over]], col[~over]))
            tied, places = ids[row[~over]][order], col[~over][order]
            for q, some in zip(*_runs(places, tied), strict=True):
                kept = np.sort(np.concatenate([ties.get(q, some[:0]), some]))
                ties[q] = kept[: k - self.above[q]]
        q = np.repeat(np.fromiter(ties, np.int64, len(ties)), [len(v) for v in ties.values()])
        tied = np.concatenate([*ties.values(), np.zeros(0, np.int64)])
        yield self._rows(q, tied, self.low[q])

    def _rows(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"query_id": self.ids[query], "vec_id": ids, "score": score})


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.concatenate([[0], cuts])].tolist() if len(keys) else [], np.split(values, cuts) if len(keys) else []


def exact_top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row that ``queries`` marks."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    whole = quantized(vectors, scale)
    width = whole.agg(F.max(F.size("v"))).first()[0]
    if not width:
        return empty
    usable = whole.where(F.size("v") == width)
    # Largest squared length bounds every score.
    square = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast("decimal(38,0)"))
    bound = usable.agg(F.max(square)).first()[0]
    bound = int(bound) if bound is not None else 1 << 62
    kind = _exact_type(bound)
    bound = min(bound, (1 << 62) - 1)
    asked = usable.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    # Blocks by ranges of ids: each is read when its turn comes and holds at most `block` queries.
    out, after = empty, None
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    while True:
        rest = asked if after is None else asked.where(F.col("vec_id") > after)
        part = rest.orderBy("vec_id").limit(block).toArrow().to_pandas()
        if not len(part):
            return out
        after = int(part["vec_id"].iloc[-1])
        held = _Block(part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy()), kind, -bound, bound)
        while True:
            counts = usable.mapInArrow(lambda b, held=held: held.histogram(b, k), "q long, bin long, n long")
            if not held.refine(counts, k):
                break
        rows = usable.mapInArrow(
            lambda b, held=held: held.winners(b, k), "query_id long, vec_id long, score long"
        )
        # At most k rows of each task reach a query's window.
        ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        out = out.union(checkpointed(ranked.select("query_id", "rank", "vec_id", "score")))
