"""Similarity self-join of documents on their sets of word n-grams (Jaccard), by vertical parts.

The global order of n-grams is that of their 64-bit hashes. It is cut into fragments, so that
each document becomes one short segment per fragment, and overlaps are counted per fragment and
summed per pair:

1. Documents of the same set are one *set* from here on.
2. Sets are dealt into size classes such that linked sets lie in the same or the next class. A
   class cuts the order into K fragments, K being the largest possible difference of a linked
   pair, plus one, plus a reserve: a linked pair agrees wholly on at least as many segments. Each
   segment gives one key. Keys travel once, packed by task into one array for each bucket of
   keys; buckets are as many as the n-grams need, and inside its bucket a key that one set alone
   has is left out. A set with fewer keys left than a link needs has no partner.
3. Agreeing segments are summed per pair; a pair below the number that a link needs is dropped.
   In a group of more than ``PAIRED`` sets with one key nobody is paired up: its sets are tied to
   the least of them instead.
4. What hangs together is compared in blocks of bounded size: each block holds sets of one
   cluster and of like size, and inside a task overlaps are counted fragment by fragment. Every
   pair of the cluster whose sizes allow a link is looked at, so nothing is lost; a block gives
   its links as a spanning forest, so a group of n copies gives no n * n rows.
5. Connected components over these links.

The result is exact but for collisions of 64-bit hashes. Sets that have more empty segments than
the reserve cannot rely on rule 2; they also give their first n-grams in the global order (the
prefix that a linked pair must share) as keys.

Edge cases: a NULL or empty text, or one of white space, has an empty set, is linked with nothing
and is its own component; a text of fewer than ``size`` words has its whole sequence as its one
n-gram; repeated rows are copies; an empty table gives an empty result; columns beyond
``doc_id`` and ``text`` play no part. A NULL id gets its set's component.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bitmap, checkpointed, components, in_bitmap, mixed, slices, written

#: Groups up to this size are paired up and counted; larger ones are tied to their least member.
PAIRED = 16
#: N-grams to a bucket of keys, and postings that a task holds before it hands them on.
BUCKET_GRAMS, HELD_POSTINGS = 1 << 22, 1 << 21
#: Bytes of a key inside its bucket.
KEY_BYTES = 5
#: Places of the bitmap of sets to compare (as powers of two): they follow the sets between these bounds.
SET_BITS = 23, 28
#: A block's share of sets and of n-grams.
BLOCK_SETS, BLOCK_GRAMS = 512, 1 << 19
_FRAGMENT = 4096
_U = np.uint64


class Rule(NamedTuple):
    """N-grams of ``size`` words; linked when ``den * intersection >= num * union``."""

    size: int = 5
    num: int = 80
    den: int = 100

    def bounds(self) -> np.ndarray:
        """Least set size of each class."""
        out = [1]
        while out[-1] < 1 << 31:
            out.append(out[-1] * self.den // self.num + 1)
        return np.array(out, np.int64)

    def differ(self) -> np.ndarray:
        """By class: most n-grams that a linked pair, its smaller set in the class, has apart."""
        return (self.bounds()[1:] - 1) * (self.den - self.num) // self.num

    def reserve(self) -> np.ndarray:
        # A linked pair agrees on more segments than chance hits in the bitmap give.
        return 2 + self.differ() // 12


def _sets(batch: pa.RecordBatch, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-gram hashes (sorted per document), set sizes and set keys."""
    grams = list(Words(batch.column("text")).shingles(rule.size))
    sizes = np.array([len(g) for g in grams], np.int64)
    flat = np.concatenate([*grams, np.zeros(0, _U)])
    first = np.concatenate([[0], np.cumsum(sizes)])
    total = np.zeros(len(flat) + 1, _U)
    np.cumsum(mixed(flat + _U(1)), out=total[1:])
    keys = mixed(total[first[1:]] - total[first[:-1]] + sizes.astype(_U) * _U(0x9E3779B97F4A7C15))
    return flat, sizes, keys.view(np.int64)


def _segment_keys(flat: np.ndarray, sizes: np.ndarray, rule: Rule) -> Iterator[dict[str, np.ndarray]]:
    """Keys of the documents' segments, for their own class and for the next lower one.

    ``doc`` is the place in the batch, ``parts`` the number of fragments, ``empty`` how many of
    the document's are empty.
    """
    bounds, differ, reserve = rule.bounds(), rule.differ(), rule.reserve()
    own = np.searchsorted(bounds, sizes, "right") - 1
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    doc_of = np.repeat(np.arange(len(sizes)), sizes)
    for lower in (0, 1):
        level = own - lower
        used = (sizes > 0) & (level >= 0)
        used &= differ[np.maximum(level, 0)] > 0
        parts = np.where(used, differ[np.maximum(level, 0)] + 1 + reserve[np.maximum(level, 0)], 0)
        kept = used[doc_of]
        grams, doc = flat[kept], doc_of[kept]
        if not len(grams):
            continue
        fragment = ((grams >> _U(32)) * parts[doc].astype(_U)) >> _U(32)
        change = np.ones(len(grams), bool)
        change[1:] = (doc[1:] != doc[:-1]) | (fragment[1:] != fragment[:-1])
        at = np.flatnonzero(change)
        whole = np.add.reduceat(mixed(grams + _U(2)), at)
        place = fragment[at] * _U(1 << 20) + level[doc[at]].astype(_U)
        empty = parts - np.bincount(doc[at], minlength=len(sizes))
        keys, docs = [mixed(whole + mixed(place + _U(3)))], [doc[at]]
        for d in np.flatnonzero(used & (empty > reserve[np.maximum(level, 0)])):
            prefix = sizes[d] - -(-sizes[d] * rule.num // rule.den) + 1
            keys.append(mixed(flat[first[d] : first[d] + prefix] + mixed(np.array([level[d] + (1 << 60)], _U))))
            docs.append(np.full(prefix, d))
        doc = np.concatenate(docs)
        yield {
            "key": np.concatenate(keys).view(np.int64),
            "doc": doc,
            "level": level[doc],
            "own": np.full(len(doc), lower == 0),
            "parts": parts[doc],
            "empty": empty[doc],
        }


def shingle_sets(documents: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, set_key), set_key NULL for an empty set."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                _, sizes, keys = _sets(piece, rule)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(sizes), pa.array(keys, mask=sizes == 0)],
                    ["doc_id", "n_shingles", "set_key"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(parts, "doc_id long, n_shingles long, set_key long")


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)


def _packed(keys: np.ndarray) -> np.ndarray:
    """The low ``KEY_BYTES`` bytes of each key."""
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


_OWN, _LOWER, _SIZES = 0, 1, 2
_POSTED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("sets", pa.binary())])


def _posted(batches: Iterator[pa.RecordBatch], rule: Rule, buckets: int) -> Iterator[pa.RecordBatch]:
    """Keys of all sets by bucket, as arrays; of kind ``_SIZES``: n-grams and empty segments of the sets."""
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], [], []]
    seen: set[int] = set()  # one task's input is a bounded part of a file
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for kind, parts in enumerate(held):
            if not parts:
                continue
            keys, sets = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            bucket = _bucket(sets if kind == _SIZES else keys, buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, keys, sets = bucket[order], keys[order], sets[order]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(at[1:], len(bucket))
            keys = keys.view(np.uint8).reshape(-1, 8) if kind == _SIZES else _packed(keys)
            for i in range(0, len(at), 64):
                cut = list(zip(at[i : i + 64], ends[i : i + 64], strict=True))
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": bucket[at[i : i + 64]].astype(np.int32),
                        "kind": np.full(len(cut), kind, np.int32),
                        "keys": [keys[x:y].tobytes() for x, y in cut],
                        "sets": [sets[x:y].tobytes() for x, y in cut],
                    },
                    schema=_POSTED,
                )

    for batch in batches:
        for piece in slices(batch, "text"):
            flat, sizes, sets = _sets(piece, rule)
            new = np.zeros(len(sizes), bool)
            for d in np.flatnonzero(sizes > 0):
                if sets[d] not in seen:
                    seen.add(int(sets[d]))
                    new[d] = True
            flat, sets = flat[np.repeat(new, sizes)], sets[new].view(_U)
            sizes = sizes[new]
            for found in _segment_keys(flat, sizes, rule):
                doc, own = found["doc"], bool(found["own"][0])
                held[_OWN if own else _LOWER].append((found["key"].view(_U), sets[doc]))
                each, first = np.unique(doc, return_index=True)
                told = sizes[each].astype(_U) << _U(32) | found["empty"][first].astype(_U) << _U(1) | _U(own)
                held[_SIZES].append((told, sets[each]))
                size += len(doc)
            if size >= HELD_POSTINGS:
                yield from rows()
                size = 0
    yield from rows()


def _repeated(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Of each bucket the keys that more than one set has, with these sets; and what is told of sets."""
    bounds, differ, reserve = rule.bounds(), rule.differ(), rule.reserve()
    bucket: int | None = None
    held: list[list[tuple[bytes, bytes]]] = [[], [], []]

    def rows() -> Iterator[pa.RecordBatch]:
        keys = [_unpacked(b"".join(k for k, _ in held[kind])) for kind in (_OWN, _LOWER)]
        sets = [np.frombuffer(b"".join(x for _, x in held[kind]), np.int64) for kind in (_OWN, _LOWER)]
        own = np.repeat([True, False], [len(k) for k in keys])
        key, of = np.concatenate(keys), np.concatenate(sets)
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        order = order[twice]
        key, of, own = key[order], of[order], own[order]
        order = np.lexsort((of, key))
        key, of, own = key[order], of[order], own[order]
        starts = np.ones(len(key), bool)
        starts[1:] = key[1:] != key[:-1]
        once = starts.copy()
        once[1:] |= of[1:] != of[:-1]
        group = np.cumsum(starts) - 1
        once &= np.bincount(group[once], minlength=len(group))[group] > 1
        key = key[once] | _U(bucket) << _U(8 * KEY_BYTES)
        yield from _sliced({"key": key.view(np.int64), "set_key": of[once], "own": own[once]})
        told = np.frombuffer(b"".join(k for k, _ in held[_SIZES]), _U)
        of = np.frombuffer(b"".join(x for _, x in held[_SIZES]), np.int64)
        order = np.lexsort((told & _U(1), of))
        told, of = told[order], of[order]
        once = np.ones(len(of), bool)
        once[1:] = (of[1:] != of[:-1]) | (told[1:] != told[:-1])
        told, of = told[once], of[once]
        n, own = (told >> _U(32)).astype(np.int64), told & _U(1) == 1
        empty = (told >> _U(1) & _U(0x7FFFFFFF)).astype(np.int64)
        level = np.searchsorted(bounds, n, "right") - 1 - ~own
        parts = differ[level] + 1 + reserve[level]
        # Most n-grams that the set and any partner in this class have apart.
        apart = np.where(own, n * (rule.den - rule.num) // rule.num, 2 * n * (rule.den - rule.num) // (rule.den + rule.num))
        yield from _sliced(
            {"set_key": of, "own": own, "n": n, "empty": empty, "level": level, "parts": parts, "needed": parts - apart - empty}
        )

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("bucket", "kind", "keys", "sets"))
        for at, kind, keys, sets in zip(*columns, strict=True):
            if at != bucket:
                if bucket is not None:
                    yield from rows()
                bucket, held = at, [[], [], []]
            held[kind].append((keys, sets))
    if bucket is not None:
        yield from rows()


_FOUND = pa.schema(
    [(c, pa.bool_() if c == "own" else pa.int64()) for c in ("key", "set_key", "own", "n", "empty", "level", "parts", "needed")]
)


def _sliced(columns: dict[str, np.ndarray], rows: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    length = len(columns["set_key"])
    for i in range(0, length, rows):
        part = {name: pa.array(x[i : i + rows]) for name, x in columns.items()}
        size = min(rows, length - i)
        yield pa.RecordBatch.from_arrays([part[f.name] if f.name in part else pa.nulls(size, f.type) for f in _FOUND], schema=_FOUND)


def _members(texts: DataFrame, rule: Rule, grams: int) -> DataFrame:
    """Sets with each of their keys that another set has too.

    A set with fewer such keys than a link needs has no partner and is left out, so that a
    passage which many documents share does not tie them together.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-grams // BUCKET_GRAMS))
    posted = texts.mapInArrow(lambda batches: _posted(batches, rule, buckets), "bucket int, kind int, keys binary, sets binary")
    found = posted.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        lambda batches: _repeated(batches, rule),
        "key long, set_key long, own boolean, n long, empty long, level long, parts long, needed long",
    )
    found = written(found, "keys")
    keys = found.where("key is not null").select("key", "set_key", "own")
    left = keys.groupBy("set_key", "own").agg(F.count("*").alias("left"))
    kept = found.where("key is null").drop("key").join(left, ["set_key", "own"]).where("left >= needed").drop("left", "needed")
    return keys.join(kept, ["set_key", "own"])


def candidate_edges(texts: DataFrame, rule: Rule, grams: int) -> DataFrame:
    """Pairs (a, b) of set keys such that linked sets hang together; ``grams`` is the texts' number of n-grams."""
    # Read by three branches below; written once, the texts are not cut up for each.
    members = written(_members(texts, rule, grams), "members")
    groups = members.groupBy("key").agg(F.count("*").alias("size"), F.min("set_key").alias("least")).where("size > 1")
    rows = members.join(groups, "key")
    stars = rows.where((F.col("size") > PAIRED) & (F.col("set_key") != F.col("least"))).select(
        F.col("least").alias("a"), F.col("set_key").alias("b")
    )
    small = (
        rows.where(F.col("size") <= PAIRED)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("set_key", "n", "empty", "own", "level", "parts"))).alias("m"))
    )
    fits = f"least(x.n, y.n) * {rule.den} >= greatest(x.n, y.n) * {rule.num} and (x.own or y.own)"
    pairs = small.select(
        F.explode(
            F.expr(
                f"""flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> {fits}),
                    y -> struct(x.set_key as a, y.set_key as b, x.level as level,
                         x.parts - ((x.n + y.n) * {rule.den - rule.num}) div {rule.den + rule.num}
                                 - least(x.empty, y.empty) as needed))))"""
            )
        ).alias("p")
    ).select("p.*")
    counted = pairs.groupBy("a", "b", "level").agg(F.count("*").alias("agree"), F.max("needed").alias("needed"))
    return stars.union(counted.where("agree >= needed").select("a", "b"))


def _compared(a: list[tuple], b: list[tuple], rule: Rule) -> Iterator[tuple[int, int]]:
    """Links between two lists of (set_key, n-grams) as a spanning forest of set keys."""
    rows = list({key: grams for key, grams in [*a, *b]}.items())
    at = {key: i for i, (key, _) in enumerate(rows)}
    left, right = [at[k] for k, _ in a], [at[k] for k, _ in b]
    sizes = np.array([len(g) for _, g in rows])
    overlap = np.zeros((len(left), len(right)), np.int64)
    if len(left) * len(right) <= 16:
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                overlap[i, j] = len(np.intersect1d(rows[x][1], rows[y][1], assume_unique=True))
    else:
        grams, ids, often = np.unique(np.concatenate([g for _, g in rows]), return_inverse=True, return_counts=True)
        common = np.cumsum(often > 1) - 1
        row = np.repeat(np.arange(len(rows)), sizes)
        keep = often[ids] > 1
        row, ids = row[keep], common[ids[keep]]
        order = np.argsort(ids, kind="stable")
        row, ids = row[order], ids[order]
        for begin in range(0, int(ids[-1]) + 1 if len(ids) else 0, _FRAGMENT):
            i, j = np.searchsorted(ids, [begin, begin + _FRAGMENT])
            part = np.zeros((len(rows), _FRAGMENT), np.float32)
            part[row[i:j], ids[i:j] - begin] = 1
            overlap += (part[left] @ part[right].T).astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - overlap
    linked = rule.den * overlap >= rule.num * union
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = root(left[i]), root(right[j])
        if x != y:
            parent[y] = x
            yield rows[left[i]][0], rows[right[j]][0]


def links(texts: DataFrame, clusters: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) between sets of one cluster (node, root, n), as spanning forests of its blocks."""
    # A set that only falls on a place by chance travels in vain, so places follow the sets.
    bits = min(max(SET_BITS[0], (64 * clusters.count()).bit_length()), SET_BITS[1])
    wanted = texts.sparkSession.sparkContext.broadcast(bitmap(clusters.select(F.col("node").alias("key")), bits))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = wanted.value, set()
        for batch in batches:
            for piece in slices(batch, "text"):
                flat, sizes, keys = _sets(piece, rule)
                first = np.concatenate([[0], np.cumsum(sizes)])
                out = []
                for d in np.flatnonzero(in_bitmap(keys, held, bits) & (sizes > 0)):
                    if keys[d] not in seen:
                        seen.add(keys[d])  # one task's input is a bounded part of a file
                        out.append(d)
                yield pa.RecordBatch.from_pydict(
                    {"node": keys[out], "grams": [flat[first[d] : first[d + 1]].tobytes() for d in out]},
                    schema=pa.schema([("node", pa.int64()), ("grams", pa.binary())]),
                )

    # The blocks follow from the sets' sizes, so the n-grams travel to their set and to its blocks only.
    width = 1.001 * float(np.log(rule.den / rule.num))
    clusters = clusters.withColumn("band", F.floor(F.log("n") / width))
    whole = clusters.groupBy("root", "band").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = whole.select(
        "root",
        "band",
        F.ceil(F.greatest(F.col("c") / BLOCK_SETS, F.col("s") / BLOCK_GRAMS)).cast("long").alias("blocks"),
    )
    above = blocks.select("root", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = blocks.select("root", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    dealt = blocks.join(above, ["root", "band"], "left").join(below, ["root", "band"], "left").na.fill(0)
    placed = clusters.join(dealt, ["root", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    groups = F.expr(
        """concat(
          transform(sequence(0L, blocks - 1), j -> struct(band as low, band as high, least(block, j) as i,
                    greatest(block, j) as j, if(block = j, 2, if(block < j, 0, 1)) as side)),
          if(above > 0, transform(sequence(0L, greatest(above, 1L) - 1),
             j -> struct(band as low, band + 1 as high, block as i, j as j, 0 as side)), array()),
          if(below > 0, transform(sequence(0L, greatest(below, 1L) - 1),
             j -> struct(band - 1 as low, band as high, j as i, block as j, 1 as side)), array()))"""
    )
    placed = checkpointed(placed.select("root", "node", "band", "block", "blocks", "above", "below"))
    rows = texts.mapInArrow(sets, "node long, grams binary").join(placed, "node")
    # One shuffle by set serves the join and the removal of sets that several tasks gave.
    rows = rows.dropDuplicates(["node"])
    spread = rows.select("root", "node", "grams", F.explode(groups).alias("g")).select(
        F.xxhash64("root", "g.low", "g.high", "g.i", "g.j").alias("group"), "g.side", "node", "grams"
    )
    return spread.repartition("group").sortWithinPartitions("group").mapInArrow(
        lambda batches: _linked(batches, rule), "a long, b long"
    )


def _linked(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Compare each run of rows of one group; a group's size is bounded by its two blocks."""
    group, a, b = None, [], []
    out: list[tuple[int, int]] = []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("group", "side", "node", "grams"))
        for key, side, node, grams in zip(*columns, strict=True):
            if key != group:
                out += _compared(a, b, rule) if a and b else ()
                group, a, b = key, [], []
            item = (node, np.frombuffer(grams, _U))
            if side != 1:
                a.append(item)
            if side != 0:
                b.append(item)
        if out:
            yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out]})
            out = []
    out += _compared(a, b, rule) if a and b else ()
    if out:
        yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out]})


def set_keys(rule: Rule):
    """A column function: the key of a text's set, NULL for an empty one."""

    @F.arrow_udf("long")
    def key(texts: pa.Array) -> pa.Array:
        _, sizes, keys = _sets(pa.RecordBatch.from_arrays([texts.cast(pa.string())], ["text"]), rule)
        return pa.array(keys, pa.int64(), mask=sizes == 0)

    return key


def grouped(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """(doc_id, n_shingles, set_key, component_id, first) per row of ``documents``.

    ``component_id`` is the least id reachable by links. ``first`` tells whether the row has that
    id and, of the sets with that id in the group, the least key: two groups may share a least id
    where ids repeat, and each has its own first.
    """
    texts = documents.select("doc_id", "text")
    base = checkpointed(shingle_sets(texts, rule))
    sizes = base.where("n_shingles > 0").groupBy(F.col("set_key").alias("node")).agg(F.min("n_shingles").alias("n"))
    grams = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    clusters = checkpointed(components(candidate_edges(texts, rule, grams)).join(sizes, "node"))
    roots = components(links(texts, clusters, rule))
    firsts = base.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    labelled = firsts.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select(
        "set_key", "least", F.coalesce("root", "set_key").alias("root")
    )
    # A set of NULL ids alone comes last.
    order = F.struct(F.col("least").isNull(), "least", "set_key")
    least = labelled.groupBy("root").agg(
        F.min("least").alias("component"), F.min_by("set_key", order).alias("_first")
    )
    ids = labelled.join(least, "root").select("set_key", "component", (F.col("_first") == F.col("set_key")).alias("_first"))
    return base.join(ids, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        "set_key",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("_first") & F.col("doc_id").eqNullSafe(F.col("component")), F.lit(True)).alias("first"),
    )


def similar(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """(doc_id, n_shingles, component_id): the least id reachable by links, per row of ``documents``."""
    return grouped(documents, rule).select("doc_id", "n_shingles", "component_id")
