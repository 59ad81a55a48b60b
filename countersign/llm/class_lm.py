"""Language-model scores by Brown classes: class transitions times word emissions.

    P(text) = product over tokens of P(class | class before) * P(token | class)

Counts cover every training document, and every word of them has a class that it got from its own
neighbours. First the exchange algorithm works on *units*: the ``UNITS`` commonest words each on
their own, and all other words dealt to ``ENDINGS`` groups by their last letters. Their bigram
counts are a table of fixed size, gathered from all training text; sweeps over the units move each
to the class that raises the likelihood most, until none moves. Then every other word, however
rare, goes to the class that makes its own left and right neighbours likeliest; class bigrams are
counted anew with the classes of all words. Only a word that no training row has keeps the class
of its group.

Both factors are smoothed: transitions by ``ALPHA`` per class; emissions by one per known word of
the class and one for all unknown ones, which makes them sum to one over known words and
"unknown". The counts and classes of the commonest ``SENT_WORDS`` words are sent to all tasks; the
rest of the vocabulary is joined by shuffle.

Edge cases: a NULL or empty text is the end token alone; without training rows every count is 0
and all words are unknown; a NULL id counts as the empty text in the split; repeated rows are
documents of their own; columns beyond ``doc_id`` and ``text`` play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, mixed, slices, written

UNITS, ENDINGS, CLASSES = 600, 64, 48
SENT_WORDS = 1 << 16
ALPHA = 0.5
_END = UNITS + ENDINGS
_HELD_TOKENS = 1 << 21
_BLOCK_WORDS = 1 << 14
_U = np.uint64


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def _endings(words: Words) -> np.ndarray:
    """Group of each word by its last two bytes."""
    last = words.data[words.end - 1].astype(_U)
    before = words.data[np.maximum(words.end - 2, words.begin)].astype(_U)
    lower = [x + _U(32) * ((x >= 65) & (x <= 90)).astype(_U) for x in (last, before)]
    return (mixed(lower[0] * _U(256) + lower[1] + _U(1)) % _U(ENDINGS)).astype(np.int64)


class Lookup:
    """Values of 64-bit keys; the keys are hashes, so their top bits lead to few of the sorted keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], _U(0)), np.append(values[order], 0).astype(np.int32)
        self.shift = _U(64 - max(8, int(len(keys)).bit_length()))
        place = keys[order] >> self.shift
        self.starts = np.searchsorted(place, np.arange(int(_U(2**64 - 1) >> self.shift) + 2).astype(_U)).astype(np.int32)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        out = np.full(len(keys), default, np.int64)
        place = (keys >> self.shift).astype(np.int64)
        at, stop = self.starts[place], self.starts[place + 1]
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            hit = self.keys[at[open_]] == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < stop[open_]]
        return out


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, ending, n) over the rows that are not held out; ``word`` is a 64-bit hash."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            keys = np.concatenate([k for k, _, _ in held])
            keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
            ends = np.concatenate([e for _, e, _ in held])[first]
            return [(keys, ends, np.bincount(place, np.concatenate([n for _, _, n in held])).astype(np.int64))]

        for batch in batches:
            for piece in slices(batch, "text"):
                words = Words(piece.column("text"))
                held.append((words.hash, _endings(words), np.ones(len(words.hash), np.int64)))
                size += len(words.hash)
                if size > _HELD_TOKENS:
                    held[:] = merged()
                    size = len(held[0][0])
                    if size > _HELD_TOKENS // 2:
                        yield _counts(*held[0])
                        held.clear()
                        size = 0
        if held:
            yield _counts(*merged()[0])

    rows = texts.where("not held_out").select("text")
    found = rows.mapInArrow(parts, "word long, ending int, n long")
    return found.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


def _counts(keys: np.ndarray, ends: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": keys.view(np.int64), "ending": pa.array(ends, pa.int32()), "n": n})


def _units(words: Words, head: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Units of all tokens, every text closed by the end unit, and the document of each."""
    unit = head.get(words.hash, -1)
    unit = np.where(unit >= 0, unit, UNITS + _endings(words))
    ends = words.first[1:]
    return np.insert(unit, ends, UNITS + ENDINGS), np.insert(words.doc, ends, np.arange(words.docs))


def _before(unit: np.ndarray) -> np.ndarray:
    """The unit before each token; a text begins after an end."""
    return np.concatenate([[UNITS + ENDINGS], unit[:-1]])


def bigram_counts(texts: DataFrame, head: Lookup) -> np.ndarray:
    """Counts of unit pairs over the rows that are not held out, as a table of fixed size."""
    size = UNITS + ENDINGS + 1

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                unit, _ = _units(Words(piece.column("text")), head)
                total += np.bincount(_before(unit) * size + unit, minlength=size * size)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pair, "n": total[pair]})

    rows = texts.where("not held_out").select("text")
    found = rows.mapInArrow(parts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each unit by the exchange algorithm; ties go to the lower class, so runs agree.

    Units start dealt round by frequency. A sweep takes each unit out of its class and puts it
    where the class bigram likelihood is greatest.
    """
    n = bigrams.astype(float)
    weight = n.sum(axis=0) + n.sum(axis=1)
    order = np.lexsort((np.arange(len(n)), -weight))
    of = np.empty(len(n), np.int64)
    of[order] = np.arange(len(n)) % classes
    one = np.zeros((len(n), classes))
    one[np.arange(len(n)), of] = 1
    after, before = n @ one, n.T @ one  # counts with each class on the other side
    table = one.T @ after
    # More than what rounding makes of sums of this size, so the sweeps come to an end.
    least, moved = 1e-12 * float(_xlogx(n.sum())), 1
    while moved:
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            old, own = of[w], n[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[old] -= own
            left[old] -= own
            table[old, :] -= right
            table[:, old] -= left
            table[old, old] -= own
            out, into = table.sum(axis=1), table.sum(axis=0)
            rows = _xlogx(table + right) - _xlogx(table)
            cols = _xlogx(table + left[:, None]) - _xlogx(table)
            corner = np.diag(table)
            gain = (
                rows.sum(axis=1) - np.diag(rows) + cols.sum(axis=0) - np.diag(cols)
                + _xlogx(corner + right + left + own) - _xlogx(corner)
                - _xlogx(out + right.sum() + own + left) + _xlogx(out + left)
                - _xlogx(into + left.sum() + own + right) + _xlogx(into + right)
            )
            # Margins of the other classes change alike wherever the unit goes.
            new = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 * abs(gain[old]) + least else old
            table[new, :] += right
            table[:, new] += left
            table[new, new] += own
            if new != old:
                moved += 1
                of[w] = new
                after[:, old] -= n[:, w]
                after[:, new] += n[:, w]
                before[:, old] -= n[w]
                before[:, new] += n[w]
    return of


def _dealt(bucket: np.ndarray, words: np.ndarray, contexts: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, words, contexts = bucket[order], words[order], contexts[order]
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    cut = list(zip(at, np.append(at[1:], len(bucket)), strict=True))
    for i in range(0, len(cut), 64):
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array(bucket[at[i : i + 64]], pa.int32()),
                "words": pa.array([words[x:y].tobytes() for x, y in cut[i : i + 64]], pa.binary()),
                "contexts": pa.array([contexts[x:y].tobytes() for x, y in cut[i : i + 64]], pa.binary()),
            }
        )


def word_classes(texts: DataFrame, sent: np.ndarray, head: Lookup, class_of: np.ndarray, pairs: np.ndarray, tokens: int) -> DataFrame:
    """(word, class) of every word but the units of their own, by the classes of all its neighbours.

    A word goes to the class that makes its neighbours likeliest, given the class bigrams
    ``pairs``; ties go to the lower class. Neighbours of the words ``sent`` are counted in each
    task as a table of fixed size; those of other words travel one by one, to as many buckets as the tokens need.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, tokens // _HELD_TOKENS)
    own, places = int((head.get(sent, -1) >= 0).sum()), Lookup(sent, np.arange(len(sent)))
    after = np.log((pairs + ALPHA) / (pairs.sum(axis=1, keepdims=True) + ALPHA * CLASSES))
    size = pairs.sum(axis=0)
    size = np.where(size > 0, np.log(np.maximum(size, 1)), np.inf)

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(len(sent) * 2 * CLASSES, np.uint32)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def rows() -> Iterator[pa.RecordBatch]:
            words, contexts = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            yield from _dealt((((words >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64), words, contexts)

        for batch in batches:
            for piece in slices(batch, "text"):
                words = Words(piece.column("text"))
                unit, _ = _units(words, head)
                now, old = class_of[unit], class_of[_before(unit)]
                inside = unit != _END
                left, right = old[inside], np.append(now[1:], 0)[inside]
                place = places.get(words.hash, -1)
                known = place >= own
                for side, of in ((0, left), (CLASSES, right)):
                    np.add.at(table, place[known] * (2 * CLASSES) + side + of[known], np.uint32(1))
                rare = place < 0
                held.append((words.hash[rare], (left[rare] * CLASSES + right[rare]).astype(np.uint16)))
                count += int(rare.sum())
                if count > _HELD_TOKENS:
                    yield from rows()
                    count = 0
        if held:
            yield from rows()
        table = table.reshape(len(sent), 2 * CLASSES)
        for b in range(buckets) if table.any() else ():
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([b], pa.int32()),
                    "words": pa.array([None], pa.binary()),
                    "contexts": pa.array([zlib.compress(np.ascontiguousarray(table[b::buckets]), 1)], pa.binary()),
                }
            )

    def best(words: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        with np.errstate(invalid="ignore"):
            gain = left @ after + right @ after.T - left.sum(axis=1, keepdims=True) * size
        return pa.RecordBatch.from_pydict(
            {"word": words.view(np.int64), "class": pa.array(np.argmax(np.round(gain, 6), axis=1), pa.int32())}
        )

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, total = None, [], None

        def rows() -> Iterator[pa.RecordBatch]:
            if total is not None:
                some = total.sum(axis=1) > 0
                yield best(sent[bucket::buckets][some], total[some, :CLASSES].astype(float), total[some, CLASSES:].astype(float))
            if not held:
                return
            words = np.concatenate([np.frombuffer(w, _U) for w, _ in held])
            contexts = np.concatenate([np.frombuffer(c, np.uint16) for _, c in held]).astype(np.int64)
            order = np.argsort(words)
            words, contexts = words[order], contexts[order]
            at = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            ends = np.append(at[1:], len(words))
            for i in range(0, len(at), _BLOCK_WORDS):
                some = at[i : i + _BLOCK_WORDS]
                low, high = some[0], ends[i : i + _BLOCK_WORDS][-1]
                place = np.repeat(np.arange(len(some)), ends[i : i + _BLOCK_WORDS] - some) * CLASSES
                sides = (contexts[low:high] // CLASSES, contexts[low:high] % CLASSES)
                left, right = (np.bincount(place + x, minlength=len(some) * CLASSES).reshape(-1, CLASSES) for x in sides)
                yield best(words[some], left.astype(float), right.astype(float))

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("bucket", "words", "contexts"))
            for b, words, contexts in zip(*columns, strict=True):
                if b != bucket:
                    if bucket is not None:
                        yield from rows()
                    bucket, held, total = b, [], None
                if words is None:
                    table = np.frombuffer(zlib.decompress(contexts), np.uint32).reshape(-1, 2 * CLASSES)
                    total = table.astype(np.int64) if total is None else total + table
                else:
                    held.append((words, contexts))
        if bucket is not None:
            yield from rows()

    rows = texts.where("not held_out").select("text").mapInArrow(posted, "bucket int, words binary, contexts binary")
    return rows.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(assigned, "word long, class int")


def _classes(words: Words, units: Lookup, class_of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Class of each token, every text closed by an end, ``CLASSES`` for words that are not sent; the
    class before; the document; and the place in ``words`` (of an end: that of the word behind it)."""
    unit, ends = units.get(words.hash, -1), words.first[1:]
    now = np.insert(np.where(unit >= 0, class_of[unit], CLASSES), ends, class_of[-1])
    old = np.concatenate([class_of[-1:], now[:-1]])
    doc = np.insert(words.doc, ends, np.arange(words.docs))
    return now, old, doc, np.insert(np.arange(len(words.hash)), ends, ends)


def _counted(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and how often each comes."""
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    change = np.ones(len(order), bool)
    change[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(change)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


_SIDE = CLASSES + 1


def _tail(words: Words, now: np.ndarray, old: np.ndarray, doc: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
    """Words that are not sent, per ``doc`` each with the classes around it (``code``: left times
    ``_SIDE`` plus right), and each pair of two such words: (doc, word, other, code, ends, times)."""
    rare = np.flatnonzero(now == CLASSES)
    endings, hashes = _endings(words), words.hash
    code = old[rare] * _SIDE + np.append(now[1:], 0)[rare]
    (word, key), times = _counted(hashes[at[rare]], doc[rare] << 24 | code << 12 | endings[at[rare]])
    yield key >> 24, word, None, key >> 12 & 0xFFF, key & 0xFFF, times
    rare = rare[old[rare] == CLASSES]
    key = doc[rare] << 12 | endings[at[rare] - 1] * ENDINGS + endings[at[rare]]
    (word, other, key), times = _counted(hashes[at[rare] - 1], hashes[at[rare]], key)
    yield key >> 12, word, other, np.zeros(len(key), np.int64), key & 0xFFF, times


def _filled(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of all columns of the schema, NULL where none is given."""
    columns = {name: pa.array(x.view(np.int64) if x.dtype == _U else x) for name, x in columns.items() if x is not None}
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


_PAIRS = pa.schema([("word", pa.int64()), ("other", pa.int64()), ("code", pa.int32()), ("times", pa.int64())])


def _bigrams(texts: DataFrame, units: Lookup, class_of: np.ndarray) -> DataFrame:
    """The rows of ``_tail`` for all texts, and the class bigrams of all sent words, with no word."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                words = Words(piece.column("text"))
                now, old, doc, at = _classes(words, units, class_of)
                known = (now < CLASSES) & (old < CLASSES)
                total += np.bincount(old[known] * CLASSES + now[known], minlength=len(total))
                for _, word, other, code, _, times in _tail(words, now, old, np.zeros_like(doc), at):
                    yield _filled({"word": word, "other": other, "code": code, "times": times}, _PAIRS)
        pair = np.flatnonzero(total)
        yield _filled({"code": pair, "times": total[pair]}, _PAIRS)

    return texts.mapInArrow(parts, "word long, other long, code int, times long")


def class_bigrams(texts: DataFrame, vocabulary: DataFrame, units: Lookup, class_of: np.ndarray) -> np.ndarray:
    """Counts of class pairs over the rows that are not held out, each word with its own class."""
    rows = written(_bigrams(texts.where("not held_out").select("text"), units, class_of), "pairs")
    classes = vocabulary.select("word", "class")
    alone = rows.where("word is not null and other is null").join(classes, "word").selectExpr(
        f"""inline(array(struct(if(code div {_SIDE} < {CLASSES}, code div {_SIDE} * {CLASSES} + class, null) as pair, times),
                         struct(if(code % {_SIDE} < {CLASSES}, class * {CLASSES} + code % {_SIDE}, null) as pair, times)))"""
    )
    both = rows.where("other is not null").join(classes, "word").withColumnRenamed("class", "before").drop("word")
    both = both.join(classes, F.col("other") == F.col("word")).selectExpr(f"before * {CLASSES} + class as pair", "times")
    found = rows.where("word is null").selectExpr("code as pair", "times").union(alone).union(both)
    found = found.where("pair is not null").groupBy("pair").agg(F.sum("times").alias("n")).toArrow()
    out = np.zeros(CLASSES * CLASSES, np.int64)
    out[found["pair"].to_numpy().astype(np.int64)] = found["n"].to_numpy()
    return out.reshape(CLASSES, CLASSES)


class Head:
    """Units of words, on the driver: ``class_of`` has the class of each. Words that are not sent are
    looked up in the vocabulary."""

    def __init__(self, sent: Lookup, vocabulary: DataFrame):
        self.sent, self.vocabulary = sent, vocabulary

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        out = self.sent.get(keys, -1)
        asked = np.unique(keys[out < 0]).view(np.int64)
        rows = self.vocabulary.sparkSession.createDataFrame(pa.table({"word": asked}))
        found = self.vocabulary.join(rows, "word", "left_semi").select("word", "class").toArrow()
        words = found["word"].to_numpy().view(_U)
        more = Lookup(words, _END + 1 + found["class"].to_numpy().astype(np.int64)).get(keys, default)
        return np.where(out >= 0, out, more)


class Model(NamedTuple):
    """``sent`` gives the place of a common word, with its ``count``; ``units`` its unit, ``head`` that
    of any word. ``class_of`` has the classes of units, the last that of the end."""

    vocabulary: DataFrame
    sent: Lookup
    count: np.ndarray
    head: Head
    class_of: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    tokens: int
    distinct: int
    ends: int
    units: Lookup


def fit(texts: DataFrame) -> Model:
    """The model of rows (doc_id, text, held_out)."""
    spark = texts.sparkSession
    words = written(word_counts(texts), "words")
    ends = texts.where("not held_out").count()
    distinct, tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    common = words.orderBy(F.desc("n"), "word").limit(SENT_WORDS).toArrow()
    keys, counts = (common[c].to_numpy().astype(np.int64) for c in ("word", "n"))
    keys = keys.view(_U)
    own = min(UNITS, len(keys))
    head = Lookup(keys[:own], np.arange(own))
    bigrams = bigram_counts(texts, head)
    class_of = exchange(bigrams)
    one = np.zeros((len(class_of), CLASSES))
    one[np.arange(len(class_of)), class_of] = 1
    # Each other word by its own neighbours.
    found = word_classes(texts, keys, head, class_of, one.T @ bigrams @ one, int(tokens))
    first = pa.table({"word": keys[:own].view(np.int64), "class": class_of[:own].astype(np.int32)})
    vocabulary = written(words.join(found.union(spark.createDataFrame(first)), "word"), "vocabulary")
    sent = spark.createDataFrame(pa.table({"word": keys.view(np.int64), "place": np.arange(len(keys))}))
    rows = vocabulary.join(F.broadcast(sent), "word").select("place", "class").toArrow()
    unit = np.zeros(len(keys), np.int64)
    unit[rows["place"].to_numpy()] = _END + 1 + rows["class"].to_numpy().astype(np.int64)
    unit[:own] = np.arange(own)
    units = Lookup(keys, unit)
    class_of = np.concatenate([class_of, np.arange(CLASSES), class_of[-1:]])
    pairs = class_bigrams(texts, vocabulary, units, class_of)
    transition = np.log10((pairs + ALPHA) / (pairs.sum(axis=1, keepdims=True) + ALPHA * CLASSES))
    # Each class has a slot of one for every known word and one for all unknown ones.
    known = np.zeros(CLASSES)
    for row in vocabulary.groupBy("class").count().collect():
        known[row["class"]] = row["count"]
    known[class_of[-1]] += ends > 0
    emission = -np.log10(pairs.sum(axis=0) + known + 1)
    return Model(
        vocabulary, Lookup(keys, np.arange(len(keys))), counts, Head(units, vocabulary), class_of, transition,
        emission, int(tokens) + ends, int(distinct) + (ends > 0), ends, units,
    )


def score(texts: DataFrame, model: Model) -> DataFrame:
    """Per row of (doc_id, text, held_out): token counts, ``base_score`` and ``score`` (log10)."""
    # A number for each row; all that is told of rows is written in one reading.
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text", F.monotonically_increasing_id().alias("row"))
    sent, units = model.sent, model.units
    log_count, ends = np.append(np.log10(model.count + 1.0), 0.0), model.ends
    class_of, transition, emission = model.class_of, model.transition, model.emission

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a task knows by itself: common words and their classes; and the words it doesn't know."""
        for batch in batches:
            for piece in slices(batch, "text"):
                words = Words(piece.column("text"))
                docs, row = words.docs, piece.column("row").to_numpy()
                place = sent.get(words.hash, -1)
                now, old, doc, at = _classes(words, units, class_of)
                one, pair = now < CLASSES, (now < CLASSES) & (old < CLASSES)
                classes = np.bincount(doc[one], emission[now[one]], minlength=docs)
                classes += np.bincount(doc[pair], transition[old[pair], now[pair]], minlength=docs)
                seen = np.bincount(words.doc, log_count[place], minlength=docs) + np.log10(ends + 1.0)
                known = np.bincount(words.doc[place >= 0], minlength=docs) + (ends > 0)
                own = _filled({"row": row, "n_tokens": np.diff(words.first) + 1, "n_known": known, "seen": seen, "classes": classes}, _TOLD)
                yield own.set_column(1, _TOLD.field(1), piece.column("doc_id")).set_column(2, _TOLD.field(2), piece.column("held_out"))
                for of, word, other, code, end, times in _tail(words, now, old, doc, at):
                    yield _filled({"row": row[of], "word": word, "other": other, "code": times << 24 | code << 12 | end}, _TOLD)

    found = written(rows.mapInArrow(told, ", ".join(f"{f.name} {_SQL[f.type]}" for f in _TOLD)), "told")
    own = found.where("word is null").drop("word", "other", "code")
    # Of a word that no training row has, the class is that of its ending.
    ending = _constants(class_of[UNITS : UNITS + ENDINGS])
    beside = np.zeros((_SIDE, _SIDE))
    beside[:CLASSES, :CLASSES] = transition
    beside, emitted = _constants(beside), _constants(emission)
    times, code, end = F.expr("shiftright(code, 24)"), F.expr("shiftright(code, 12) & 4095"), F.expr("code & 4095")
    classes = model.vocabulary.select("word", "n", "class")
    alone = found.where("word is not null and other is null").select("row", "word", "code").join(classes, "word", "left")
    alone = alone.select("row", "n", times.alias("times"), code.alias("code"), F.coalesce("class", F.get(ending, end.cast("int"))).cast("int").alias("k"))
    left, right = F.expr(f"cast(code div {_SIDE} as int) * {_SIDE} + k"), F.expr(f"k * {_SIDE} + cast(code % {_SIDE} as int)")
    alone = alone.select(
        "row",
        F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("n_known"),
        (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("seen"),
        (F.col("times") * (F.get(emitted, F.col("k")) + F.get(beside, left) + F.get(beside, right))).alias("classes"),
    )
    classes = classes.drop("n")
    both = found.where("other is not null").select("row", "word", "other", "code").join(classes, "word", "left")
    both = both.select("row", "other", "code", F.coalesce("class", F.get(ending, F.expr(f"cast((code & 4095) div {ENDINGS} as int)"))).cast("int").alias("before"))
    both = both.join(classes, F.col("other") == F.col("word"), "left")
    now = F.coalesce("class", F.get(ending, F.expr(f"cast((code & 4095) % {ENDINGS} as int)"))).cast("int")
    both = both.select(
        "row", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("seen"),
        (times * F.get(beside, F.col("before") * _SIDE + now)).alias("classes"),
    )
    more = alone.union(both).groupBy("row").agg(
        F.sum("n_known").alias("more_known"), F.sum("seen").alias("more_seen"), F.sum("classes").alias("more_classes")
    )
    all_seen = F.col("seen") + F.coalesce("more_seen", F.lit(0.0))
    per_token = float(np.log10(model.tokens + model.distinct + 1.0))
    return own.join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (all_seen - F.col("n_tokens") * per_token).alias("base_score"),
        (all_seen + F.col("classes") + F.coalesce("more_classes", F.lit(0.0))).alias("score"),
    )


_SQL = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
_TOLD = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("word", pa.int64()), ("other", pa.int64()), ("code", pa.int64())]
    + [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("seen", pa.float64()), ("classes", pa.float64())]
)


def _constants(values: np.ndarray) -> Column:
    return F.array(*[F.lit(x) for x in values.ravel().tolist()])


def score_documents(documents: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """Learn from the documents outside one fold and score all of them."""
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"), held_out(F.col("doc_id"), folds, fold).alias("held_out"))
    return score(texts, fit(texts))
