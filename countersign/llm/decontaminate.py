"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel edit distance.

An item of n characters may differ from a passage in k = n // ``CHARS_PER_EDIT`` edits. Cut into
k + 1 pieces, at least one piece stands unchanged in every such passage. An automaton finds all
pieces in each whole text; around each hit the item is compared with the text by Myers'
bit-parallel distance for substrings (the item whole, any start and end in the text).

Most hits are chance, so a hit is verified from below: the pieces are the leaves of a binary
tree, a node over p pieces may have p - 1 edits, and a passage within the budget has a leaf whose
nodes up to the root all keep theirs (else both children of some node would break theirs, and
with them the node). A hit is dropped at the first node that does not match around it.

Texts and items are compared in lower case with every run of white space as one space, and an
item without blanks at its ends; a match gives its place in the text as it is. An item that is then
shorter than ``LEAST_CHARS`` has no edits, as edits of a short text match by chance, and must stand
as whole words. Items are read in blocks of bounded size (``BLOCK_CHARS``), each
compared with all texts, so what is sent to the tasks is bounded whatever the number of items.

Edge cases: a NULL or empty text matches nothing; NULL, empty and blank items are
left out; in scripts without blanks between words any place is a word's end; repeated items and rows give repeated results;
empty tables give empty results; columns beyond those named pass through ``clean`` unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS_PER_EDIT = 10
LEAST_CHARS = 40
BLOCK_CHARS = 4_000_000
_RUN = re.compile(" {2,}")
#: Thai, Lao, Burmese, Khmer, Han and kana: written without blanks between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff]")


def _flat(text: str) -> str:
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return text


def normal(text: str) -> str:
    """Lower case, character by character, and runs of white space as one space."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    low = _flat(low)
    return _RUN.sub(" ", low) if "  " in low else low


def places(text: str) -> np.ndarray:
    """Where in ``text`` each character of ``normal(text)`` begins, and the end of the text."""
    keep = np.ones(len(text), bool)
    for m in _RUN.finditer(_flat(text)):
        keep[m.start() + 1 : m.end()] = False
    return np.append(np.flatnonzero(keep), len(text))


def budget(length: int, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return length // chars_per_edit


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether no word of ``text`` goes on across either end of the stretch."""

    def goes_on(at: int) -> bool:
        pair = text[at - 1 : at + 1] if at else ""
        return len(pair) == 2 and all((c.isalnum() or c == "_") and not _UNSPACED.match(c) for c in pair)

    return not goes_on(start) and not goes_on(end)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``item`` cut into ``edits + 1`` pieces of nearly the same length, with their places."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' algorithm for one item; Python's whole numbers serve as words of any length."""

    def __init__(self, item: str):
        self.length = len(item)
        self.mask = (1 << self.length) - 1
        self.high = 1 << (self.length - 1)
        self.equal: dict[str, int] = {}
        for i, c in enumerate(item):
            self.equal[c] = self.equal.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """Least distance of the item to a substring of ``text``, and the first end that has it."""
        plus, minus, score = self.mask, 0, self.length
        least, end = score, 0
        mask, high, equal = self.mask, self.high, self.equal
        for j, c in enumerate(text):
            eq = equal.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(xh | plus) & mask
            down = plus & xh
            if up & high:
                score += 1
            elif down & high:
                score -= 1
            up <<= 1
            down <<= 1
            plus = (down | ~(xv | up)) & mask
            minus = up & xv & mask
            if score < least:
                least, end = score, j + 1
        return least, end


def tree_path(cuts: list[int], leaf: int) -> list[tuple[int, int, int]]:
    """(begin, end, edits) of the nodes above a piece, smallest first, the root left out."""
    low, high, out = 0, len(cuts) - 1, []
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if leaf < middle else (middle, high)
        out.append((cuts[low], cuts[high], high - low - 1))
    return out[-2::-1]


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int = CHARS_PER_EDIT):
        usable = [(i, text) for i, t in items if (text := normal(t).strip())]
        self.ids = [i for i, _ in usable]
        self.texts = [t for _, t in usable]
        self.edits = [budget(len(t), chars_per_edit) if len(t) >= LEAST_CHARS else 0 for t in self.texts]
        self.patterns: dict[tuple[int, int, int], Pattern] = {}
        at: dict[str, list[tuple[int, int, list]]] = {}
        for n, text in enumerate(self.texts):
            parts = pieces(text, self.edits[n])
            cuts = [place for place, _ in parts] + [len(text)]
            for leaf, (place, piece) in enumerate(parts):
                at.setdefault(piece, []).append((n, place, tree_path(cuts, leaf)))
        self.found = ahocorasick.Automaton()
        for piece, where in at.items():
            self.found.add_word(piece, (len(piece), where))
        if at:
            self.found.make_automaton()

    def pattern(self, n: int, begin: int, end: int) -> Pattern:
        key = (n, begin, end)
        if key not in self.patterns:
            self.patterns[key] = Pattern(self.texts[n][begin:end])
        return self.patterns[key]

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Per item the stretches of ``text`` that a match around a piece can cover, merged."""
        out: dict[int, list[list[int]]] = {}
        if not len(self.found):
            return out
        hits: dict[int, set[int]] = {}
        for last, (length, where) in self.found.iter(text):
            start = last + 1 - length
            for n, place, path in where:
                zero = start - place
                if zero in hits.get(n, ()):
                    continue
                if len(self.texts[n]) < LEAST_CHARS and not whole_words(text, start, last + 1):
                    continue
                for begin, end, edits in path:
                    stretch = text[max(0, zero + begin - edits) : max(0, zero + end + edits)]
                    if self.pattern(n, begin, end).best(stretch)[0] > edits:
                        break
                else:
                    hits.setdefault(n, set()).add(zero)
        for n, starts in hits.items():
            size, k = len(self.texts[n]), self.edits[n]
            spans: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - k), min(len(text), s + size + k)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            out[n] = spans
        return out

    def matches(self, raw: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of each item's best match, the first of equal ones."""
        text = normal(raw)
        out, place = [], None
        for n, spans in self.windows(text).items():
            forward, best = self.pattern(n, 0, len(self.texts[n])), None
            for a, b in spans:
                distance, end = forward.best(text[a:b])
                if distance <= self.edits[n] and (best is None or distance < best[0]):
                    best = (distance, a, a + end)
            if best:
                distance, a, end = best
                _, back = Pattern(self.texts[n][::-1]).best(text[a:end][::-1])
                place = places(raw) if place is None else place
                out.append((self.ids[n], distance, int(place[end - back]), int(place[end - 1]) + 1))
        return out


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in order of id, a block of bounded size at a time."""
    usable = items.where(F.col("item_id").isNotNull() & (F.length("text") > 0)).select("item_id", "text")
    block, chars = [], 0
    for row in usable.orderBy("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        chars += len(row.text)
        if chars >= block_chars:
            yield block
            block, chars = [], 0
    if block:
        yield block


def contaminated(
    documents: DataFrame, items: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, item_id, distance, start, end) of each item's best match in each document."""
    schema = "doc_id long, item_id long, distance int, start int, end int"
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = documents.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, block_chars):

        def found(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, chars_per_edit)
            for batch in batches:
                rows = [
                    (doc, *match)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                    if text.is_valid
                    for match in matcher.matches(text.as_py())
                ]
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "distance", "start", "end"])

        out = out.union(texts.mapInArrow(found, schema))
    return out


_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())


def clean(documents: DataFrame, items: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``documents`` without those that hold a match of any item; all columns as they are."""
    out = documents
    for block in _blocks(items, block_chars):
        out = out.where(~_holds(block, chars_per_edit)(F.col("text").cast("string")))
    return out


def _holds(block: list[tuple[int, str]], chars_per_edit: int):
    """Whether a text holds a match of any item of the block."""

    @F.pandas_udf("boolean")
    def held(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(block, chars_per_edit)
        for texts in parts:
            yield texts.map(lambda t: bool(t and matcher.matches(t)))

    return held
