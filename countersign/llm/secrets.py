"""Secret scan: pattern spans, plus values of credential contexts that are costly to guess.

A value that follows a word such as ``password`` or ``login``, or stands as the password of an
address, up to its closing quote or delimiter, is cut into words, dates, repeats, keyboard walks and brute-force runs by dynamic
programming over its characters; the cut of least cost gives the number of guesses an attacker
needs. A value above the threshold is a secret, a guessable one (``changeme``, ``qwerty123``)
is not.

Words are those of a short fixed list and the commonest words of the corpus itself: letter words that
stand in running text, not where a value would stand, counted over all documents. A word costs the
logarithm of its place by count. The list holds at most ``MOST_WORDS`` words, as an attacker's does,
which bounds what is sent to tasks; rarer words are spelled out. A ``Bearer`` or ``Basic`` without
``:`` or ``=`` before it is a context only if its value does not look like a word.

Edge cases: a NULL or empty text has no spans; a value longer than ``LONGEST_GUESSED``
characters is costly whatever it holds, its cost bounded from below by that of its best pieces;
repeated rows give repeated results; columns beyond ``doc_id`` and ``text`` play no part.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

KINDS = ("assign", "access", "hex", "context")
#: A context value counts from this many guesses (log10) on.
LEAST_GUESSES = 8.0
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_HEX_MARKS = bytes(46 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
#: Contexts of credentials, those of the pattern above among them, up to their value; group 1 is the quote that
#: opens the value, group 2 the user of an address, group 3 a scheme that stands alone. A prefix may stand before an underscore.
_CONTEXT = re.compile(
    r"""(?:password|passwd|secret|token|api_?key|(?<![a-z0-9])(?:pwd|passphrase|pass|passcode|credentials?|auth"""
    r"""|private_?key|access_?key|login|bearer))["']?\x20*[:=]\x20*(["'])?(?:(?:Bearer|Basic)\x20+)?"""
    r"""|://(?=([^\s/:@]+:))|\b(Bearer|Basic)\x20+""",
    re.I | re.A,
)
_CONTEXT_HINT = re.compile(r"pwd|passw|passp|pass\b|passco|secret|token|credential|auth|_?key|login|bearer|basic|://", re.I | re.A)
#: A value in quotes ends at the closing quote of its line, any other at a delimiter, that of an address also at ``@``.
_QUOTED = {q: re.compile(rf"(?!\s)(?:[^{q}\\\r\n]|\\.)*+(?={q})") for q in "\"'"}
_BARE = re.compile(r"""[^\x00-\x20\x7f-\U0010ffff"'<>,;)\]}]*""")
_OF_ADDRESS = re.compile(r"""[^\x00-\x20\x7f-\U0010ffff"'<>,;)\]}@]*""")
#: Longest stretch that one run of the program looks at; longer values are cut into such pieces.
LONGEST_GUESSED = 256

# Common passwords and words, commonest first; a word's place is its guess count.
_WORDS = """
password 123456 12345678 qwerty abc123 monkey letmein dragon iloveyou trustno1 sunshine master
welcome shadow ashley football jesus michael ninja mustang admin root user guest login test
changeme secret default access token hello love freedom whatever starwars computer internet
summer winter spring autumn january february march april may june july august september october
november december monday tuesday wednesday thursday friday saturday sunday company server system
example sample demo temp temporary none null true false xxxx placeholder your mypassword pass
the and that this with from have for not you are but all can had her was one our out day get has
""".split()
_RANK = {word: place + 1 for place, word in enumerate(_WORDS)}
#: Words of the corpus that are taken for guessable, how often each must occur, and their lengths.
MOST_WORDS = 100_000
LEAST_COUNT = 3
SHORTEST_WORD, LONGEST_WORD = 4, 24
#: A word of running text, perhaps with a sign after it, that does not follow an assignment.
_PROSE_WORD = rf"""(?<!\S)(?<![:=]\x20{{0,8}})\p{{L}}{{{SHORTEST_WORD},{LONGEST_WORD}}}(?=[.,;!?]?(?:\s|$))"""
#: What a value after a bare ``Bearer`` or ``Basic`` looks like if it is a word of a sentence.
_WORDLIKE = re.compile(r"[A-Za-z]?[a-z]*[.:!?]*|[A-Z]+[.:!?]*")
# Rows of a keyboard, for walks.
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {pair for row in _ROWS for pair in [*zip(row, row[1:], strict=False), *zip(row[1:], row, strict=False)]}
_LEET = str.maketrans("4301$5@7", "aeolssat")
_DATE = re.compile(
    r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?"
    r"|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d"
)
_DATE_GUESSES = {4: 2.1}


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def _brute(char: str) -> float:
    if char.isdigit():
        return 1.0
    return math.log10(26) if char.isalpha() else math.log10(33)


def common_words(documents: DataFrame, most_words: int = MOST_WORDS) -> dict[str, int]:
    """The commonest words of running text in all of ``text``, each with its place by count.

    A word has to occur ``LEAST_COUNT`` times. The least count is then raised, by steps of about a
    tenth, until at most ``most_words`` words reach it, so words of equal count come or go together.
    """
    words = F.explode(F.regexp_extract_all(F.lower(F.col("text")), F.lit(_PROSE_WORD), F.lit(0)))
    counts = documents.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    step = F.floor(F.log2("n") * 8).cast("int")
    counts = checkpointed(counts.where(F.col("n") >= LEAST_COUNT).withColumn("step", step))
    # A few hundred steps at most: they go with the logarithm of the count.
    steps = {r.step: r.words for r in counts.groupBy("step").agg(F.count("*").alias("words")).collect()}
    held, least = 0, None
    for at in sorted(steps, reverse=True):
        held += steps[at]
        if held > most_words:
            break
        least = at
    if least is None:
        return {}
    rows = counts.where(F.col("step") >= least).select("word", "n").collect()
    return {r.word: place + 1 for place, r in enumerate(sorted(rows, key=lambda r: (-r.n, r.word)))}


def guess_cost(value: str, ranks: Mapping[str, int] = _RANK) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes.

    ``ranks`` holds words in lower case and their places in the order of guessing.
    """
    if len(value) > LONGEST_GUESSED:
        pieces = range(0, len(value), LONGEST_GUESSED)
        return sum(guess_cost(value[i : i + LONGEST_GUESSED], ranks) for i in pieces)
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n
    for i in range(n):
        here = best[i]

        def offer(j: int, cost: float, here: float = here) -> None:
            if here + cost < best[j]:
                best[j] = here + cost

        offer(i + 1, _brute(value[i]) + 0.2 * value[i].isupper())
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            rank = ranks.get(low[i:j]) or 2 * ranks.get(plain[i:j], 0)
            if rank:
                offer(j, math.log10(rank + 1) + 0.3 * (value[i:j] != low[i:j]) + 0.3)
        for found in (_DATE.match(low, i),):
            if found:
                offer(found.end(), _DATE_GUESSES.get(found.end() - i, 4.6))
        for period in (1, 2, 3, 4):
            j = i + period
            while j < n and low[j] == low[j - period]:
                j += 1
            if j - i >= max(3, 2 * period):
                unit = sum(map(_brute, low[i : i + period]))
                for stop in range(i + max(3, 2 * period), j + 1):
                    offer(stop, unit + math.log10(stop - i))
        j = i + 1
        while j < n and (low[j - 1], low[j]) in _NEXT:
            j += 1
            if j - i >= 3:
                offer(j, 1.7 + math.log10(j - i))
    return best[n]


def base_spans(text: str) -> list[Span]:
    found = []
    if _ASSIGN_HINT.search(text):
        found += [Span(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [Span(*m.span(), "access") for m in _ACCESS.finditer(text)]
    if b"." * 32 in text.encode("utf-8", "replace").translate(_HEX_MARKS):
        found += [Span(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def context_spans(
    text: str, least_guesses: float = LEAST_GUESSES, ranks: Mapping[str, int] = _RANK
) -> list[Span]:
    """Values of credential contexts whose guess cost reaches the threshold."""
    found = []
    if not _CONTEXT_HINT.search(text):
        return found
    # A value that begins within one judged before ends no later and costs no more.
    judged = address = 0
    for m in _CONTEXT.finditer(text):
        of_address = m.group(2) is not None
        start = m.end(2) if of_address else m.end()
        if start < judged or of_address and start < address:
            continue
        if of_address:
            address = end = _OF_ADDRESS.match(text, start).end()
            if text[end : end + 1] != "@":
                continue
        else:
            quoted = _QUOTED[m.group(1)].match(text, start) if m.group(1) else None
            end = (quoted or _BARE.match(text, start)).end()
            if m.group(3) and _WORDLIKE.fullmatch(text, start, end):
                continue
        judged = end
        if end - start >= 6 and guess_cost(text[start:end], ranks) >= least_guesses:
            found.append(Span(start, end, "context"))
    return found


def secret_spans(
    text: str | None, least_guesses: float = LEAST_GUESSES, ranks: Mapping[str, int] = _RANK
) -> list[Span]:
    """All spans by start; a context value that a pattern span covers already is left out."""
    text = text or ""
    base = base_spans(text)
    more = [
        s for s in context_spans(text, least_guesses, ranks) if not any(b.start <= s.start and s.end <= b.end for b in base)
    ]
    return sorted(base + more, key=lambda s: (s.start, KINDS.index(s.kind)))


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for span in sorted(spans):
        if span.end <= at:
            continue
        if span.start >= at:
            out += [text[at : span.start], mark]
        at = span.end
    return "".join(out) + text[at:]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def guessable(documents: DataFrame, most_words: int = MOST_WORDS) -> dict[str, int]:
    """Places of the fixed words and of the corpus's commonest, the better one where both have a word."""
    found = common_words(documents, most_words)
    return found | {word: min(place, found.get(word, place)) for word, place in _RANK.items()}


def scan(
    documents: DataFrame, least_guesses: float = LEAST_GUESSES, ranks: Mapping[str, int] | None = None
) -> DataFrame:
    """``documents`` with ``spans``: an array of (start, end, kind) over code points, end exclusive.

    ``ranks`` are words and places; by default those of the documents themselves.
    """
    ranks = guessable(documents) if ranks is None else ranks

    @F.pandas_udf("array<struct<start:int,end:int,kind:string>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [s._asdict() for s in secret_spans(t, least_guesses, ranks)])

    return documents.withColumn("spans", spans("text"))


def redact(
    documents: DataFrame, least_guesses: float = LEAST_GUESSES, ranks: Mapping[str, int] | None = None
) -> DataFrame:
    """``documents`` with secrets of ``text`` replaced by a mark; NULL stays NULL."""
    ranks = guessable(documents) if ranks is None else ranks

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redacted(t, secret_spans(t, least_guesses, ranks)))

    return documents.withColumn("text", cleaned("text"))


def digest(documents: DataFrame, least_guesses: float = LEAST_GUESSES) -> DataFrame:
    """Per document the counts, the hash of the pattern spans and the list of all spans."""
    found = scan(documents.select("doc_id", "text"), least_guesses).select("doc_id", "spans")

    def joined(spans):
        each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.concat_ws(",", each)

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "context")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def span_hash(spans: list[Span]) -> str:
    """What ``digest`` gives as ``base_sha256`` for these pattern spans."""
    return hashlib.sha256(listed(spans).encode()).hexdigest()
