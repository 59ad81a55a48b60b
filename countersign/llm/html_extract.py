"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded from the top.

Each element gets features: density of text, links and tags in its subtree, tokens of its name,
class, id and role, depth, and statistics of its place among its siblings. Boosted trees give the
probability that the element belongs to the main text. The decision is then taken for the whole
tree: an element that is dropped takes its subtree with it, and a kept element has kept ancestors,
so of all such choices the one of greatest total log likelihood is found from the leaves up.

There are no hand-labelled pages. The labels come from pages whose elements say what they are
(``article`` or ``main`` against ``nav``, ``footer``, ``aside`` and the like), and from blocks
grafted into them (comments, notices, forms, sidebars, headers, adverts, with and without telling tokens,
from other text of the corpus), whose label is known. The sample is bounded: ``SAMPLE_PAGES``
pages, those with the least hash of their address and id.

Character references are decoded, white space in a block becomes one space, blocks are trimmed
and joined by blank lines; nothing is cut.

Edge cases: NULL, empty or text-free html gives the empty text; unclosed and stray tags are read
in time linear in the page, and as browsers do in the common cases (paragraphs, items, cells and options close themselves, blocks
end an open ``svg`` or ``math``); a tag that never ends, as by an unclosed quote, is text; text outside
any markup is a page of its own kind and is kept; very deep trees are read without recursion;
repeated rows give repeated results; an empty table gives an empty result; other columns pass
through, columns of the result's names are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SAMPLE_PAGES = 300
_BATCH_NODES = 20_000
TREES, LEAVES_DEPTH, RATE, BINS = 50, 4, 0.2, 32

# Element names of the HTML standard by their role in the page.
_VOID = set("area base br col embed hr img input link meta source track wbr param frame".split())
_RAW = set("script style textarea title noscript template iframe".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr img br button".split()
)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSES_P = set(
    "address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section table td th tr ul dd dt".split()
)
_SELF = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SELF |= {"option": ("option",), "optgroup": ("optgroup",)}
_SCOPE = set("table ul ol dl article section div body html td th nav aside main footer header form select datalist".split())
#: Elements of other languages, which blocks of a page end, and those in them that hold page markup.
_FOREIGN = {"svg", "math"}
_HOSTS = set("foreignobject desc annotation-xml mi mo mn ms mtext".split())
_NAMES = tuple(
    "html body main article section div p ul ol li table tr td h1 h2 h3 blockquote pre figure figcaption nav aside "
    "header footer form dl span a".split()
)
# Groups of tokens in names, classes, ids and roles that tell what a block is.
_GROUPS = {
    "navigation": "nav navigation navbar menu menubar breadcrumb breadcrumbs toc pagination pager tabs links skip",
    "head": "header masthead banner topbar logo branding hero head",
    "foot": "footer foot colophon copyright legal bottom contentinfo",
    "side": "aside sidebar side rail related recommended complementary widget widgets trending popular more tags",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay disclaimer subscribe newsletter signup paywall",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion promoted banner-ad adsense dfp",
    "form": "form search login register contact input poll survey feedback",
    "talk": "comment comments reply replies respond discussion disqus review reviews reader thread",
    "share": "share sharing social twitter facebook follow",
    "main": "article main content post entry story body text page single hentry prose document",
}
_GROUP_OF = {word: i for i, words in enumerate(_GROUPS.values()) for word in words.split()}
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: What may begin a comment, a declaration or a tag; a tag ends at the first ``>`` outside quotes.
_MARKUP = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>\"'<]*+))")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(?<![^\s=/\"'>])([^\s=/\"'>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_BLANK = re.compile(r"\s+")


class Node:
    """An element; ``children`` holds elements and texts in page order."""

    __slots__ = ("name", "tokens", "parent", "children", "depth", "foreign", "inline", "label")

    def __init__(self, name: str, tokens: Sequence[str], parent: Node | None):
        self.name, self.tokens, self.parent = name, tokens, parent
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        around = parent is not None and parent.foreign
        self.foreign = name in _FOREIGN or around and name not in _HOSTS
        self.inline = name in _INLINE or self.foreign or around and name != "foreignobject"
        self.label: int | None = None


def _tokens(name: str, attributes: str) -> list[str]:
    out = [name]
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            key = m.group(1).lower()
            if key in ("class", "id", "role"):
                value = m.group(2) or m.group(3) or m.group(4) or ""
                out += [t.lower() for t in _TOKEN.findall(value)]
            elif key in ("hidden", "aria-hidden"):
                out.append("hidden")
    return out


class Tags:
    """The markup of a page from left to right, in time linear in the page whatever its quotes do."""

    def __init__(self, page: str):
        self.page = page
        self._last = page.rfind(">")
        # Opening quotes from which no tag ends, and the stop that follows the places looked at last.
        self._dead: set[int] = set()
        self._from = self._stop = -1

    def _next_stop(self, at: int) -> int:
        if not self._from <= at <= self._stop:
            found = _STOP.search(self.page, at)
            self._from, self._stop = at, found.start() if found else len(self.page)
        return self._stop

    def _end(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` has its ``>``; -1 if nowhere."""
        page, size, opened = self.page, len(self.page), []
        stop = self._next_stop(at)
        while stop < size and page[stop] != ">":
            if stop in self._dead:
                break
            opened.append(stop)
            close = page.find(page[stop], stop + 1)
            if close < 0:
                break
            found = _STOP.search(page, close + 1)
            stop = found.start() if found else size
        else:
            if stop < size:
                return stop
        self._dead.update(opened)
        return -1

    def after(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """Of the next markup from ``at`` on: start, end, whether an end tag, name (None: no tag), attributes."""
        page = self.page
        while m := _MARKUP.search(page, at):
            start = m.start()
            if m.group(1):
                end = page.find("-->", m.end())
                return start, len(page) if end < 0 else end + 3, False, None, ""
            if m.group(2):
                if m.end() <= self._last:
                    return start, page.index(">", m.end()) + 1, False, None, ""
            elif m.end() <= self._last and (end := self._end(m.end())) >= 0:
                return start, end + 1, bool(m.group(3)), m.group(4), page[m.end() : end]
            at = start + 1
        return None


def parse(page: str) -> Node:
    """The tree of elements; scripts, styles, titles and the like leave no text."""
    root = node = Node("#root", (), None)
    at, size = 0, len(page)
    tags = Tags(page)
    while at < size:
        found = tags.after(at)
        if not found:
            node.children.append(page[at:])
            break
        start, end, closing, name, attributes = found
        if start > at:
            node.children.append(page[at:start])
        at = end
        if name is None:
            continue
        name = name.lower()
        if closing:
            up = node
            while up is not root and up.name != name:
                # An end tag does not reach out of its block, as for stray inline ends.
                up = root if up.name in _SCOPE and name in _INLINE else up.parent
            if up is not root:
                node = up.parent
            continue
        while node.foreign and (name in _CLOSES_P or name in _HEADINGS):
            node = node.parent
        if name in _CLOSES_P:
            node = _closed(node, ("p",), root)
        if name == "optgroup":
            node = _closed(node, ("option",), root)
        if name in _SELF:
            node = _closed(node, _SELF[name], root)
        if name in _HEADINGS and node.name in _HEADINGS:
            node = node.parent
        if name in _VOID:
            if name in ("br", "hr", "img", "wbr", "input"):
                node.children.append(" ")
            continue
        if name in _RAW and not attributes.endswith("/"):
            end = _ENDS[name].search(page, at)
            at = end.end() if end else size
            continue
        child = Node(name, _tokens(name, attributes), node)
        node.children.append(child)
        if not (attributes.endswith("/") and (node.foreign or child.foreign)):
            node = child
    return root


def _closed(node: Node, names: tuple[str, ...], root: Node) -> Node:
    """Leave the nearest open element of these names, if no block lies between."""
    up = node
    while up is not root and up.name not in names:
        if up.name in _SCOPE:
            return node
        up = up.parent
    return up.parent if up is not root else node


def _walk(root: Node) -> list[Node]:
    """All elements, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


FEATURES = 13 + len(_NAMES) + 2 * len(_GROUPS)


def features(nodes: list[Node]) -> np.ndarray:
    """One row per element of a tree given by ``_walk``."""
    n = len(nodes)
    place = {id(node): i for i, node in enumerate(nodes)}
    x = np.zeros((n, FEATURES), np.float32)
    text, link, tags, words, stops = (np.zeros(n) for _ in range(5))
    parent = np.array([place[id(k.parent)] if k.parent else -1 for k in nodes])
    for i, node in enumerate(nodes):
        tags[i] += 1
        for c in node.children:
            if isinstance(c, str):
                length = len(c) if not c.isspace() else 0
                text[i] += length
                words[i] += c.count(" ") if length else 0
                stops[i] += c.count(".") + c.count(",") if length else 0
    own = text.copy()
    for i in range(n - 1, 0, -1):
        if nodes[i].name == "a":
            link[i] = text[i]
        for a in (text, link, tags, words, stops):
            a[parent[i]] += a[i]
    whole = max(text[0], 1.0)
    kids: dict[int, list[int]] = {}
    for i in range(1, n):
        kids.setdefault(parent[i], []).append(i)
    x[:, 0] = np.log1p(text)
    x[:, 1] = text / whole
    x[:, 2] = text / tags
    x[:, 3] = link / np.maximum(text, 1)
    x[:, 4] = stops / np.maximum(words + 1, 1)
    x[:, 5] = [k.depth for k in nodes]
    x[:, 6] = own / np.maximum(text, 1)
    for at, group in kids.items():
        total, best = text[at], max(text[i] for i in group)
        same: dict[str, int] = {}
        for i in group:
            same[nodes[i].name] = same.get(nodes[i].name, 0) + 1
        for j, i in enumerate(group):
            x[i, 7] = j / len(group)
            x[i, 8] = len(group)
            x[i, 9] = text[i] / max(total, 1)
            x[i, 10] = same[nodes[i].name] / len(group)
            x[i, 11] = text[i] >= best
    x[1:, 12] = x[parent[1:], 3]
    names = 13 + len(_NAMES)
    for i, node in enumerate(nodes):
        if node.name in _NAMES:
            x[i, 13 + _NAMES.index(node.name)] = 1
        for t in node.tokens:
            g = _GROUP_OF.get(t)
            if g is not None:
                x[i, names + g] = 1
        if parent[i] >= 0:  # what any element around says
            around = names + len(_GROUPS)
            x[i, around:] = np.maximum(x[parent[i], around:], x[parent[i], names:around])
    return x


class Tree(NamedTuple):
    """A tree of fixed depth: feature and threshold of inner nodes in heap order, leaf values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray


class Boosted(NamedTuple):
    start: float
    trees: list[Tree]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(LEAVES_DEPTH):
                at = 2 * at + 1 + (x[rows, tree.feature[at]] > tree.threshold[at])
            out += tree.value[at - len(tree.feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES) -> Boosted:
    """Trees by gradient and Hessian of the logistic loss over histograms of binned features."""
    cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    score, grown = np.full(len(y), start), []
    columns, inner = np.arange(x.shape[1]), 2**LEAVES_DEPTH - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            here = np.flatnonzero(at == node)
            if len(here) < 8:
                at[here] = 2 * node + 1
                continue
            flat = (binned[here] + columns * (BINS + 1)).ravel()
            size = (BINS + 1) * len(columns)
            gs = np.bincount(flat, np.repeat(g[here], len(columns)), size).reshape(len(columns), -1).cumsum(axis=1)
            hs = np.bincount(flat, np.repeat(h[here], len(columns)), size).reshape(len(columns), -1).cumsum(axis=1)
            gt, ht = gs[:, -1:], hs[:, -1:]
            gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
            gain[:, -1] = -1
            best = int(np.argmax(gain))
            f, b = divmod(best, BINS + 1)
            if gain[f, b] > 1e-6 and b < len(cuts[f]):
                feature[node], threshold[node] = f, cuts[f][b]
            at[here] = 2 * node + 1 + (x[here, feature[node]] > threshold[node])
        leaf = at - inner
        value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1) * RATE
        score += value[leaf]
        grown.append(Tree(feature, threshold, value))
    return Boosted(start, grown)


def decode(nodes: list[Node], log_odds: np.ndarray) -> np.ndarray:
    """Which elements are kept: the likeliest choice in which no kept element has a dropped parent."""
    n = len(nodes)
    place = {id(node): i for i, node in enumerate(nodes)}
    parent = np.array([place[id(k.parent)] if k.parent else -1 for k in nodes])
    keep, drop = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    best = keep.copy()  # kept, with the best choice below
    gone = drop.copy()  # dropped with all below
    for i in range(n - 1, 0, -1):
        gone[parent[i]] += gone[i]
        best[parent[i]] += max(best[i], gone[i])
    kept = np.zeros(n, bool)
    kept[0] = True  # the root is no element
    for i in range(1, n):
        kept[i] = kept[parent[i]] and best[i] >= gone[i]
    return kept


def blocks(root: Node, kept: set[int]) -> list[str]:
    """Texts of kept blocks in page order; inline elements are part of the block around them."""
    out: list[str] = []
    current: list[str] = []

    def close() -> None:
        text = _BLANK.sub(" ", html.unescape("".join(current))).strip()
        if text:
            out.append(text)
        current.clear()

    stack: list[Node | str | None] = [root]
    while stack:
        item = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            current.append(item)
        elif id(item) in kept:
            if not item.inline:
                close()
                stack.append(None)
            stack += reversed(item.children)
        elif not item.inline:
            close()
    close()
    return out


def extract(pages: Sequence[str | None], model: Boosted) -> list[str]:
    """Main texts of some pages; their elements are scored together, ``_BATCH_NODES`` at a time."""
    out: list[str] = []
    trees: list[tuple[Node, list[Node]]] = []
    rows: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        odds = model.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
        at = 0
        for root, nodes in trees:
            kept = decode(nodes, odds[at : at + len(nodes)])
            at += len(nodes)
            out.append("\n\n".join(blocks(root, {id(k) for k, yes in zip(nodes, kept, strict=True) if yes})))
        trees.clear()
        rows.clear()

    for page in pages:
        root = parse(page or "")
        nodes = _walk(root)
        trees.append((root, nodes))
        rows.append(features(nodes))
        held += len(nodes)
        if held >= _BATCH_NODES:
            flush()
            held = 0
    flush()
    return out


# Training pages.

# Elements that say by themselves that they are no main text.
_APART = set("nav footer aside header form menu".split())
_GRAFTS = (
    ("div", "comments"), ("section", "reader-comments"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "sidebar"),
    ("aside", ""), ("div", "related-posts"), ("div", "widget"), ("header", ""), ("div", "site-header"), ("nav", ""),
    ("div", "navbar"), ("ul", "menu"), ("footer", ""), ("div", "site-footer"), ("div", "cookie-notice"), ("div", "notice"),
    ("div", "alert"), ("div", "newsletter-signup"), ("form", ""), ("form", "search"), ("div", "contact-form"), ("div", "ad"),
    ("div", "advert"), ("div", "sponsored"), ("div", "promo"), ("div", "share social"), ("p", "copyright"), ("div", "disclaimer"),
)
_WRAPS = (("article", ""), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "post"), ("section", "entry-content"),
          ("div", "story"), ("div", ""), ("section", ""))


#: A token that marks a wrap whose name no longer tells; no feature looks at it.
_MARK = "markedmain"


def _marked(node: Node) -> bool:
    return node.name in ("article", "main") or _MARK in node.tokens


def label(root: Node) -> bool:
    """Label a tree by what its elements say; False if no element says it is the main text."""
    nodes = _walk(root)
    if not any(map(_marked, nodes)):
        return False
    for node in nodes:
        if node.parent is None:
            node.label = 1
        elif node.parent.label == 0 or node.name in _APART:
            node.label = 0
        elif any(_GROUP_OF.get(t) in range(len(_GROUPS) - 1) for t in node.tokens[1:]):
            node.label = 0
        elif node.parent.label == 2 or _marked(node):
            node.label = 2  # inside the main text
        else:
            node.label = 3  # undecided: kept if main text lies below
    for node in reversed(nodes):
        if node.label == 3:
            node.label = int(any(isinstance(c, Node) and c.label in (1, 2) for c in node.children))
    for node in nodes:
        if node.parent is not None and node.parent.label == 0:
            node.label = 0
    for node in nodes:
        node.label = int(node.label != 0)
    return True


def graft(page: str, other: str, number: int) -> str:
    """``page`` with blocks of ``other`` text grafted around and into its main text."""
    rng = np.random.Generator(np.random.PCG64(number))
    texts = [t for t in (_BLANK.sub(" ", t).strip() for t in re.split(r"<[^>]*>", other)) if len(t) > 15] or ["Read more here."]

    def block() -> str:
        name, tokens = _GRAFTS[rng.integers(len(_GRAFTS))]
        parts = []
        for _ in range(rng.integers(1, 5)):
            text = texts[rng.integers(len(texts))][: int(rng.integers(20, 400))]
            inner = f'<a href="#">{text[:40]}</a>' if rng.random() < 0.3 else text
            parts.append(f"<{'li' if name in ('ul', 'ol') else 'p'}>{inner}" + ("</li>" if name in ("ul", "ol") else "</p>"))
        return f'<{name}{f" class={chr(34)}{tokens}{chr(34)}" if tokens else ""}>{"".join(parts)}</{name}>'

    name, tokens = _WRAPS[rng.integers(len(_WRAPS))]
    open_ = f'<{name} class="{tokens} {_MARK}">'
    body = re.sub(r"<(article|main)\b[^>]*>", open_, page, count=1, flags=re.I)
    inside = "".join(block() for _ in range(rng.integers(0, 3)))
    body = re.sub(r"</(article|main)\s*>", lambda _: f"{inside}</{name}>", body, count=1, flags=re.I)
    before = "".join(block() for _ in range(rng.integers(0, 3)))
    after = "".join(block() for _ in range(rng.integers(0, 4)))
    body = body.replace(open_, before + open_, 1)
    return re.sub(r"(</body>|$)", lambda m: after + m.group(0), body, count=1, flags=re.I)


def training_rows(pages: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of the elements of labelled pages; every page weighs the same."""
    xs, ys, ws = [], [], []
    for number, page in enumerate(pages):
        for variant in range(5):
            if variant == 4:  # the main text as a fragment without a page around it
                inner = re.search(r"<(article|main)\b[^>]*>(.*?)</\1\s*>", page, re.S | re.I)
                root = parse(inner.group(2) if inner and number % 4 == 0 else "")
                for node in _walk(root):
                    node.label = 1
            else:
                text = page if variant == 0 else graft(page, pages[(number * 7 + variant) % len(pages)], number * 4 + variant)
                root = parse(text)
                if not label(root):
                    continue
            nodes = _walk(root)
            if len(nodes) == 1:
                continue
            xs.append(features(nodes)[1:])
            ys.append(np.array([k.label for k in nodes[1:]], float))
            ws.append(np.full(len(nodes) - 1, 1 / max(1, len(nodes) - 1)))
    if not xs:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0), np.zeros(0)
    weight = np.concatenate(ws)
    return np.concatenate(xs), np.concatenate(ys), weight / weight.mean()


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Boosted:
    """Trees from a bounded sample of ``pages`` (page_id, html) that say where their main text is."""
    telling = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b") & (F.length("html") < 100_000))
    rows = telling.select(
        F.xxhash64(F.col("page_id").cast("string")).alias("key"), "page_id", F.xxhash64("html").alias("of"), "html"
    )
    # Ids first: only pages that are used travel whole, and of repeated rows one.
    least = rows.select("key", "page_id", "of").distinct().orderBy("key", "page_id", "of").limit(sample_pages)
    chosen = checkpointed(least)
    same = [rows[c].eqNullSafe(chosen[c]) for c in ("key", "page_id", "of")]
    whole = rows.join(F.broadcast(chosen), same, "left_semi").groupBy("key", "page_id", "of").agg(F.first("html").alias("html"))
    sample = [r.html for r in whole.orderBy("key", "page_id", "of").collect()]
    x, y, weight = training_rows(sample)
    return boost(x, y, weight) if len(y) else Boosted(2.0, [])


def main_text(pages: DataFrame, model: Boosted, page: Column | None = None) -> DataFrame:
    """``pages`` with ``text`` and its length in code points, ``n_chars``, in place of ``html``."""
    page = F.col("html") if page is None else page

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(extract(part.tolist(), model), index=part.index, dtype=object)

    carried = [c for c in pages.columns if c not in ("text", "n_chars", "html")]
    found = pages.select(*carried, text(page.cast("string")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
