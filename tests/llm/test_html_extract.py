import html
import itertools
import re
import time

import numpy as np
import pytest

from countersign.llm import html_extract as h
from countersign.llm.queries import op1_main_text
from tests.llm.conftest import ROOT, SMALL


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(f"{ROOT}/sf0.01/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def model(pages):
    return h.boost(*h.training_rows(pages[:120]))


def article(page):
    """The article of a page of the corpus, by its own template."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
    texts = (re.sub(r"\s+", " ", html.unescape(t)).strip() for t in parts)
    return "\n\n".join(t for t in texts if t)


def test_held_out_pages(pages, model):
    assert h.extract(pages[120:], model) == [article(p) for p in pages[120:]]


def test_pages_with_other_blocks(pages, model):
    """Grafted comments, notices, forms, sidebars and the like go, whatever the main block is called."""
    right = 0
    for n in range(150, 220):
        page = h.graft(pages[n], pages[n + 1], n)
        root = h.parse(page)
        assert h.label(root)
        want = "\n\n".join(h.blocks(root, {id(k) for k in h._walk(root) if k.label}))
        right += h.extract([page], model)[0] == want
    assert right >= 60


CASES = [
    ("", ""), (None, ""), ("plain text", "plain text"), ("a &lt;b&gt; &amp;&eacute;&#233;&#x1F600;", "a <b> &éé😀"),
    ("<script>var a = '<p>no</p>'</script>", ""), ("<p>one<p>two", "one\n\ntwo"), ("<p>a <b>b <i>c</p><p>d", "a b c\n\nd"),
    ("x<!-- <p>no</p> -->y", "xy"), ("<p>a<br>b</p>\n\n<p> </p>", "a b"), ("</div></p>x", "x"), ("<p>a < b > c</p>", "a < b > c"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_parsing(page, text):
    assert h.extract([page], h.Boosted(3.0, [])) == [text]


OPEN = [
    ("<datalist><option value=a><option value=b></datalist><p>one", "one"), ("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b", "a x=1 b"),
    ("<svg viewBox='0 0 1 1'><path d='M0'/><g><p>one</p>", "one"), ("<math><mi>x<p>one</p><p>two", "x\n\none\n\ntwo"),
    ("<select><optgroup><option>a<option>b<optgroup><option>c</select><p>d", "a\n\nb\n\nc\n\nd"), ("a<svg/>b<p>c", "ab\n\nc"),
    ("<svg><title>no</title><text>yes</text><foreignObject><div><p>in</p></div></foreignObject></svg><p>out", "yes\n\nin\n\nout"),
]


@pytest.mark.parametrize("page,text", OPEN)
def test_options_and_foreign_elements_drop_nothing(page, text):
    assert h.extract([page], h.Boosted(3.0, [])) == [text]


def test_options_close_themselves():
    nodes = h._walk(h.parse("<select><optgroup><option>a<option>b<optgroup><option>c</select><p>d"))
    assert [(k.name, k.depth) for k in nodes[1:]] == [
        ("select", 1), ("optgroup", 2), ("option", 3), ("option", 3), ("optgroup", 2), ("option", 3), ("p", 1)
    ]


def test_an_article_after_a_search_box_stays(pages, model):
    box = "<form><input list=q><datalist id=q><option value=a><option value=b></datalist></form>"
    page = pages[130].replace("<body>", "<body>" + box, 1)
    assert page != pages[130] and h.extract([page], model) == [article(pages[130])]


def test_deep_and_long_pages(model):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    long = "<article>" + "<p>some words here, and more. </p>" * 5000 + "</article>"
    assert h.extract([deep], h.Boosted(3.0, [])) == ["x"]
    assert h.extract([f"<html><body><nav><a href=a>b</a></nav>{long}</body></html>"], model)[0].count("\n\n") == 4999


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(5)
    for _ in range(30):
        page = "".join(rng.choice(["<div>", "</div>", "<section>", "x"]) for _ in range(14))
        nodes = h._walk(h.parse(page))
        odds = rng.normal(size=len(nodes)) * 2
        at = {id(k): i for i, k in enumerate(nodes)}
        best = -np.inf
        for choice in itertools.product([0, 1], repeat=len(nodes) - 1):
            kept = [1, *choice]
            if all(kept[at[id(k.parent)]] >= kept[i] for i, k in enumerate(nodes) if k.parent):
                best = max(best, sum(-np.logaddexp(0, -o if c else o) for c, o in zip(kept[1:], odds[1:], strict=True)))
        got = h.decode(nodes, odds)
        assert all(got[at[id(k.parent)]] >= got[i] for i, k in enumerate(nodes) if k.parent)
        value = sum(-np.logaddexp(0, -o if c else o) for c, o in zip(got[1:], odds[1:], strict=True))
        assert value == pytest.approx(best)


def test_query(spark):
    want = {r.page_id: article(r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = op1_main_text(spark, SMALL).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("unit", ['<a "', "<a '\"", "<a ", "<!x", "<a<b", '<a "\'" \'', "<a b=c", "<" + "a" * 50])
def test_tags_that_never_end_take_linear_time(unit):
    page = "<p>one</p>" + unit * (1_000_000 // len(unit))
    start = time.perf_counter()
    assert h.extract([page], h.Boosted(3.0, []))[0].startswith("one")
    assert h.extract([page + ">"], h.Boosted(3.0, []))[0].startswith("one")
    assert time.perf_counter() - start < 30


def test_long_attributes_take_linear_time():
    start = time.perf_counter()
    assert h.extract(["<p " + "a" * 1_000_000 + ">one"], h.Boosted(3.0, [])) == ["one"]
    assert time.perf_counter() - start < 10


def plain_end(page, at):
    """The ``>`` of a tag found character by character."""
    quote = ""
    for i in range(at, len(page)):
        if quote:
            quote = "" if page[i] == quote else quote
        elif page[i] in "\"'":
            quote = page[i]
        elif page[i] == ">":
            return i
    return -1


def test_ends_of_tags_equal_a_plain_scan():
    rng = np.random.default_rng(3)
    for _ in range(300):
        page = "".join(rng.choice(["<a ", "<b", '"', "'", ">", " ", "x"]) for _ in range(40))
        tags, at, got, want = h.Tags(page), 0, [], []
        while found := tags.after(at):
            got.append(found[:2])
            at = found[1]
        at = 0
        while m := re.compile(r"<[ab]").search(page, at):
            end = plain_end(page, m.end())
            want += [(m.start(), end + 1)] if end >= 0 else []
            at = end + 1 if end >= 0 else m.start() + 1
        assert got == want


def test_odd_rows(spark):
    rows = [(1, "u", None, "a"), (1, "u", None, "a"), (2, None, "", "b"), (None, "v", "<p>x &amp; y</p>", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = h.main_text(frame, h.fit(frame)).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("", 0), ("", 0), ("x & y", 5)]
    assert h.main_text(frame.where("false"), h.fit(frame.where("false"))).count() == 0
