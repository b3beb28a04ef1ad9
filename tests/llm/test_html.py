"""Main text of pages: known layouts, labelled pages held out, exact marginals."""

from __future__ import annotations

import html
import itertools
import re

import numpy as np
import pytest

from updraft.llm import html_extract as hx
from updraft.llm import html_pages
from updraft.llm.common import table
from updraft.llm.html_tree import parse

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return hx.fit(spark, pages=1500)


def test_tree_mends_broken_markup():
    tree = parse("<p><b>one<br>two<p class='x y'>a &lt; b &amp c<ul><li>i<li>j</ul><script>var t='</p>';</script>tail <!-- no --><a href=\"u>v\">ln</a><td x")
    assert [(tree.tags[e], t, n) for e, t, n in tree.runs] == [
        ("p", "one two", 0), ("p", "a < b & c", 0), ("li", "i", 0), ("li", "j", 0), ("html", "tail ln", 2),
    ]
    assert tree.words[tree.runs[1][0]] == ("x", "y")
    assert parse("3 < 4 <b").runs == [(0, "3 < 4", 0)]


@pytest.mark.parametrize("inside, text", [
    ('<p>Ahead of it. <svg class="i"/>Close behind it.</p>', "Ahead of it. Close behind it."),
    ("<p>Ahead of it. <svg><path d='M0'/><circle r=1 /><text>Label here.</text></svg>Close behind it.</p>", "Ahead of it. Label here. Close behind it."),
    ("<p>Ahead of it. <svg><title/><style/><title>Icon</svg>Close behind it.</p>", "Ahead of it. Close behind it."),
    ("<p>Ahead of it. <object data=x>Close behind it.</p>", "Ahead of it. Close behind it."),
    ("<template><p>Ahead of it.</p><p>Close behind it.</p>", "Ahead of it. Close behind it."),
    ("<p>Ahead of it. <noscript>Shown without scripts.</noscript> Close behind it.</p>", "Ahead of it. Shown without scripts. Close behind it."),
    ("<p>So <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><mspace/></math> holds here.</p>", "So x = 1 2 holds here."),
    ("<p>So it is, <math/> as said.</p>", "So it is, as said."),
    ("<p>Ahead of it.</p><xmp>a <b>bold</b> &amp; word.</xmp><p>Close behind it.</p>", "Ahead of it. a <b>bold</b> &amp; word. Close behind it."),
    ("<noframes><p>Ahead of it.</p></noframes><noembed>Close behind it.</noembed>", "Ahead of it. Close behind it."),
    ("<script>var a = '<p>';</script><style>p {}</style><iframe>no</iframe><textarea>no</textarea><title>no</title><p>Ahead of it.</p>", "Ahead of it."),
])
def test_nothing_else_is_dropped(model, inside, text):
    page = f"<body><article><h1>Title of it</h1><p>First part, with words.</p>{inside}<p>Second part of it.</p></article><footer>&copy; me</footer></body>"
    runs = " ".join(t for _, t, _ in parse(page).runs)
    assert runs == f"Title of it First part, with words. {text} Second part of it. © me"
    assert model.extract(page) == f"Title of it First part, with words. {text} Second part of it."
    assert " ".join(t for _, t, _ in parse(f"<article>{inside}").runs) == text


def test_what_is_left_open_keeps_the_rest():
    for name in "svg object template noscript math xmp".split():
        runs = parse(f"<article><p>Ahead.</p><{name}>In it.<p>Behind.</p></article>tail").runs
        assert "Behind." in " ".join(t for _, t, _ in runs) and "tail" in runs[-1][1]


def test_marginals_are_exact(model):
    tree = parse("<div class=page><p>Some words here. More.</p><div class=ad>Buy it</div><a href=x>link</a></div>")
    got = model.content(tree)
    parents = tree.parents + [r[0] for r in tree.runs]
    seen = hx.observations(tree)
    n = len(tree.tags)
    sums = np.zeros((len(parents), 3))
    for states in itertools.product(range(3), repeat=len(parents)):
        if hx.FRAME in states[n:]:
            continue
        log = sum(model.step[states[p], s] for s, p in zip(states, parents, strict=True) if p >= 0)
        log += sum(model.seen[o][s] for s, names in zip(states, seen, strict=True) for o in names if o in model.seen)
        sums[range(len(parents)), states] += np.exp(log)
    want = (sums / sums.sum(axis=1, keepdims=True))[n:, hx.CONTENT]
    assert np.allclose(got, want, atol=1e-6)


def article_text(source):
    """The text of the test pages' only article element, by its tags."""
    body = source[source.find("<article>") + 9 :].split("</article>")[0]
    blocks = re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", b)).split()) for b in blocks]
    return " ".join(t for t in texts if t)


def test_table(spark, model):
    pages = table(spark, SF, "pages")
    rows = {r.page_id: r for r in hx.main_text(pages, model).collect()}
    wanted = {r.page_id: article_text(r.html) for r in pages.collect() if "<article>" in r.html}
    right = sum(rows[k].text == w for k, w in wanted.items())
    assert right >= 0.99 * len(wanted) and len(rows) == pages.count()
    assert all(r.n_chars == len(r.text) for r in rows.values())


def test_labelled_pages_held_out(model):
    right = total = 0
    for k in range(200):
        tree = parse(html_pages.Maker(50_000_000 + k).page(), html_pages.MARK)
        states = []
        for i, mark in enumerate(tree.marks):
            states.append({"c": True, "o": False}.get(mark, states[tree.parents[i]] if i else False))
        for (e, _, _), p in zip(tree.runs, model.content(tree), strict=True):
            right += states[e] == (p >= 0.5)
            total += 1
    assert right >= 0.96 * total


def test_regions_go(model):
    page = (
        "<body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class='cookie-notice'><p>We use cookies.</p></div>"
        "<main><article><h1>Title of it</h1><p>First part, with words.</p><div class=ad>Buy now</div><p>Second part of it.</p></article></main>"
        "<aside><h3>Related</h3><ul><li><a href=/a>Other page</a></li></ul></aside><section id=comments><h3>Replies</h3>"
        "<div class=comment><p>I liked it.</p></div></section><form><p>Sign up</p><input></form><footer>&copy; me</footer></body>"
    )
    assert model.extract(page) == "Title of it First part, with words. Second part of it."


def test_edge_rows(spark, model):
    long_page = "<article>" + "<p>Word and word again.</p>" * 30_000 + "</article>"
    deep = "<div>" * 3000 + "<p>Deep text is here. Yes.</p>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<nav><a href=x>m</a></nav>", "x"), (3, "u", long_page, "x"), (3, "u", long_page, "x"), (4, "u", deep, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = hx.main_text(frame, model).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got if r.page_id != 4) == [(0, 0), (1, 0), (2, 0), (3, 30_000 * 21 - 1), (3, 30_000 * 21 - 1)]
    assert hx.main_text(frame.limit(0), model).collect() == []
