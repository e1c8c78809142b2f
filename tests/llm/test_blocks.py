import html
import re
import time

import duckdb
import numpy as np
import pytest

from tidewatch.llm import blocks as b

SF = "/root/testdata/sf0.01"


def test_parser():
    page = (
        "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t='</p>';</script></head>"
        "<body><!-- <p>no</p> --><nav class='top Menu'><ul><li><a href='/x>y'>one</a><li>two</ul></nav>"
        "<p>a <b>b\n  c</b>&nbsp;d<br>e<p>f<i>g</i></body> tail < 3"
    )
    got = [(x.path, x.text) for x in b.parse(page)]
    assert got == [
        (("html", "head", "title"), "T & t"),
        (("html", "body", "nav", ".top", ".menu", "ul", "li"), "one"),
        (("html", "body", "nav", ".top", ".menu", "ul", "li"), "two"),
        (("html", "body", "p"), "a b c d"),
        (("html", "body", "p"), "e"),
        (("html", "body", "p"), "fg"),
        (("html",), "tail < 3"),
    ]
    assert b.parse("") == [] and b.parse("<script>x") == [] and [x.text for x in b.parse("plain")] == ["plain"]
    assert len(b.parse("<div>" * 3000 + "x")) == 1


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        *((f"<{n}-icon name='x'></{n}-icon>", "one two three") for n in ("svg", "style", "template", "object", "script", "math")),
        ("<svg width='1'/>", "one two three"), ("<math />", "one two three"), ("<svg>", "one two three"),
        ("<template>", "one two three"), ("<svg><title>no</title></svg>", "one two three"), ("<style>no</style>", "one two three"),
        ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "one x=2 two three"),
        ("<object data='d'>instead</object>", "one instead two three"),
        ("<noscript>instead<style>no</style></noscript>", "one instead two three"),
        ("<script>no", "one"), ("<style >no", "one"), ("<template><p>no</p></template>", "one two three"),
    ],
)
def test_only_dropped_elements_are_dropped(inner, want):
    blocks = b.parse(f"<article><p>one {inner} two</p><p>three</p></article>")
    assert " ".join(x.text for x in blocks) == want and all(x.path[0] == "article" for x in blocks)


LONG = {
    "open quotes": ('<a href="x ', 90_000), "open raw tags": ("<script x ", 100_000), "open tags": ("<a ", 340_000),
    "open names": ("<a", 500_000), "open comments": ("<!--", 250_000), "open drawings": ("<svg>", 200_000),
    "nested": ("<div>", 200_000), "nested with text": ("<div>x", 160_000), "signs": ("<", 1_000_000), "ends": ("</", 500_000),
    "ends of nothing": ("<div><i></b></x>", 60_000), "both quotes": ("<a '\" ", 150_000), "inline": ("<i></b>", 150_000),
}


@pytest.mark.parametrize("kind", LONG)
def test_broken_and_deep_pages_take_linear_time(kind):
    part, times = LONG[kind]
    took = []
    for n in (times // 4, times):
        for page in (part * n, part * n + "\" >"):
            began = time.process_time()
            blocks = b.parse(f"<main><p>begin {page}")
            took.append(time.process_time() - began)
            assert blocks[0].text.startswith("begin")
    # Two seconds a megabyte, on a machine twice as slow as it is alone.
    assert max(took) < 6 and max(took[2:]) < 12 * max(0.05, max(took[:2]))


def test_unfinished_tags_are_text():
    def texts(page):
        return [x.text for x in b.parse(page)]

    assert texts('<p>a <b c="d>e<p>f') == ['a <b c="d>e', "f"]
    assert texts("<p>1 <2 and 3> 4 <<i>5</i>") == ["1 <2 and 3> 4 <5"]
    assert texts("<p>a</p <p>b") == ["a", "b"]
    assert texts('<p><i"b c>x') == ["x"] and texts("<p>x<") == ["x<"] and texts("<p>x</") == ["x</"]
    assert texts("<template><style>a</template>b</style>c") == ["bc"]
    assert texts("<svg><!-- </svg>a") == ["a"]


def test_deep_paths():
    deep = b.parse("<article>" + "<div class='ad'>" * 3 + "x</div></div></div>y")
    assert [x.path for x in deep] == [("article", *("div", ".ad") * 3), ("article",)]
    assert [b.by_markup(x.steps) for x in deep] == [False, True] and deep[0].steps.size == 7
    same = b.Block(deep[0].path, "x", 0.0)
    assert (b.Features().of([same]) == b.Features().of(deep[:1])).all()


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    net = b.Lstm(5, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = r.normal(size=(4, 6, 5)), r.random((4, 6)) > 0.5
    mask = np.arange(6) < np.array([6, 4, 1, 3])[:, None]
    grads = net.gradients(x, mask, y)[1]
    for k, g in grads.items():
        for at in [tuple(r.integers(s) for s in net.p[k].shape) for _ in range(4)]:
            old, step = net.p[k][at], 1e-3
            net.p[k][at] = old + step
            up = net.gradients(x, mask, y)[0]
            net.p[k][at] = old - step
            down = net.gradients(x, mask, y)[0]
            net.p[k][at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 2e-3, k


def expected(page):
    """The article's text, cut out by its tags."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|br)>", inner)
    clean = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts)
    return " ".join(c for c in clean if c)


@pytest.fixture(scope="module")
def network(spark):
    return b.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_all_pages(spark, network):
    rows = duckdb.connect().execute(f"select page_id, url, html from read_parquet('{SF}/pages.parquet')").fetchall()
    got = {r.page_id: r for r in b.main_text(spark.read.parquet(f"{SF}/pages.parquet"), network).collect()}
    right = sum(got[i].text == expected(h) and got[i].url == u for i, u, h in rows)
    assert right >= 0.99 * len(rows) and all(r.n_chars == len(r.text) for r in got.values())


def test_other_markup(network):
    """A page of a template that no training page has."""
    words = "Erh thon ander ing tion, the was of and thing hes tion ander. "
    page = (
        "<html><body><header><div class='menu'><a href='/'>Home</a> <a href='/b'>About</a></div></header>"
        "<div class='cookie-notice'><p>Wir and cookies notice tion.</p></div><main><h1>Title ander</h1>"
        + "".join(f"<p>{words * 3}{i}</p>" for i in range(6))
        + "<form><label>Name tion</label></form></main><aside class='sidebar'><p>Other ander stories.</p></aside>"
        f"<section class='comments'><div class='comment'><p>{words}</p></div></section>"
        "<footer>Copyright ander</footer></body></html>"
    )
    text = b.Extractor(network).texts([page])[0]
    assert text.startswith("Title ander Erh thon") and text.count("Erh") == 18
    for no in ("Home", "cookies", "Name", "stories", "Copyright"):
        assert no not in text


def test_odd_rows(spark, network):
    long = "<article>" + "<p>Word and more words, of the tion.</p>" * 3000 + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "v", long, None), (None, "v", long, None), (3, "w", "<nav>a</nav>", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = b.main_text(df, network).collect()
    assert [r.page_id for r in got if not r.text] == [1, 2, 3] and len(got) == 5
    assert {r.text.count("Word") for r in got if r.text} == {3000}
    assert b.main_text(df.limit(0), network).count() == 0
    assert b.fit(df.limit(0)) is None
    assert [r.text for r in b.main_text(df.where("page_id = 3"), None).collect()] == [""]
