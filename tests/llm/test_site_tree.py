"""Main text: stated pages, broken markup, the merged tree against direct entropies."""

import html
import math
import random
import re
import time
from collections import Counter

import pytest

from admitflow.llm import queries, site_tree

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>x";</script></head><body>
<nav><ul><li><a href="/a">Home</a></ul></nav><!-- ad --><div class="ad">Buy</div>%s
<form>Name <input></form><div id="cookie-notice">We use cookies</div><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(
    "body,want",
    [
        ("<article><h1>Head</h1><p>One <b>bold</b>ly\n\t two<br>three<p>Four &amp; &lt;five&gt; &eacute;&nbsp;x</article>", "Head\n\nOne boldly two three\n\nFour & <five> é x"),
        ("<main><p>a</p><aside>side</aside><div class='comments'><article>said</article></div><p>b</main>", "a\n\nb"),
        ("<article><header><h1>Own</h1></header><ul><li>x<li>y</ul><div class='share'>s</div></article>", "Own\n\nx\n\ny"),
        ("<article><p>cut off &am", "cut off &am We use cookies"[:11]),
        ("<div class='menu'><a>m</a><article><p>in</p></article>", "in"),
        ("<article><p hidden>h</p><p style='display:none'>d</p><p>seen</p></article>", "seen"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n\n2\n\n3"),
        ("<article><p title='a > b' class=\"x>y\">q</p></article>", "q"),
        ("<div class='post'><p>plain page without an article</p></div>", "plain page without an article"),
        ("<article></article>", ""),
        ("<p>before</p><svg width=1 /><p>after</p>", "before\n\nafter"),
        ("<p>a</p><svg><text>drawn</text></svg><p>b</p><svg><p>c</p>", "a\n\nb\n\nc"),
        ("<article>one<object data=1/><p>after</p></article>", "one\n\nafter"),
        ("<article><p>e = <math><mi>m</mi><mi>c</mi></math> ok</p></article>", "e = mc ok"),
        ("<article class='post has-comments'><p>hello</p></article>", "hello"),
        ("<article><section id='share-prices'><p>rise</p></section><div class='social-share-buttons'>x</div></article>", "rise"),
        ("<article><p>a</p><script src='x' /><p>b</p></article>", "a\n\nb"),
    ],
)
def test_pages(body, want):
    page = PAGE % body if "cut off" not in body else (PAGE % body).split("</article>")[0].split("&am")[0] + "&am"
    assert site_tree.main_text(page) == want


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "&", "<a href='", "</p></p></div>", "<" * 3000, "<a '" * 3000, "<div>" * 3000 + "x", "<!--", "<script>x"])
def test_broken_pages(page):
    assert isinstance(site_tree.main_text(page), str)


@pytest.mark.parametrize("body", ["single comments-open", "has-sidebar", "no-nav sidebar"])
def test_classes_of_the_body_say_nothing_of_its_text(body):
    assert site_tree.main_text(f"<body class='{body}'><article><p>hello") == "hello"
    assert site_tree.main_text(f"<body class='{body}'><p>hello") == "hello"
    assert site_tree.main_text(f"<body class='{body}'><div class='site-footer'>no</div><p>hello<div id=sidebar-left>no") == "hello"


def test_deep_pages_take_time_in_proportion():
    took = []
    for n in (4_000, 16_000):
        page, begin = "<b>" * n + "</i>" * n + "x", time.process_time()
        assert site_tree.main_text(page) == "x"
        took.append(time.process_time() - begin)
    assert took[1] < 10 * took[0] + 0.2


def plain(page):
    found = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    parts = (html.unescape(re.sub(r"<[^>]*(>|\Z)", "", p)) for p in re.split(r"</?(?:p|h1)>", found[1]))
    return "\n\n".join(p for p in (" ".join(p.split()) for p in parts) if p)


def test_whole_table(spark, folder):
    rows = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = queries.QUERIES["op3_site_tree"](spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (rows[r.page_id].url, plain(rows[r.page_id].html), len(r.text))


def site(n, host, rng):
    words = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    for i in range(n):
        first, second = words(30), words(40)
        page = f"<body><div class=top>Welcome to our site</div><div class=text><p>{first}</p><p>{second}</p></div><div class=low>All rights belong to us</div></body>"
        yield (host, page, f"{first}\n\n{second}")


@pytest.fixture(scope="module")
def soup(spark):
    rng = random.Random(9)
    rows = [*site(40, "a.example", rng), *site(30, "b.example", rng), *site(2, "rare.example", rng)]
    pages = [(i, f"http://{h}:80/p{i}", p, "x", 1) for i, (h, p, _) in enumerate(rows)]
    pages += [(900, None, None, "x", 1), (901, "::", "", "x", 1), (901, "::", "", "x", 1)]
    return spark.createDataFrame(pages, "page_id long, url string, html string, text string, host int"), rows


def test_repeated_branches_go(soup):
    got = {r.page_id: r.text for r in site_tree.extract(soup[0]).collect()}
    for i, (host, _, want) in enumerate(soup[1]):
        everything = f"Welcome to our site\n\n{want}\n\nAll rights belong to us"
        assert got[i] == (everything if host == "rare.example" else want)
    assert got[900] == got[901] == "" and site_tree.extract(soup[0]).count() == len(soup[1]) + 3


def test_importance_is_the_entropy(soup):
    pages = [site_tree.Page(p) for h, p, _ in soup[1] if h == "a.example"]
    m = len(pages)
    got = {r.path: r for r in site_tree.importance(site_tree.site_counts(soup[0])).where("host = 'a.example'").collect()}
    assert got
    for path, r in got.items():
        styles = Counter(dict(p.styles)[path] for p in pages)
        node = -sum(n / m * math.log(n / m, m) for n in styles.values())
        texts = Counter(t for p in pages for t in {b.text for b in p.blocks if b.path == path and b.role == site_tree.NEUTRAL})
        content = sum(n * (1 - math.log(n, m)) for n in texts.values()) / sum(texts.values()) if texts else 1.0
        own = site_tree.GAMMA ** len(styles)
        assert r.pages == m and r.importance == pytest.approx((1 - own) * node + own * content, abs=1e-9)


def test_empty_table(soup):
    assert site_tree.extract(soup[0].limit(0)).count() == 0


def nested(n, rng):
    for i in range(n):
        item = lambda k: f"<div class=row><p>{k}</p></div>"
        words = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
        fixed = "".join(item(k) for k in ("Imprint", "Terms", "Contact us"))
        yield (i, "http://n.example/", f"<body><div class=outer><div class=box>{fixed}</div></div><article><p>{words}</p></article><nav><p>{rng.random()}</p></nav></body>")


def test_branches_are_weighed_from_the_leaves_up(spark):
    pages = spark.createDataFrame(list(nested(30, random.Random(3))), "page_id long, url string, html string")
    read = [site_tree.Page(h) for _, _, h in nested(30, random.Random(3))]
    counts = site_tree.site_counts(pages)
    own = {r.path: r for r in site_tree.importance(counts).collect()}
    got = {r.path: r for r in site_tree.branches(counts).collect()}

    def direct(path):
        page, r = read[0], own[path]
        below = [p for p in page.below[path] if p in page.shown]
        parts = [direct(p) for p in below] + [r.content] * any(b.path == path for b in page.blocks)
        return (1 - site_tree.GAMMA**r.styles) * r.node + site_tree.GAMMA**r.styles * sum(parts) / len(parts)

    assert set(got) == read[0].shown
    for path in got:
        if path:
            assert got[path].composite == pytest.approx(direct(path), abs=1e-4)
    low = {r.path: r.entropy for r in site_tree.unimportant(site_tree.branches(counts)).collect()}
    texts = {b.path: b for p in read for b in p.blocks}
    assert {texts[p].role for p in low if p in texts} == {site_tree.NEUTRAL, site_tree.NOISE} and set(low.values()) == {True, False}
    body = site_tree.path_of(0, "body")
    assert low[site_tree.path_of(body, "div.outer")] and body not in low  # a whole branch, not only the blocks in it
    assert [r.text for r in site_tree.extract(pages).orderBy("page_id").collect()] == [p.blocks[3].text for p in read]


def test_the_tree_decides(spark, folder):
    """Without the paths its site's tree removes, a page keeps its menus."""
    page = PAGE % "<p>plain page without an article</p>"
    assert site_tree.main_text(page, frozenset()) != site_tree.main_text(page) == "plain page without an article"
    rows = spark.read.parquet(f"{folder}/pages.parquet")
    low = site_tree.unimportant(site_tree.branches(site_tree.site_counts(rows))).collect()
    print("paths removed by entropy and by role:", sum(r.entropy for r in low), sum(not r.entropy for r in low))
    first = rows.orderBy("page_id").first()
    assert site_tree.main_text(first.html, frozenset(r.path for r in low if r.host == site_tree.host_of(first.url))) == plain(first.html)
    assert low
