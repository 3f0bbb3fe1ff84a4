"""Extraction on page shapes that the shared pages do not have."""

from __future__ import annotations

import random
import time

import pytest

from marketweave.llm import html

KEPT = [
    "<body><select><option>A<option>B</select><article><p>whole text</article>",
    "<body><div><select><option>A<option>B</div><article><p>whole text</article>",
    "<body><button>Menu<article><p>whole text</article><button>x</button>",
    "<body><div><canvas>c</div><article><p>whole text</article>",
    "<body><object>o<p>whole text",
    "<body><iframe src=x><p>whole text",
    "<head><title>t</title><p>whole text",
    "<div class='has-sidebar'><article><p>whole text</article></div>",
    "<div class='page-with-header'><p>whole text</div>",
    "<div id='social-policy'><p>whole text</div>",
    "<div class='sidebar'><article><p>whole text</article></div>",
    "<form><article><p>whole text</article></form>",
    "<form><header>h</header><p>whole text</form>",
    "<p>whole <a href=x>text</a>",
    "<main><p>whole text</main><aside><article>teaser</article></aside>",
    "<article>whole text<div class=comments><article>reply</article></div></article>",
    "<template><div>a</div><template>b</template><article>c</article></template><p>whole text",
]


@pytest.fixture(scope="module")
def texts(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.org/", page) for i, page in enumerate(KEPT)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html.extract_text(pages).collect()}


@pytest.mark.parametrize("at", range(len(KEPT)))
def test_whole_text_is_kept(texts, at):
    assert texts[at] == "whole text", KEPT[at]


def test_constant_text_of_an_article_is_kept(spark):
    article = "<body><p>top</p><article><h1>Head</h1><p>Shared line</p><p>own {}</p><p>Shared end</p></article><p>bottom</p>"
    bare = "<body><div>top</div><div><p>own {0}</p><p>Shared line</p><p>more {0}</p></div><div>bottom</div>"
    rows = [(i, "http://a.org/", article.format(i)) for i in range(6)] + [(10 + i, "http://b.org/", bare.format(i)) for i in range(6)]
    got = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"Head\n\nShared line\n\nown {i}\n\nShared end"
        assert got[10 + i] == f"own {i}\n\nShared line\n\nmore {i}"


def test_varying_pages_of_one_host_and_pages_twice(spark):
    """Template text out of its order is text; a page that is there twice changes no class."""
    bare = "<body><div>top</div><div><p>own {0}</p></div><div>bottom</div><div>end</div>"
    moved = "<body><div>end</div><div><p>own m</p></div><div>top</div><div>bottom</div>"
    rows = [(i, "http://b.org/", bare.format(i)) for i in range(12)] * 2 + [(99, "http://b.org/", moved)]
    got = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"own {i}" for i in range(12)) and got[99] == "end\n\nown m"


def test_nested_elements_take_no_longer_each():
    began = time.time()
    assert len(html.blocks_of("<p>x</b><div>y" * 8_000)) == 16_000
    assert len(html.blocks_of("<svg>" * 3_000 + "<p>z</p></a></div>" * 3_000)) <= 3_000
    assert len(html.blocks_of("<form>" * 4_000 + "<header>h" * 4_000 + "</section>" * 4_000)) == 4_000
    assert time.time() - began < 1.5


def texts_of(spark, pages):
    rows = [(i, f"http://{host}/", page) for i, (host, page) in enumerate(pages)]
    return {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_near_equal_pages_keep_their_text(spark):
    page = "<body><div class=top>Site</div><div><h1>Head</h1><p>The same body on all of them.</p><p>copy of day {}</p></div><div>Imprint</div>"
    got = texts_of(spark, [("a.org", page.format(i)) for i in range(10)])
    assert all(got[i] == f"Head\n\nThe same body on all of them.\n\ncopy of day {i}" for i in range(10))


NAMED = [
    ("<article><p>t<div class='comment-list'><p>c</div><div class='user-comments'>c</div><section class='related-posts'><p>r</section><div id='adSlot'>a</div></article>", "t"),
    ("<article><p class=cookie>About cookies</p><h2 class=menu>Menu of the day</h2><p class=ad>buy</p><p class='comment'>c</p><header class=page-header><h1>h</h1></header></article>", "About cookies\n\nMenu of the day\n\nh"),
    ("<div class='site-header'>h</div><nav>n</nav><div class='main-menu'>m</div><div id='leftSidebar2'>s</div><p>body<div class='site-footer'>f</div>", "body"),
    ("<div class='content-sidebar-wrap'><p>a</div><div class='menu-prices-explained'><p>b</div><div class='no-sidebar'><p>c</div><div class='adfree headerless'>d</div>", "a\n\nb\n\nc\n\nd"),
]


def test_names_of_several_parts(spark):
    got = texts_of(spark, [(f"h{i}.org", page) for i, (page, _) in enumerate(NAMED)])
    assert [got[i] for i in range(len(NAMED))] == [want for _, want in NAMED]


def plain_template(pages):
    """Texts of one host by whole occurrence vectors: the texts, with their mean places, of classes large enough on nearly all pages."""
    found = [html.blocks_of(p) for p in pages]
    tokens = {(b.path, t) for blocks in found for b in blocks for t in (b.text, "")}
    vector = {t: tuple(sum((b.path, b.text) == t or (b.path, "") == t for b in blocks) for blocks in found) for t in tokens}
    classes: dict = {}
    for t, v in vector.items():
        if sum(map(bool, v)) >= 0.9 * len(pages):
            classes.setdefault(v, []).append(t)
    kept = [t for ts in classes.values() if len(ts) >= 2 for t in ts if t[1]]
    place = {t: sum(next((i for i, b in enumerate(blocks) if (b.path, b.text) == t), 0) for blocks in found) / sum(map(bool, vector[t])) for t in kept}
    return {html._print(*t): place[t] for t in kept}


def test_templates_of_bare_pages_by_whole_vectors(spark):
    """Pages without an article, with lines that come and go, repeat and change their order: the template, and what it leaves of each page."""
    draw = random.Random(5)
    pages = []
    for i in range(24):
        lines = [f"<div>const {k}</div>" for k in range(4)] + [f"<div><p>own {i} {draw.random()}</p><p>shared</p></div>"]
        lines += ["<div>often</div>"] * (i != 7) + ["<p>twice</p>"] * 2 + [f"<section><p>odd {i % 3}</p></section>"]
        if i % 11 == 10:
            draw.shuffle(lines)
        pages.append("<body>" + "".join(lines))
    frame = spark.createDataFrame([(i, "http://x.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    want = plain_template(pages)
    got = html.templates(frame).first().template
    assert set(got) == set(want) and [want[t] for t in got] == sorted(want.values()) and len(got) >= 6
    rank = {t: i for i, t in enumerate(got)}
    texts = {r.page_id: r.text for r in html.extract_text(frame).collect()}
    assert texts == {i: "\n\n".join(html._article(html.blocks_of(p), rank)) for i, p in enumerate(pages)}
    assert all(f"own {i}" in texts[i] and "shared" in texts[i] and f"odd {i % 3}" in texts[i] for i in range(24)) and all("const" not in texts[i] for i in range(10))
