import math
from collections import Counter, defaultdict

import pytest

from vigilark.llm import pages


def texts(source, low=()):
    return pages.cut(pages.parse(source), set(low))


def test_articles_of_odd_pages():
    page = ('<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>'
            '<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>'
            '<article><h1>Head &amp; line</h1><p><b>One  two\n three<br><p>Four &lt;b&gt; &#233; &am</p>'
            '<div class="comments"><p>Reader</p></div><form>Mail <input></form><aside>Side</aside>'
            '<ul><li>a<li>b</ul>tail</article><footer>&copy; foot')
    assert texts(page) == ["Head & line", "One two three", "Four <b> é &am", "a", "b", "tail"]
    assert texts("") == [] and texts("<p>") == [] and texts("plain  text") == ["plain text"]
    assert texts("<body><header><h1>Site</h1></header><div>x<span>y</span> z</div><p hidden>h</p></body>") == ["xy z"]
    assert texts("<main><header><h1>Title</h1></header><p>Body</p></main><p>Out</p>") == ["Title", "Body"]
    assert texts('<div role="navigation">n</div><div id="site-footer">f</div><p title="a>b">k</p>') == ["k"]
    assert texts("<article>a<script>x</article>") == ["a"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert texts("<p>" + "x " * 200_000 + "</p>") == [" ".join(["x"] * 200_000)]


def test_a_branch_with_most_of_the_text_is_never_cut():
    page = pages.parse("<div><p>short</p></div><section>much longer text than that</section>")
    keys = {b.path[-1] for b in page.blocks} | {b.path[0] for b in page.blocks}
    assert pages.cut(page, keys) == ["much longer text than that"]


@pytest.fixture(scope="module")
def site(spark):
    rows = []
    for i in range(60):
        rows.append((i, f"http://Site.example:80/{i}?q=1", f"<body><div class=x><p>All rights of site</p></div><div class=y><p>Story number {i} "
                     f"tells {i * 7} things</p><p>and more {i}</p></div></body>", "x"))
    rows += [(100, None, None, "x"), (101, "", "", "x"), (102, "odd", "<p>alone</p>", "x"), (None, "http://b.example/", "<p>b</p>", "x"),
             (3, rows[3][1], rows[3][2], "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


def test_what_all_pages_of_a_site_say_goes(site):
    got = pages.main_texts(site).collect()
    assert len(got) == 65
    for r in got:
        if r.page_id is not None and r.page_id < 60:
            assert r.text == f"Story number {r.page_id} tells {r.page_id * 7} things\nand more {r.page_id}"
    assert {r.page_id: r.text for r in got if r.page_id is None or r.page_id >= 100} == {100: "", 101: "", 102: "alone", None: "b"}
    assert pages.main_texts(site.limit(0)).collect() == []


def test_importance_equals_plain_entropies(site):
    rows = site.select(pages.host_of("url").alias("host"), "html")
    got = {(r.host, r.node): r.importance for r in pages.importance(rows).collect()}
    by_node = defaultdict(list)
    for r in rows.collect():
        for node, style, feature in pages.features(pages.parse(r.html or "")):
            by_node[r.host, node].append((style, feature))
    assert set(got) == set(by_node)
    for key, seen in by_node.items():
        layouts = Counter(f for s, f in seen if s)
        said = Counter(f for s, f in seen if not s)
        m = sum(layouts.values())
        if m == 1:
            assert got[key] == 1
            continue
        presentation = -sum(n / m * math.log(n / m, m) for n in layouts.values())
        content = 1 - sum(n * math.log(n, m) for n in said.values()) / sum(said.values())
        weight = 0.9 ** len(layouts)
        assert abs(got[key] - ((1 - weight) * presentation + weight * content)) < 1e-9


def test_copies_and_repeats_leave_a_marked_article_whole(spark):
    part = "<article><h1>Title</h1><p>{}</p><ul><li>one</li></ul></article>"
    long = "The story that all of these pages tell at some length."
    rows = [(i, "http://copies.example/", "<body><div class=x><p>Foot</p></div>" + part.format(long) + "</body>") for i in range(40)]
    # Without a mark: 38 copies beside two other pages.
    rows += [(100 + i, "http://plain.example/", f"<body><div class=t><p>Head</p></div><div class=y><p>{long}</p></div>"
              f"<div class=z><p>Tail {max(i, 37)}</p></div></body>") for i in range(40)]
    # Different pages whose articles share a heading.
    rows += [(200 + i, "http://heads.example/", "<body>" + part.format(f"{long} {i}") + "</body>") for i in range(40)]
    got = {r.page_id: r.text for r in pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(40)} == {f"Title\n{long}\none"}
    assert all(got[100 + i] == f"Head\n{long}\nTail {max(i, 37)}" for i in range(40))
    assert all(got[200 + i] == f"Title\n{long} {i}\none" for i in range(40))


def test_few_pages_cut_less(spark):
    def kept(n):
        rows = [(i, "http://s.example/", f"<body><div class=x><p>Foot</p></div><div class=y><p>A story of its own, number {i}</p></div></body>")
                for i in range(n)]
        found = pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        return all(r.text.startswith("Foot") for r in found)

    assert kept(19) and not kept(21)


def test_names_do_not_drop_the_story():
    story = "<h1>Title</h1><p>A story that is long enough to be most of what this page has to say.</p>"
    want = ["Title", "A story that is long enough to be most of what this page has to say."]
    for page in ('<div class="layout has-sidebar"><article>{}</article></div>', '<div class="elementor-widget-container">{}</div>',
                 '<article class="post category-menu">{}</article>', '<div id="search-results-page">{}</div>',
                 '<div class="widget"><article>{}</article></div>', '<div class="widget">{}</div><p>Small</p><div class="ad">Buy</div>',
                 '<article><div class="widget">{}</div><div class="share-buttons">Share</div></article>'):
        got = texts(f"<body>{page.format(story)}</body>")
        assert [t for t in got if t != "Small"] == want, page
    assert texts(f"<body><div class=x>{story}</div><article><p>Teaser</p></article><div class=z>Other</div></body>") == [*want, "Teaser"]
    assert texts(f'<body><article>{story}</article><div class="related-posts"><article>Next</article></div>'
                 '<div class="main-nav">Menu</div><div class="cookie-banner">Cookies</div></body>') == want
