"""Pages and listings with nested elements, several links in a card and per-source selectors."""

import datetime as dt
import random

import pytest

from broadsheet.sources import elements as el
from broadsheet.sources import pages

D = dt.date


def read(spark, *given, **options):
    rows = spark.createDataFrame([(i, url, html) for i, (url, html) in enumerate(given)], "n int, url string, html string")
    return pages.read_pages(rows, ["n"], **options).orderBy("n").collect()


def test_intervals_nest(spark):
    rng = random.Random(1)

    def grow(depth):
        tag = rng.choice(["div", "p", "section", "b"])
        inner = [grow(depth - 1) for _ in range(rng.randrange(4))] if depth else []
        return tag, inner, f"t{rng.randrange(1000)}"

    def markup(node):
        tag, inner, own = node
        return f"<{tag} class='k {tag}x'>{own}<br/>" + "".join(markup(n) for n in inner) + f" {own}&amp; </{tag}>"

    def texts(node):
        return [node[2], *(t for n in node[1] for t in texts(n)), node[2] + "&"]

    def flat(node):
        return [node, *(x for n in node[1] for x in flat(n))]

    trees = [grow(4) for _ in range(20)]
    rows = spark.createDataFrame([(i, markup(t)) for i, t in enumerate(trees)], "n int, html string")
    got = {r["n"]: r["page"] for r in rows.select("n", el.tree("html").alias("page")).collect()}
    for i, t in enumerate(trees):
        nodes = [n for n in got[i]["nodes"] if n["tag"] not in ("", "br")]
        assert [n["tag"] for n in nodes] == [x[0] for x in flat(t)]
        for n, x in zip(nodes, flat(t), strict=True):
            assert [s["text"] for s in got[i]["texts"] if n["first"] < s["at"] <= n["last"]] == texts(x)
            assert n["classes"] == ["k", x[0] + "x"]


def test_broken_markup(spark):
    html = "</i><div><b>one<p>two<!-- no --></div>three<script>if (a<b) { '</div>' }</script><template>x</template><img src=a><unclosed>four"
    rows = spark.createDataFrame([(html,), (None,), ("",), ("a < b & c",)], "html string")
    got = [r["page"] for r in rows.select(el.tree("html").alias("page")).collect()]
    assert [t["text"] for t in got[0]["texts"]] == ["one", "two", "three", "four"]
    ends = {n["tag"]: (n["first"], n["last"]) for n in got[0]["nodes"]}
    assert ends["div"][0] < ends["b"][0] < ends["p"][0] and ends["div"][1] == ends["b"][1] == ends["p"][1] < ends["unclosed"][0]
    assert [len(p["nodes"]) for p in got] == [len(got[0]["nodes"]), 1, 1, 1] and got[3]["texts"][0]["text"] == "a < b & c"


def test_bodies_are_whole(spark):
    nested = "<div class='x article-content'><div>first<div>second</div></div><aside>no</aside><div>third <b>bold</b></div></div><div>after</div>"
    article = "<nav>n</nav><div class='TRS_Editor'>editor</div><article>later</article>"
    hidden = "<header><article>in the header</article></header><main>here<footer>f</footer></main>"
    got = read(spark, ("https://a.example/", nested), ("https://a.example/", article), ("https://a.example/", hidden), ("https://a.example/", "<p>来源：某报 x</p>"), ("https://a.example/", None))
    assert [r.body for r in got] == ["first\nsecond\nthird\nbold", "editor", "here", "来源：某报 x", ""]
    assert got[3].origin == "某报"
    assert read(spark, ("https://a.example/", nested), limit=5)[0].body == "first"


def test_host_date_elements(spark):
    two = "<time datetime='2026-01-02'>x</time><div class='detail-info'><span>2026年</span><p>作者</p><i>2026-03-04 10:00</i></div>"
    source = "<div class='time-source'><div class='item'>2026-05-06</div></div>"
    release = "<div class='item'>2026-05-06</div><span class='releaseTime'>2026/07/08</span>"
    got = read(
        spark, ("https://www.stcn.com/a", two), ("https://other.example/a", two), ("https://finance.eastmoney.com/b", source), ("https://other.example/b", source),
        ("https://www.chinaventure.com.cn/c", release), ("https://finance.eastmoney.com/c", release),
    )
    assert [r.published for r in got] == [D(2026, 3, 4), D(2026, 1, 2), D(2026, 5, 6), None, D(2026, 7, 8), None]
    assert [r.date_evidence for r in got] == ["article_visible"] * 3 + ["hint_unparsed", "article_visible", "hint_unparsed"]


def test_stated_days_and_descriptions(spark):
    meta = "<meta name='parsely-pub-date' content='2026-09-17T08:30:00+08:00'><meta property='og:description' content='a &lt;b&gt;bold&lt;/b&gt; word'>"
    graph = '<script type="application/ld+json">{"@graph":[{"@type":["ScholarlyArticle"],"datePublished":"2026-09-18","description":"told"}]}</script>'
    arxiv = "<blockquote class='abstract mathjax'><span>Abstract:</span> We <i>show</i> it.</blockquote><meta name='description' content='label'>"
    got = read(spark, ("https://a.example/", meta), ("https://a.example/", graph), ("https://arxiv.org/abs/1", arxiv), ("https://a.example/", "<time>2020-01-01</time>" + meta))
    assert [(r.published, r.date_evidence, r.summary) for r in got] == [
        (D(2026, 9, 17), "article_meta", "a bold word"), (D(2026, 9, 18), "article_meta", "told"), (None, "no_date_hint", "We show it."), (D(2026, 9, 17), "article_meta", "a bold word"),
    ]


SOURCES = [
    {"source_id": "cards", "links": [el.selector(tag="a", attribute="href", how="starts", value="/news/")], "containers": [el.selector(class_="card")]},
    {"source_id": "stated", "links": [el.selector(tag="a", attribute="href", how="contains", value="/article/detail/")], "date_rule": "stated"},
    {"source_id": "grouped", "links": [el.selector(tag="a", inside_class="bw-card__title")], "date_rule": "grouped"},
    {"source_id": "dated", "links": [el.selector(tag="a", attribute="href")], "dated_urls_only": True},
]


def listed(spark, html, source="cards", **options):
    rows = spark.createDataFrame([(1, "https://list.example.org/news", source, html)], "box int, url string, source_id string, html string")
    got = pages.listing_articles(rows, ["box"], pages.listing_sources(spark, SOURCES), **options).orderBy("position").collect()
    return [(r.href.removeprefix("https://list.example.org"), r.title, r.published, r.summary, r.date_evidence) for r in got]


def test_days_are_not_borrowed(spark):
    html = """<section><div class="card"><a href="/news/1"><h2>A device that listens</h2></a><p>It learns.</p><p>It learns while others sleep.</p>
      <time datetime="2026-09-17">today</time></div><div class="card"><a href="/news/2?utm_source=x">Another thing on sale</a></div></section>"""
    assert listed(spark, html) == [
        ("/news/1", "A device that listens", D(2026, 9, 17), "It learns while others sleep.", "listing"),
        ("/news/2", "Another thing on sale", None, "", "no_date_hint"),
    ]


def test_two_links_in_a_card(spark):
    html = """<div class="card"><div><a href="/news/1">The first headline</a><span>2026-09-01</span></div><a href="/news/2" title="The second headline">x</a>
      <a href="/other/3">Not of this source</a><i>2026-09-02</i></div><nav><a href="/news/9">A navigation entry</a></nav><a href="/news">The listing itself</a>"""
    assert listed(spark, html) == [("/news/1", "The first headline", D(2026, 9, 1), "", "listing"), ("/news/2", "The second headline", None, "", "no_date_hint")]


def test_repeated_links(spark):
    html = """<p><a href="/news/1">The first headline</a></p><div><a href="/news/1"><b class="x_h3">Another name</b></a><p>told at length</p><u>2026-09-03</u></div>
      <div><a href="/news/1">A third headline</a><p>told</p><u>2026-09-05</u></div><div><a href="/news/2">Only a hint here</a> 09-05</div>"""
    assert listed(spark, html) == [("/news/1", "The first headline", D(2026, 9, 3), "told at length", "listing"), ("/news/2", "Only a hint here", None, "", "hint_unparsed")]
    assert len(listed(spark, html, per_page=1)) == 1 and len(listed(spark, html, per_page=None)) == 2


def test_source_rules(spark):
    stated = '<li><a href="/article/detail/1">A headline long enough</a><p>happened 2026-01-01</p><span class="date">2026-02-02</span></li>'
    assert listed(spark, stated, "stated")[0][2:] == (D(2026, 2, 2), "happened 2026-01-01", "listing")
    grouped = """<div class="bw-group"><h3>2026 年 9 月</h3></div><article class="bw-card"><div class="bw-card__meta"><span>09-22</span><span>x</span></div>
      <h3 class="bw-card__title"><a href="/p/1">A headline long enough</a></h3><p class="bw-card__summary">2025-01-01 noise</p><p>a much longer paragraph here</p></article>
      <article class="bw-card"><div class="bw-card__meta"><span>08-22</span></div><h3 class="bw-card__title"><a href="/p/2">Of another month here</a></h3></article>"""
    assert [r[:4] for r in listed(spark, grouped, "grouped")] == [("/p/1", "A headline long enough", D(2026, 9, 22), "2025-01-01 noise"), ("/p/2", "Of another month here", None, "")]
    dated = '<div><a href="https://finance.eastmoney.com/a/202609223888.html">A headline long enough</a> 2026-01-01<a href="/x/1">Without a day in it</a></div>'
    assert [(r[1], r[2], r[4]) for r in listed(spark, dated, "dated")] == [("A headline long enough", D(2026, 9, 22), "url")]


@pytest.mark.parametrize("html", ["Just a moment... <article><a href='/news/1'>A headline long enough</a></article>", None, "", "<a href='/news/1'>short</a>"])
def test_pages_without_articles(spark, html):
    assert listed(spark, html) == []


def test_default_links(spark):
    rows = spark.createDataFrame([(1, "https://list.example.org/", "<article><a href='x/1'>A headline long enough</a></article><a href='x/2'>Outside of any article</a>")], "box int, url string, html string")
    assert [r.href for r in pages.listing_articles(rows, ["box"]).collect()] == ["https://list.example.org/x/1"]


def test_account_page(spark):
    html = """<h1 id="activity-name">A <b>title</b></h1><span id="js_name"> The account </span><em id="publish_time">2026-09-22 08:00</em><meta property="og:description" content="told">
      <div id="js_content"><div><p>one paragraph of some length</p><div>nested <i>text</i></div></div><script>no</script><noscript>no</noscript><p>end</p></div><p>outside</p>"""
    rows = spark.createDataFrame([(1, "https://mp.weixin.qq.com/s/x", html), (2, "https://mp.weixin.qq.com/t/x", html), (3, "https://mp.weixin.qq.com/s", "<div id='js_content'>x</div>")], "n int, url string, html string")
    got = pages.account_pages(rows, ["n"]).collect()
    assert [tuple(r) for r in got] == [(1, "A title", "The account", D(2026, 9, 22), "told", "one paragraph of some length\nnested\ntext\nend")]


def test_headings_of_a_product_page(spark):
    html = "<title>Acme</title><meta property='og:title' content='Nova Band 2'><h1>Nova <b>Band</b></h1><h3>no</h3><p itemprop='name'>named</p><p>text</p>"
    rows = spark.createDataFrame([("u", html)], "url string, html string")
    assert tuple(pages.product_page_texts(rows).first()) == ("u", "Acme Nova Band named Nova Band 2", "Acme Nova Band no named text")


def test_few_pages_are_held_as_objects():
    """Memory of a batch does not grow with its pages beyond what Arrow holds."""
    import tracemalloc

    import pyarrow as pa

    page = "<html><body>" + "<div class='a b'><p id='x'>text</p></div>" * 50 + "</body></html>"
    batch = pa.array([page, None] * 400)
    tracemalloc.start()
    trees = el.tree.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(trees) == 800 and trees.slice(0, 2).to_pylist() == trees.slice(2, 2).to_pylist()
    assert len(trees[0].as_py()["nodes"]) == 103 and trees[1].as_py()["texts"] == []
    assert peak < 12_000_000
