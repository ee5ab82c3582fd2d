"""Ingestion jobs over feeds, pages and payloads that Spark builds from the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions import text
from broadsheet.plans.registry import query
from broadsheet.plans.tables import ARTICLES, articles, load, with_sql
from broadsheet.sources import elements as el
from broadsheet.sources import feeds, pages, payloads, repositories

BOX = 8  # entries per generated feed, listing or payload


def _xml(column):
    bare = F.regexp_replace(column, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        bare = F.replace(bare, F.lit(raw), F.lit(name))
    return bare


def _word_text(column):
    """Letters, digits and plain punctuation only, so that both engines see the same entities and spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(column, r"[^\p{L}\p{N} .,:;!?@-]+", " "), " +", " "))


SQL_WORD = "trim(regexp_replace(regexp_replace({0}, '[^\\p{{L}}\\p{{N}} .,:;!?@-]+', ' ', 'g'), ' +', ' ', 'g'))"


def sql_word(column: str) -> str:
    return SQL_WORD.format(column)


def _boxed(spark, sf_dir, item, name):
    """Group rendered items into documents of at most BOX entries, keyed so no group can grow."""
    rows = articles(spark, sf_dir).withColumn("box", F.expr(f"doc_id div {BOX}")).withColumn("item", item)
    return rows.groupBy("box").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "item"))), lambda r: r["item"]), "").alias(name)
    )


def _stamp():
    return F.timestamp_seconds(1704067200 + F.col("doc_id") * 977 % 2592000)


def rss_documents(spark, sf_dir):
    doc = F.col("doc_id")
    when = F.when(doc % 12 == 5, F.lit("")).otherwise(
        F.concat(F.lit("<pubDate>"), F.date_format(_stamp(), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate>"))
    )
    item = F.concat(
        F.lit("<item><guid isPermaLink=\"false\">g"), doc.cast("string"), F.lit("</guid><title>"), _xml(_word_text(F.col("title"))),
        F.lit("</title><link>"), _xml(F.col("url")), F.lit("</link><description>&lt;p&gt;"), _xml(_word_text(F.col("summary"))),
        F.lit("&lt;/p&gt;</description><content:encoded><![CDATA[<div>"), _word_text(F.col("body")), F.lit("</div>]]></content:encoded><category>"),
        F.col("source"), F.lit("</category><category>"), F.col("profile_id"), F.lit("</category><dc:creator>"), F.col("source"), F.lit("</dc:creator>"),
        when, F.lit("</item>"),
    )
    rows = _boxed(spark, sf_dir, item, "items")
    return rows.select(
        "box",
        F.concat(
            F.lit('<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>t</title>'),
            "items", F.lit("</channel></rss>"),
        ).alias("xml"),
    )


def atom_documents(spark, sf_dir):
    doc = F.col("doc_id")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revised = F.timestamp_seconds(1704067200 + doc * 977 % 2592000 + (doc % 4) * 86400 - F.when(doc % 9 == 4, 999999).otherwise(0))
    item = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/2401."), doc.cast("string"), F.when(doc % 5 == 0, F.lit("")).otherwise(F.lit("v2")),
        F.lit("</id><updated>"), iso(revised), F.lit("</updated><published>"), iso(_stamp()), F.lit("</published><title>"),
        _xml(_word_text(F.col("title"))), F.lit("</title><summary>"), _xml(_word_text(F.col("body"))),
        F.lit('</summary><link href="'), _xml(F.col("url")), F.lit('" rel="alternate"/><link href="https://other.example.org/x" rel="related"/><category term="'),
        F.col("source"), F.lit('"/><author><name>'), F.col("profile_id"), F.lit("</name></author></entry>"),
    )
    rows = _boxed(spark, sf_dir, item, "items")
    return rows.select(
        "box", F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>'), "items", F.lit("</feed>")).alias("xml")
    )


def _day(text_day):
    return F.to_date(F.lit(text_day))


@query(
    "rss_entries",
    with_sql(ARTICLES)
    + f"""SELECT doc_id // 8 AS box, 'g' || doc_id AS entry_id, {sql_word("title")} AS title, url,
      CASE WHEN ws = '' OR ws = wb THEN wb WHEN wb = '' THEN ws ELSE ws || chr(10) || chr(10) || wb END AS content,
      source || '|' || profile_id AS tags, source AS authors, epoch AS published_epoch
    FROM (SELECT *, {sql_word("summary")} AS ws, {sql_word("body")} AS wb, 1704067200 + doc_id * 977 % 2592000 AS epoch FROM articles)
    WHERE doc_id % 12 <> 5 AND {sql_word("title")} <> '' AND (to_timestamp(epoch + 28800) AT TIME ZONE 'UTC')::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
)
def rss_entries(spark, sf_dir):
    rows = feeds.rss_entries(rss_documents(spark, sf_dir), _day("2024-01-05"), _day("2024-01-20"), ["box"])
    return rows.select(
        "box", "entry_id", "title", "url", "content", F.array_join("tags", "|").alias("tags"),
        F.array_join("authors", "|").alias("authors"), F.unix_timestamp("published_at").alias("published_epoch"),
    )


@query(
    "atom_entries",
    with_sql(ARTICLES)
    + f"""SELECT doc_id // 8 AS box, 'http://arxiv.org/abs/2401.' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'v2' END AS entry_id,
      {sql_word("title")} AS title, url, source AS tags, profile_id AS authors, 1704067200 + doc_id * 977 % 2592000 AS published_epoch
    FROM articles WHERE {sql_word("title")} <> '' AND (to_timestamp(1704067200 + doc_id * 977 % 2592000 + 28800) AT TIME ZONE 'UTC')::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
)
def atom_entries(spark, sf_dir):
    rows = feeds.atom_entries(atom_documents(spark, sf_dir), _day("2024-01-05"), _day("2024-01-20"), ["box"])
    return rows.select(
        "box", "entry_id", "title", "url", F.array_join("tags", "|").alias("tags"),
        F.array_join("authors", "|").alias("authors"), F.unix_timestamp("published_at").alias("published_epoch"),
    )


@query(
    "paper_entries",
    with_sql(ARTICLES)
    + f"""SELECT 'https://arxiv.org/abs/2401.' || doc_id AS url, {sql_word("title")} AS title, revised_day AS published, first_day AS first_submitted,
      CASE WHEN doc_id % 5 <> 0 THEN 'v2' WHEN first_epoch = revised_epoch THEN 'v1' ELSE '' END AS version
    FROM (SELECT *, (to_timestamp(revised_epoch) AT TIME ZONE 'UTC')::DATE AS revised_day, (to_timestamp(first_epoch) AT TIME ZONE 'UTC')::DATE AS first_day
      FROM (SELECT *, 1704067200 + doc_id * 977 % 2592000 AS first_epoch,
        1704067200 + doc_id * 977 % 2592000 + (doc_id % 4) * 86400 - CASE WHEN doc_id % 9 = 4 THEN 999999 ELSE 0 END AS revised_epoch FROM articles))
    WHERE first_epoch <= revised_epoch AND revised_day BETWEEN DATE '2024-01-25' - 19 AND DATE '2024-01-25' AND {sql_word("title")} <> '' AND {sql_word("body")} <> ''""",
)
def paper_entries(spark, sf_dir):
    rows = feeds.paper_entries(atom_documents(spark, sf_dir), _day("2024-01-25"), 20, ["box"])
    return rows.select("url", "title", "published", "first_submitted", "version")


_PAGE_BODY = r"""regexp_extract(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<article\b[^>]*>(.*?)</article>', 1)"""


def _sql_entities(column: str) -> str:
    for name, value in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
        ("&middot;", "·"), ("&copy;", "©"), ("&hellip;", "…"), ("&amp;", "&"),
    ):
        column = f"replace({column}, '{name}', '{value}')"
    return column


def _sql_references(column: str) -> str:
    """Entities as an HTML parser reads them: those older than HTML 5 also without their semicolon."""
    for name, value in (
        ("&nbsp;?", " "), ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "''"), ("&apos;", "''"),
        ("&middot;?", "·"), ("&copy;?", "©"), ("&hellip;", "…"), ("&amp;?", "&"),
    ):
        column = f"regexp_replace({column}, '{name}', '{value}', 'g')"
    return column


@query(
    "page_titles_bodies",
    f"""SELECT page_id, trim(regexp_replace({_sql_references("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS title,
      list_aggregate(list_concat(
          list_filter(list_transform(string_split({_sql_references("regexp_replace(" + _PAGE_BODY + ", '(?s)<[^>]*>', chr(10), 'g')")}, chr(10)), lambda s: trim(s)), lambda s: s <> ''),
          [['nested', 'last'], ['nested', 'last'], []][page_id % 3 + 1]), 'string_agg', chr(10)) AS body,
      'no_date_hint' AS date_evidence FROM pages""",
)
def page_titles_bodies(spark, sf_dir):
    """Pages as they are, and with their article in nested elements of one name, chrome among them, by residue."""
    tail = "<div><nav>chrome</nav><div>nested</div></div><aside>more <div>chrome</div></aside><div>last</div>"
    k = F.col("page_id") % 3
    opening = F.when(k == 0, F.lit("<div class='wide article-content'><div><div>")).when(k == 1, F.lit("<main><div class='TRS_Editor'>")).otherwise(F.lit("<article>"))
    closing = F.when(k == 0, F.lit(f"</div></div>{tail}</div><div>outside</div>")).when(k == 1, F.lit(f"{tail}</div></main>outside")).otherwise(F.lit("</article>outside"))
    html = F.replace(F.replace(F.col("html"), F.lit("<article>"), opening), F.lit("</article>"), closing)
    return pages.read_pages(load(spark, sf_dir, "pages").withColumn("html", html), ["page_id"]).select("page_id", "title", "body", "date_evidence")


@query(
    "page_dates",
    """SELECT page_id, CASE WHEN page_id % 9 IN (7, 8) THEN NULL ELSE DATE '2024-01-01' + (page_id % 28)::INT END AS published,
      ['article_meta', 'article_meta', 'article_visible', 'article_visible', 'url', 'article_visible', 'article_visible', 'hint_unparsed', 'no_date_hint'][page_id % 9 + 1] AS date_evidence,
      CASE page_id % 9 WHEN 0 THEN 'stated summary' WHEN 1 THEN 'graph summary' ELSE '' END AS summary FROM pages""",
)
def page_dates(spark, sf_dir):
    """The sample pages with one kind of date evidence added to each, by residue; some hosts have elements of their own."""
    day = F.date_format(F.date_add(_day("2024-01-01"), (F.col("page_id") % 28).cast("int")), "yyyy-MM-dd")
    slashed = F.replace(day, F.lit("-"), F.lit("/"))
    k = F.col("page_id") % 9
    added = (
        F.when(k == 0, F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T08:00:00Z"><meta name="description" content="stated summary">')))
        .when(k == 1, F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"@type": "WebSite"}, {"@type": "ScholarlyArticle", "datePublished": "'), day, F.lit('", "description": "graph summary"}]}</script>')))
        .when(k == 2, F.concat(F.lit('<header><time datetime="'), day, F.lit('">x</time></header>')))
        .when(k == 3, F.concat(F.lit('<div class="meta releaseTime"><div>by <b>someone</b></div><div>'), slashed, F.lit("</div></div>")))
        # the host states the day in one class; another day stands before it
        .when(k == 5, F.concat(F.lit('<time datetime="2001-01-01">x</time><div class="detail-info"><p>by x</p><p>'), slashed, F.lit("</p></div>")))
        .when(k == 6, F.concat(F.lit('<div class="item">2001-01-01</div><div class="time-source"><div class="x"><div class="item">'), slashed, F.lit("</div></div></div>")))
        .when(k == 7, F.lit('<div class="time-source"><div class="item">2001-01-01</div></div>'))
        .otherwise(F.lit(""))
    )
    compact = F.replace(day, F.lit("-"), F.lit(""))
    url = (
        F.when(k == 4, F.concat(F.lit("https://www.chinaventure.com.cn/news/80-"), compact, F.lit("-1.html")))
        .when(k == 5, F.lit("https://www.stcn.com/article/x"))
        .when(k == 6, F.lit("https://finance.eastmoney.com/x"))
        .otherwise(F.lit("https://pages.example.org/x"))
    )
    html = F.regexp_replace("html", "<body>", F.concat(F.lit("<body>"), added))
    rows = load(spark, sf_dir, "pages").select("page_id", url.alias("url"), html.alias("html"))
    return pages.read_pages(rows, ["page_id"]).select("page_id", "published", "date_evidence", "summary")


@query(
    "product_page_texts",
    f"""SELECT page_id, coalesce(nullif(concat_ws(' ', nullif(t, ''), nullif(t, '')), ''), ' ') AS headings FROM (
      SELECT page_id, trim({_sql_references("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS t FROM pages)""",
)
def product_page_texts(spark, sf_dir):
    """Headings read from markup: the sample pages repeat their title as first heading."""
    rows = load(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    return pages.product_page_texts(rows).select(F.col("url").cast("long").alias("page_id"), "headings")


LISTING_SOURCES = [
    {"source_id": "plain"},
    {"source_id": "cards", "links": [el.selector(tag="a", attribute="href", how="starts", value="/news/")], "containers": [el.selector(class_="card")]},
    {"source_id": "stated", "links": [el.selector(tag="a", attribute="href", how="contains", value="/article/detail/")], "date_rule": "stated"},
    {"source_id": "grouped", "links": [el.selector(tag="a", inside_class="bw-card__title")], "date_rule": "grouped"},
    {"source_id": "dated", "links": [el.selector(tag="a", attribute="href")], "dated_urls_only": True},
]


def listing_documents(spark, sf_dir):
    """Listings of five sources, by box: each article is a card with two links, its day and its summary."""
    doc, box = F.col("doc_id"), F.expr(f"doc_id div {BOX}")
    kind = box % 5
    day, n = F.date_format("seen_day", "yyyy-MM-dd"), (doc - doc % 2).cast("string")
    title, told = _word_text(F.col("title")), F.regexp_replace(_word_text(F.col("summary")), r"\d", "")
    dated = F.when(doc % 3 == 0, F.concat(F.lit('<time datetime="'), day, F.lit('">then</time>'))).when(doc % 3 == 1, F.concat(F.lit("<span>"), day, F.lit("</span>"))).otherwise(F.lit(""))
    paragraphs = F.concat(F.lit("<p>short</p><p>"), told, F.lit("</p>"))
    second = F.concat(F.lit('/more/'), doc.cast("string"), F.lit('">More about number '), doc.cast("string"), F.lit("</a>"))
    card = F.concat(
        F.lit('<div class="inner"><a href="/news/'), n, F.lit('?utm_source=list"><h3>'), title, F.lit("</h3></a><div>"), dated, F.lit("</div><div>"), paragraphs, F.lit("</div></div>"),
    )
    compact = F.replace(day, F.lit("-"), F.lit(""))
    item = (
        F.when(kind == 0, F.concat(F.lit('<article class="card">'), card, F.lit('<a href="'), second, F.lit("</article>")))
        .when(kind == 1, F.concat(F.lit('<div class="card">'), card, F.lit('<a href="/news'), second, F.lit("</div>")))
        .when(kind == 2, F.concat(F.lit('<li><a href="/article/detail/'), n, F.lit('">'), title, F.lit("</a><p>on 2001-01-01</p>"), F.when(doc % 3 < 2, F.concat(F.lit('<i class="date">'), day, F.lit("</i>"))).otherwise(F.lit("")), F.lit("</li>")))
        .when(kind == 3, F.concat(
            F.lit('<div class="bw-group">'), F.date_format("seen_day", "yyyy 年 M 月"), F.lit('</div><article class="bw-card"><div class="bw-card__meta"><span>'), F.date_format("seen_day", "MM-dd"),
            F.lit('</span></div><h3 class="bw-card__title"><a href="/p/'), n, F.lit('">'), title, F.lit('</a></h3><p class="bw-card__summary">'), told, F.lit("</p><p>2001-01-01 is a longer line than the summary</p></article>"),
        ))
        .otherwise(F.concat(F.lit('<div><a href="https://finance.eastmoney.com/a/'), compact, n, F.lit('.html">'), title, F.lit('</a> 2001-01-01 <a href="'), second, F.lit("</div>")))
    )
    # few bytes, much work: a share for every core
    rows = _boxed(spark, sf_dir, item, "cards").repartition(spark.sparkContext.defaultParallelism, "box")
    names = F.array(*[F.lit(r["source_id"]) for r in LISTING_SOURCES])
    return rows.select(
        "box", F.lit("https://list.example.org/front/").alias("url"), F.element_at(names, (F.col("box") % 5 + 1).cast("int")).alias("source_id"),
        F.concat(F.lit("<html><nav><a href='/news/x'>navigation entry</a></nav><main>"), "cards", F.lit("</main></html>")).alias("html"),
    )


@query(
    "listing_articles",
    with_sql(ARTICLES)
    + f""", cards AS (SELECT doc_id, doc_id // 8 AS box, (doc_id // 8) % 5 AS kind, doc_id - doc_id % 2 AS n, seen_day, {sql_word("title")} AS title,
        trim(regexp_replace({sql_word("summary")}, '\\d', '', 'g')) AS told FROM articles),
      links AS (
        SELECT box, 2 * doc_id AS place, title, 'https://list.example.org' || ['/news/', '/news/', '/article/detail/', '/p/'][kind + 1] || n AS href,
          CASE WHEN kind = 3 OR doc_id % 3 <> 2 THEN seen_day END AS published, 'listing' AS proof,
          CASE kind WHEN 2 THEN 'on 2001-01-01' WHEN 3 THEN told ELSE CASE WHEN len(told) > 5 THEN told ELSE 'short' END END AS summary FROM cards WHERE kind < 4
        UNION ALL SELECT box, 2 * doc_id, title, 'https://finance.eastmoney.com/a/' || strftime(seen_day, '%Y%m%d') || n || '.html', seen_day, 'url', '' FROM cards WHERE kind = 4
        UNION ALL SELECT box, 2 * doc_id + 1, 'More about number ' || doc_id, 'https://list.example.org' || ['', '/news'][kind + 1] || '/more/' || doc_id, NULL, NULL, '' FROM cards WHERE kind < 2)
    SELECT box, href, arg_min(title, place) AS title, arg_min(published, place) FILTER (WHERE published IS NOT NULL) AS published,
      substr((list(summary ORDER BY len(substr(summary, 1, 2000)) DESC, place))[1], 1, 2000) AS summary,
      coalesce(arg_min(proof, place) FILTER (WHERE published IS NOT NULL), CASE WHEN bool_or((box % 5) = 2) THEN 'hint_unparsed' ELSE 'no_date_hint' END) AS date_evidence
    FROM links WHERE len(title) BETWEEN 8 AND 300 GROUP BY box, href""",
)
def listing_articles(spark, sf_dir):
    sources = pages.listing_sources(spark, LISTING_SOURCES)
    return pages.listing_articles(listing_documents(spark, sf_dir), ["box"], sources).select("box", "href", "title", "published", "summary", "date_evidence")


@query(
    "account_pages",
    with_sql(ARTICLES)
    + f"""SELECT doc_id, {sql_word("title")} AS title, source, seen_day AS published, {sql_word("body")} || chr(10) || 'nested' || chr(10) || 'last' AS body FROM articles
      WHERE doc_id % 10 = 5 AND {sql_word("body")} <> '' AND len({sql_word("body")}) >= 18""",
)
def account_pages(spark, sf_dir):
    """Account pages whose body lies in nested elements of one name."""
    doc = F.col("doc_id")
    dated = F.when(doc % 3 == 0, F.concat(F.lit('<em id="publish_time">'), F.date_format("seen_day", "yyyy-MM-dd"), F.lit(" 08:00</em>"))).otherwise(
        F.concat(F.lit('<script>var create_time = "'), (F.unix_timestamp(F.col("seen_day").cast("timestamp")) + 3600).cast("string"), F.lit('";</script>'))
    )
    html = F.concat(
        F.lit('<html><h1 class="t" id="activity-name"> '), _word_text(F.col("title")), F.lit('</h1><a id="js_name">'), F.col("source"), F.lit("</a>"), dated,
        F.lit('<div class="rich" id="js_content"><div><p>'), _word_text(F.col("body")),
        F.lit("</p><div>nested</div><script>no</script></div><video>no</video><div>last</div></div><div>outside</div></html>"),
    )
    rows = articles(spark, sf_dir).select("doc_id", "url", html.alias("html"))
    return pages.account_pages(rows, ["doc_id"]).select("doc_id", "title", "source", "published", "body")


@query(
    "account_articles",
    with_sql(ARTICLES)
    + """SELECT doc_id // 8 AS box, trim(title) AS title, url, 1704067200 + doc_id * 977 % 2592000 AS published_epoch FROM articles
      WHERE trim(title) <> '' AND doc_id % 11 <> 3""",
)
def account_articles(spark, sf_dir):
    """Account replies in all three shapes; every eleventh article carries no usable time."""
    doc = F.col("doc_id")
    when = F.when(doc % 11 == 3, F.lit("soon")).otherwise((1704067200 + doc * 977 % 2592000).cast("string"))
    rows = articles(spark, sf_dir).withColumn("box", F.expr(f"doc_id div {BOX}")).groupBy("box").agg(
        F.collect_list(F.struct("title", F.col("url").alias("link"), when.alias("create_time"))).alias("articles")
    )
    inner = F.array(F.struct("articles"))
    payload = (
        F.when(F.col("box") % 3 == 0, F.to_json(F.struct("articles")))
        .when(F.col("box") % 3 == 1, F.to_json(F.struct(F.struct(inner.alias("list")).alias("data"))))
        .otherwise(F.to_json(F.struct(inner.alias("list"))))
    )
    out = payloads.account_articles(rows.select("box", payload.alias("payload")), ["box"])
    return out.select("box", "title", "url", F.unix_timestamp("published_at").alias("published_epoch"))


@query(
    "policy_list",
    with_sql(ARTICLES)
    + """SELECT doc_id // 8 AS box, title, url, CASE WHEN doc_id % 4 < 2 THEN seen_day END AS published,
      CASE WHEN doc_id % 4 < 2 THEN 'api' WHEN doc_id % 4 = 2 THEN 'hint_unparsed' ELSE 'no_date_hint' END AS date_evidence FROM articles""",
)
def policy_list(spark, sf_dir):
    doc = F.col("doc_id")
    when = F.when(doc % 4 < 2, F.date_format("seen_day", "yyyy-MM-dd")).when(doc % 4 == 2, F.date_format("seen_day", "MM-dd")).otherwise(F.lit("soon"))
    rows = articles(spark, sf_dir).withColumn("box", F.expr(f"doc_id div {BOX}")).groupBy("box").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct(
            F.col("title").alias("TITLE"), F.col("url").alias("URL"), when.alias("DOCRELPUBTIME"), F.col("summary").alias("SUB_TITLE")
        )))).alias("payload")
    )
    return payloads.policy_list(rows, ["box"]).select("box", "title", "url", "published", "date_evidence")


def search_rows(spark, sf_dir):
    doc = F.col("doc_id")
    recency = F.when(doc % 5 < 3, F.lit("oneDay")).otherwise(F.lit("oneWeek"))
    link = F.when(doc % 13 == 0, F.lit("https://www.oed.com/view")).otherwise(F.col("url"))
    return articles(spark, sf_dir).select(
        "doc_id", "source", "category", "title", link.alias("link"), recency.alias("recency"),
        F.when(doc % 4 == 0, F.lit("")).otherwise(F.date_format("seen_day", "yyyy-MM-dd")).alias("publish_date"),
        F.col("body").alias("content"), F.when(doc % 3 == 0, F.lit("")).otherwise(F.col("source")).alias("media"),
        (doc % 3).alias("query_no"), "seen_day",
    )


@query(
    "search_articles",
    with_sql(ARTICLES)
    + """SELECT doc_id, substr(title, 1, 250) AS title, url, CASE WHEN doc_id % 4 <> 0 THEN seen_day END AS published,
      CASE WHEN doc_id % 3 = 0 THEN regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) ELSE source END AS source,
      CASE WHEN doc_id % 4 <> 0 THEN 'search' ELSE 'no_date_hint' END AS date_evidence
    FROM articles WHERE doc_id % 13 <> 0 AND title <> ''""",
)
def search_articles(spark, sf_dir):
    return payloads.search_articles(search_rows(spark, sf_dir), ["doc_id"]).drop("summary")


@query(
    "distinct_links",
    with_sql(ARTICLES)
    + """SELECT link, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM (
      SELECT doc_id, source, CASE WHEN doc_id % 13 = 0 THEN 'https://www.oed.com/view' ELSE url END AS link FROM articles) GROUP BY link""",
)
def distinct_links(spark, sf_dir):
    """The first hit of every address among all search results."""
    return payloads.distinct_links(search_rows(spark, sf_dir).select("link", "doc_id", "source"), "link", "doc_id")


@query(
    "unwrapped_news",
    with_sql(ARTICLES)
    + """SELECT doc_id, url, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS source FROM articles WHERE doc_id % 7 <> 2""",
)
def unwrapped_news(spark, sf_dir):
    doc = F.col("doc_id")
    wrapped = F.concat(F.lit("https://www.bing.com/news/apiclick.aspx?ref=x&url="), F.url_encode("url"), F.lit("&c=1"))
    stuck = F.lit("http://bing.com/news?url=https%3A%2F%2Fwww.bing.com%2Fagain")
    rows = articles(spark, sf_dir).select(
        "doc_id", F.when(doc % 7 == 2, stuck).when(doc % 2 == 0, wrapped).otherwise(F.col("url")).alias("url")
    )
    return payloads.unwrapped_news(rows).select("doc_id", "url", "source")


def repositories_view(spark, sf_dir):
    """Parts as repositories: daily snapshots from the lines shipped on a day."""
    lines = load(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", F.to_date("l_shipdate").alias("ship"))
    month = F.trunc("ship", "month")
    daily = lines.groupBy(F.col("l_partkey").alias("p_partkey"), month.alias("snapshot_day")).agg(
        F.sum("l_quantity").cast("long").alias("stars_today"), F.count(F.lit(1)).alias("forks")
    )
    parts = load(spark, sf_dir, "part")
    joined = daily.join(parts, "p_partkey")
    from pyspark.sql import Window

    w = Window.partitionBy("snapshot_day").orderBy(F.desc("stars_today"), "p_partkey")
    return joined.select(
        "p_partkey", "snapshot_day", F.regexp_replace("p_brand", "#", "").alias("owner"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string")).alias("name"),
        F.col("p_name").alias("description"), F.col("p_type").alias("language"), "stars_today", "forks",
        (F.col("p_size") * 1000 + F.col("stars_today")).alias("stars"),
        F.array(F.element_at(F.split("p_name", " "), 1)).alias("topics"),
        F.when(F.col("p_size") % 2 == 0, F.lit("MIT")).otherwise(F.lit("")).alias("license"),
        F.row_number().over(w).alias("rank"),
    ).withColumn("full_name", F.concat("owner", F.lit("/"), "name"))


REPOS = """repos AS (SELECT d.*, replace(p_brand, '#', '') AS owner, replace(p_name, ' ', '-') || '-' || d.p_partkey AS name, p_name AS description, p_type AS language,
    p_size * 1000 + stars_today AS stars, string_split(p_name, ' ')[1] AS topic, CASE WHEN p_size % 2 = 0 THEN 'MIT' ELSE '' END AS license, p_size,
    row_number() OVER (PARTITION BY snapshot_day ORDER BY stars_today DESC, d.p_partkey) AS rank,
    replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '-') || '-' || d.p_partkey AS full_name
  FROM (SELECT l_partkey AS p_partkey, date_trunc('month', l_shipdate)::DATE AS snapshot_day, sum(l_quantity)::BIGINT AS stars_today, count(*) AS forks
    FROM lineitem GROUP BY ALL) d JOIN part USING (p_partkey))"""


@query(
    "trending_rows",
    with_sql(REPOS)
    + """SELECT snapshot_day, (rank - (rank - 1) // 10 * 10)::INT AS rank, (rank - 1) // 10 AS page, owner, name, language,
      (CASE WHEN stars >= 10000 THEN stars // 100 * 100 ELSE stars END)::BIGINT AS stars, forks, stars_today FROM repos""",
)
def trending_rows(spark, sf_dir):
    """Trending pages of ten cards each, rendered from the monthly snapshots and read back."""
    repos = repositories_view(spark, sf_dir)
    stars = F.when(F.col("stars") >= 10000, F.concat(F.expr("stars div 1000").cast("string"), F.lit("."), F.expr("stars % 1000 div 100").cast("string"), F.lit("k"))).otherwise(F.format_number("stars", 0))
    path = F.concat(F.lit("/"), "owner", F.lit("/"), "name")
    card = F.concat(
        F.lit('<article class="Box-row"><h2 class="h3"><a data-x="1" href="'), path, F.lit('">x</a></h2><p>'), F.col("description"),
        F.lit('</p><span itemprop="programmingLanguage">'), F.col("language"), F.lit('</span><a href="'), path, F.lit('/stargazers">'), stars,
        F.lit('</a><a href="'), path, F.lit('/forks">'), F.col("forks").cast("string"), F.lit('</a><span class="d-inline-block float-sm-right">'),
        F.format_number("stars_today", 0), F.lit(" stars today</span></article>"),
    )
    docs = repos.withColumn("page", F.expr("(rank - 1) div 10")).groupBy("snapshot_day", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", card.alias("card")))), lambda r: r["card"]), "").alias("html")
    )
    return repositories.trending_rows(docs, ["snapshot_day", "page"]).select(
        "snapshot_day", "rank", "page", "owner", "name", "language", "stars", "forks", "stars_today"
    )


@query(
    "metadata_enrichment",
    with_sql(REPOS)
    + """SELECT snapshot_day, full_name,
      CASE WHEN p_size % 3 = 0 OR p_size % 4 = 0 THEN description ELSE 'new ' || description END AS description,
      CASE WHEN p_size % 5 = 0 OR p_size % 4 = 0 THEN stars ELSE p_size * 7 END AS stars,
      CASE WHEN p_size % 4 = 0 THEN topic ELSE '' END AS topics,
      CASE WHEN p_size % 4 = 0 THEN license ELSE 'Apache-2.0' END AS license FROM repos""",
)
def metadata_enrichment(spark, sf_dir):
    """Snapshots enriched with metadata that is empty, zero or absent for part of the repositories."""
    repos = repositories_view(spark, sf_dir).withColumn("homepage", F.lit("")).withColumn("open_issues", F.lit(0)).withColumn("updated_at", F.lit(""))
    size = F.col("p_size")
    found = (
        repos.select("full_name", "p_partkey").distinct().join(load(spark, sf_dir, "part"), "p_partkey").filter(size % 4 != 0).select(
            "full_name", F.lit(True).alias("known"),
            F.when(size % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("new "), "p_name")).alias("description"),
            F.lit("").alias("language"), F.when(size % 5 == 0, F.lit(0)).otherwise(size * 7).cast("long").alias("stars"),
            F.lit(0).cast("long").alias("forks"), F.lit(None).cast("array<string>").alias("topics"), F.lit("Apache-2.0").alias("license"),
            F.lit("").alias("homepage"), F.lit(3).alias("open_issues"), F.lit("2024").alias("updated_at"),
        )
    )
    return repositories.enrich(repos, found).select(
        "snapshot_day", "full_name", "description", "stars", F.array_join("topics", "|").alias("topics"), "license"
    )


@query(
    "cleaned_markup",
    f"""SELECT page_id, len(trim(regexp_replace({_sql_entities("regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')))::INT AS visible_length FROM pages""",
)
def cleaned_markup(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.length(text.strip_tags(F.col("html"))).alias("visible_length"))
