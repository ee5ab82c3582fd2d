"""Raw pages and listings held in a table, read with expressions over their elements (see ``elements``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import dates, text, urls
from broadsheet.sources import elements as el

NODE = (
    "`@type` string, datePublished string, description string"
)


def _key(node: Column) -> Column:
    """What a meta element names: its property, else its name."""
    return F.lower(F.coalesce(F.try_element_at(node["attributes"], F.lit("property")), el.attribute(node, "name")))


def meta_dates(page: Column) -> Column:
    """Days stated in publication meta tags, in page order."""
    tags = el.select(page, lambda n: (n["tag"] == "meta") & _key(n).isin(*fixed.META_DATE_KEYS))
    return F.filter(F.transform(tags, lambda n: dates.date_text(el.attribute(n, "content"))), lambda d: d.isNotNull())


def meta_description(page: Column) -> Column:
    tags = el.select(page, lambda n: (n["tag"] == "meta") & _key(n).isin("description", "og:description"))
    found = F.filter(F.transform(tags, lambda n: text.strip_tags(el.attribute(n, "content"))), lambda d: d != "")
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))


def linked_data(blocks: Column) -> Column:
    """Article nodes of the page's JSON-LD blocks, top level, listed and under @graph."""
    node = f"struct<{NODE.replace(' string', ':string')}>"
    as_list = F.flatten(
        F.transform(
            blocks,
            lambda b: F.coalesce(
                F.when(F.ltrim(b).startswith("["), F.from_json(b, f"array<{node}>")).otherwise(
                    F.concat(
                        F.array(F.from_json(b, node)),
                        F.coalesce(F.from_json(F.get_json_object(b, "$.@graph"), f"array<{node}>"), F.array().cast(f"array<{node}>")),
                    )
                ),
                F.array().cast(f"array<{node}>"),
            ),
        )
    )
    types = "|".join(fixed.ARTICLE_TYPES)
    return F.filter(F.slice(as_list, 1, 60), lambda n: F.coalesce(n["@type"].rlike(rf'(^|[\["])({types})($|[\]"])'), F.lit(False)))


def _days(page: Column, nodes: Column) -> Column:
    """Days that elements state by attribute or text, those without one left out."""
    found = F.transform(F.transform(nodes, lambda n: F.concat_ws(" ", el.attribute(n, "datetime"), el.text_of(page, n))), dates.date_text)
    return F.filter(found, lambda d: d.isNotNull())


def visible_dates(page: Column, host: Column) -> Column:
    """Days in the elements where a host states them: known ones for some hosts, else time elements and date classes."""
    usual = lambda n: (n["tag"] == "time") | F.arrays_overlap(n["classes"], F.array(*[F.lit(c) for c in fixed.VISIBLE_DATE_CLASSES]))
    around, item = fixed.FINANCE_DATE_ITEM
    finance = lambda n: (
        (n["tag"] == "time")
        | F.arrays_overlap(n["classes"], F.array(*[F.lit(c) for c in fixed.FINANCE_DATE_CLASSES]))
        | (el.classed(item)(n) & F.exists(page["nodes"], lambda a: el.inside(n, a) & el.classed(around)(a)))
    )
    known = F.create_map(*[F.lit(x) for pair in fixed.HOST_DATE_CLASSES.items() for x in pair])
    own = F.try_element_at(known, host)
    nodes = (
        F.when(host.endswith(fixed.FINANCE_HOST_SUFFIX), el.select(page, finance))
        .when(own.isNotNull(), el.select(page, lambda n: F.array_contains(n["classes"], own)))
        .otherwise(el.select(page, usual))
    )
    return _days(page, nodes)


def body_text(page: Column, limit: int | None = None) -> Column:
    """Readable text of the first article element, or of the page, without chrome; nested elements are whole."""
    gone = el.select(page, lambda n: n["tag"].isin(*fixed.PAGE_CHROME))
    shown = lambda place: ~F.exists(gone, lambda g: (place >= g["first"]) & (place <= g["last"]))
    wanted = lambda n: n["tag"].isin(*fixed.ARTICLE_TAGS) | F.arrays_overlap(n["classes"], F.array(*[F.lit(c) for c in fixed.ARTICLE_CLASSES]))
    holder = F.coalesce(el.first(page, lambda n: wanted(n) & shown(n["first"])), F.try_element_at(page["nodes"], F.lit(1)))
    texts = F.filter(page["texts"], lambda t: (t["at"] > holder["first"]) & (t["at"] <= holder["last"]) & shown(t["at"]))
    lines = F.array_join(F.transform(texts, lambda t: t["text"]), "\n")
    return lines if limit is None else F.substring(lines, 1, limit)


def headings(page: Column, most: int = 15) -> Column:
    """What a product page calls itself: its title, first headings and name elements, then its stated title and description."""
    named = el.select(page, lambda n: n["tag"].isin("title", "h1", "h2") | (el.attribute(n, "itemprop") == "name"))
    stated = el.select(page, lambda n: (n["tag"] == "meta") & ((el.attribute(n, "property") == "og:title") | (el.attribute(n, "name") == "description")))
    return F.array_join(
        F.concat(
            F.transform(F.slice(named, 1, most), lambda n: el.text_of(page, n)), F.transform(F.slice(stated, 1, 3), lambda n: el.attribute(n, "content"))
        ),
        " ",
    )


def product_page_texts(pages: DataFrame, most: int = 6000) -> DataFrame:
    """url, headings and leading text of fetched pages (columns url, html)."""
    page = F.col("page")
    return pages.withColumn("page", el.tree(F.col("html"))).select(
        "url", headings(page).alias("headings"), F.substring(el.all_text(page), 1, most).alias("text")
    )


def read_pages(pages: DataFrame, keep: list[str], limit: int | None = None, hint_chars: int = 800) -> DataFrame:
    """Title, description, body, publication day and what proves it, for every page (columns url, html)."""
    page, url = F.col("page"), F.col("url")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    nodes = linked_data(page["data"])
    node_days = F.filter(F.transform(nodes, lambda n: dates.date_text(n["datePublished"])), lambda d: d.isNotNull())
    stated = F.coalesce(last(node_days), last(meta_dates(page)))
    seen = F.try_element_at(visible_dates(page, urls.host(url)), F.lit(1))
    coded = dates.url_date(urls.host(url), urls.path(url))
    head = F.substring(el.all_text(page), 1, hint_chars)
    described = F.filter(F.transform(nodes, lambda n: F.coalesce(n["description"], F.lit(""))), lambda d: d != "")
    abstract = F.regexp_replace(
        el.text_of(page, el.first(page, lambda n: (n["tag"] == "blockquote") & el.classed("abstract")(n))), r"^\s*Abstract:\s*", ""
    )
    rows = pages.withColumn("page", el.tree(F.col("html"))).select(
        *keep,
        text.squash(el.text_of(page, el.first(page, el.tagged("title")))).alias("title"),
        F.coalesce(
            F.when(urls.host(url).isin(*fixed.PAPER_HOSTS) & (abstract != ""), abstract),
            F.when(meta_description(page) != "", meta_description(page)),
            F.try_element_at(described, F.lit(1)),
            F.lit(""),
        ).alias("summary"),
        body_text(page, limit).alias("body"),
        stated.alias("stated"), seen.alias("seen"), coded.alias("coded"), head.alias("head"),
    )
    evidence = (
        F.when(F.col("stated").isNotNull(), F.lit("article_meta"))
        .when(F.col("seen").isNotNull(), F.lit("article_visible"))
        .when(F.col("coded").isNotNull(), F.lit("url"))
        .when(dates.date_hint(F.col("head")), F.lit("hint_unparsed"))
        .otherwise(F.lit("no_date_hint"))
    )
    return rows.select(
        *keep, "title", "summary", "body", F.coalesce("stated", "seen", "coded").alias("published"), evidence.alias("date_evidence"),
        F.regexp_extract("body", fixed.REPOST_ORIGIN, 1).alias("origin"),
    )


def absolute(base: Column, href: Column) -> Column:
    """Address of a link found on a page."""
    root = F.concat(urls.scheme(base), F.lit("://"), urls.netloc(base))
    folder = F.regexp_replace(urls.path(base), r"[^/]*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(urls.scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )


#: Links and cards of a listing whose source names none.
DEFAULT_LINKS = [el.selector(tag="a", attribute="href", inside_tag="article")]

SOURCE_COLUMNS = f"links array<{el.SELECTOR_TYPE}>, containers array<{el.SELECTOR_TYPE}>, date_rule string, dated_urls_only boolean"


def listing_sources(spark, rows: list[dict]) -> DataFrame:
    """The table of listing sources: source_id, links and containers (selectors), date_rule (card, stated, grouped),
    dated_urls_only (links without a day in their address are left out)."""
    data = [
        (r["source_id"], r.get("links") or DEFAULT_LINKS, r.get("containers") or [], r.get("date_rule", "card"), r.get("dated_urls_only", False)) for r in rows
    ]
    return spark.createDataFrame(data, f"source_id string, {SOURCE_COLUMNS}")


def _with_sources(listings: DataFrame, sources: DataFrame | None) -> DataFrame:
    usual = F.lit(None).cast(f"array<{el.SELECTOR_TYPE}>")
    links = F.array(*[F.struct(*[F.lit(v).cast("string") for v in s]) for s in DEFAULT_LINKS]).cast(f"array<{el.SELECTOR_TYPE}>")
    if sources is None:
        joined = listings.withColumn("links", usual).withColumn("containers", usual).withColumn("date_rule", F.lit("card")).withColumn("dated_urls_only", F.lit(False))
    else:
        joined = listings.join(sources, "source_id", "left")
    none = F.array().cast(f"array<{el.SELECTOR_TYPE}>")
    return joined.withColumn("links", F.coalesce("links", links)).withColumn("containers", F.coalesce("containers", none)).fillna("card", ["date_rule"]).fillna(False, ["dated_urls_only"])


def _card_day(page: Column, card: Column, rule: Column) -> Column:
    """The day a card states for itself: in its text and time elements, in date elements only, or under its month's heading."""
    last = lambda nodes: F.try_element_at(_days(page, nodes), F.lit(-1))
    times = el.below(page, card, el.tagged("time"))
    by_attribute = F.filter(F.transform(times, lambda n: dates.date_text(el.attribute(n, "datetime"))), lambda d: d.isNotNull())
    stated = el.below(page, card, lambda n: (n["tag"] == "time") | el.classed("date")(n) | el.classed("publish-time")(n))
    month = F.try_element_at(el.select(page, lambda n: el.classed("bw-group")(n) & (n["first"] < card["first"])), F.lit(-1))
    label = F.try_element_at(
        el.below(page, card, lambda n: (n["tag"] == "span") & F.exists(page["nodes"], lambda a: el.inside(n, a) & el.classed("bw-card__meta")(a))), F.lit(1)
    )
    return (
        F.when(rule == "grouped", text.given(el.text_of(page, month), lambda m: text.given(el.text_of(page, label), lambda d: dates.grouped_card_date(m, d))))
        .when(rule == "stated", last(stated))
        .otherwise(F.coalesce(F.try_element_at(by_attribute, F.lit(-1)), text.given(el.text_of(page, card), dates.date_text)))
    )


def listing_articles(listings: DataFrame, keep: list[str], sources: DataFrame | None = None, per_page: int | None = 100, climb: int = 5, blocked_chars: int = 1500) -> DataFrame:
    """One row per distinct link of a listing page (columns url, html, and source_id if sources are given), in page order.

    A link's card is the largest of its `climb` nearest ancestors that holds no other link, but no larger than one that
    is a container or states a day. So days and summaries are never borrowed from a neighbour. Of repeated links the
    first day and the longest summary are kept.
    """
    page, url, rule = F.col("page"), F.col("url"), F.col("date_rule")
    read = _with_sources(listings, sources).withColumn("page", el.tree(F.col("html")))
    opening = F.substring(el.all_text(page), 1, blocked_chars)
    blocked = F.lit(False)
    for phrase in fixed.BLOCKED_PAGES:
        blocked = blocked | opening.contains(phrase)
    read, page = el.pruned(read.filter(~blocked), "page", el.tagged(*fixed.LISTING_CHROME))
    found = F.transform(
        el.chosen(page["nodes"], F.col("links")),
        lambda n: F.struct(n.alias("node"), text.given(text.given(el.attribute(n, "href"), lambda h: absolute(url, h)), urls.canonical).alias("href")),
    )
    read = read.withColumn("found", found).withColumn("boxes", F.transform(el.chosen(page["nodes"], F.col("containers")), lambda n: n["first"]))
    rows = read.select(*keep, "url", "page_nodes", "page_texts", "found", "boxes", "date_rule", "dated_urls_only", F.posexplode("found").alias("position", "link"))
    link, href = F.col("link.node"), F.col("link.href")
    coded = dates.url_date(urls.host(href), urls.path(href))
    rows = rows.withColumn("coded", coded).filter((href != "") & (href != urls.canonical(url)) & (~F.col("dated_urls_only") | F.col("coded").isNotNull()))

    around = F.slice(F.reverse(el.select(page, lambda a: (a["first"] < link["first"]) & (a["last"] >= link["last"]))), 1, climb)
    place = lambda n, done: F.struct(n["first"].alias("first"), n["last"].alias("last"), done.alias("done"))

    def step(card: Column, parent: Column) -> Column:
        shared = F.exists(F.col("found"), lambda x: el.inside(x["node"], parent) & (x["href"] != href))
        closed = F.array_contains(F.col("boxes"), parent["first"]) | text.given(el.text_of(page, parent), dates.date_text).isNotNull()
        return F.when(card["done"], card).when(shared, place(card, F.lit(True))).otherwise(place(parent, closed))

    climbed = F.aggregate(around, place(link, F.lit(False)), step)
    article = F.filter(around, lambda a: (a["tag"] == "article") & el.classed("bw-card")(a))
    own = F.when((rule == "grouped") & (F.size(article) > 0), place(F.try_element_at(article, F.lit(1)), F.lit(True))).otherwise(climbed)
    rows = rows.withColumn("card", own)
    card = F.col("card")
    named = el.below(page, link, lambda n: n["tag"].rlike("^h[1-6]$") | el.attribute(n, "class").contains("_h3") | el.attribute(n, "class").contains("post-title"))
    heading, label = F.try_element_at(named, F.lit(1)), el.attribute(link, "title")
    paragraphs = F.transform(el.below(page, card, el.tagged("p")), lambda n: el.text_of(page, n))
    longest = F.array_sort(F.transform(paragraphs, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p"))))
    summary = F.coalesce(F.try_element_at(longest, F.lit(1))["p"], F.lit(""))
    told = F.try_element_at(el.below(page, card, el.classed("bw-card__summary")), F.lit(1))
    summary = F.when((rule == "grouped") & told.isNotNull(), el.text_of(page, told)).otherwise(summary)
    rows = rows.select(
        *keep, "position", href.alias("href"),
        F.when(heading.isNotNull(), el.text_of(page, heading)).when(label != "", label).otherwise(el.text_of(page, link)).alias("title"),
        F.substring(summary, 1, 2000).alias("summary"), "coded", _card_day(page, card, rule).alias("listed"), dates.date_hint(el.text_of(page, card)).alias("hinted"),
    ).filter(F.length("title").between(8, 300))
    day = F.coalesce("coded", "listed")
    proof = F.when(F.col("coded").isNotNull(), F.lit("url")).when(F.col("listed").isNotNull(), F.lit("listing"))
    hint = F.when(F.col("hinted"), F.lit("hint_unparsed")).otherwise(F.lit("no_date_hint"))
    at = F.col("position")
    merged = rows.groupBy(*keep, "href").agg(
        F.min(at).alias("position"),
        F.min_by("title", at).alias("title"),
        F.min_by(day, F.when(day.isNotNull(), at)).alias("published"),
        F.max_by("summary", F.struct(F.length("summary"), -at)).alias("summary"),
        # the first proof, else what the last sighting hints at
        F.coalesce(F.min_by(proof, F.when(proof.isNotNull(), at)), F.max_by(hint, at)).alias("date_evidence"),
    )
    if per_page is None:
        return merged
    w = Window.partitionBy(*keep).orderBy("position")
    return merged.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_page).drop("n")


def account_pages(pages: DataFrame, keep: list[str], limit: int | None = None, least_chars: int = 30) -> DataFrame:
    """Pages of the shared account host: title, author, day and body of at least `least_chars` characters."""
    page, url = F.col("page"), F.col("url")
    by_id = lambda i: el.first(page, lambda n: n["id"] == i)
    gone = el.select(page, lambda n: n["tag"].isin(*fixed.ACCOUNT_SILENT))
    content = by_id("js_content")
    texts = F.filter(
        page["texts"],
        lambda t: (t["at"] > content["first"]) & (t["at"] <= content["last"]) & ~F.exists(gone, lambda g: (t["at"] >= g["first"]) & (t["at"] <= g["last"])),
    )
    body = F.array_join(F.transform(texts, lambda t: t["text"]), "\n")
    epoch = F.regexp_extract("html", r"""\b(?:var\s+)?(?:ct|create_time)\s*[:=]\s*['"]?(\d{10})\b""", 1)
    stamped = F.when(epoch != "", dates.beijing_day(F.timestamp_seconds(epoch.try_cast("long"))))
    described = el.first(page, lambda n: (n["tag"] == "meta") & (el.attribute(n, "property") == "og:description"))
    valid = (
        (urls.scheme(url) == "https") & (urls.netloc(url).isin(fixed.SHARED_ACCOUNT_HOST, fixed.SHARED_ACCOUNT_HOST + ":443"))
        & urls.path(url).rlike(r"^/s(/|$)")
    )
    read = pages.filter(valid).withColumn("page", el.tree(F.col("html"))).filter(content.isNotNull() & by_id("activity-name").isNotNull())
    return read.select(
        *keep,
        el.text_of(page, by_id("activity-name")).alias("title"),
        F.when(by_id("js_name").isNotNull(), el.text_of(page, by_id("js_name"))).otherwise(F.lit("微信公众号")).alias("source"),
        F.coalesce(dates.date_text(el.text_of(page, by_id("publish_time"), "")), stamped).alias("published"),
        F.coalesce(el.attribute(described, "content"), F.lit("")).alias("summary"),
        (body if limit is None else F.substring(body, 1, limit)).alias("body"),
    ).filter(F.length("body") >= least_chars)
