"""JSON payloads and search rows held in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import dates, urls

_ARTICLE = "struct<title:string,link:string,create_time:string>"
ACCOUNT_PAYLOAD = (
    f"articles array<{_ARTICLE}>, list array<struct<articles:array<{_ARTICLE}>>>, "
    f"data struct<list:array<struct<articles:array<{_ARTICLE}>>>>"
)
POLICY_LIST = "array<struct<TITLE:string,URL:string,DOCRELPUBTIME:string,SUB_TITLE:string>>"


def account_articles(payloads: DataFrame, keep: list[str]) -> DataFrame:
    """Articles of account replies in any of the three known shapes (column payload)."""
    p = F.from_json("payload", ACCOUNT_PAYLOAD)
    nested = lambda boxes: F.flatten(
        F.filter(F.transform(boxes, lambda b: b["articles"]), lambda a: a.isNotNull())
    )
    rows = payloads.select(*keep, p.alias("p")).select(
        *keep, F.explode(F.coalesce("p.articles", nested(F.col("p.data.list")), nested(F.col("p.list")))).alias("a")
    )
    seconds = F.col("a.create_time").try_cast("double")
    return rows.select(
        *keep,
        F.trim(F.coalesce("a.title", F.lit(""))).alias("title"),
        F.trim(F.coalesce("a.link", F.lit(""))).alias("url"),
        F.timestamp_seconds(seconds).alias("published_at"),
    ).filter("title != '' AND url != '' AND published_at IS NOT NULL")


def distinct_links(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with the first occurrence of every link."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r"))
    return first.select(key, "r.*")


def policy_list(payloads: DataFrame, keep: list[str], per_payload: int = 100) -> DataFrame:
    """Rows of official JSON lists; the list's leading rows are the publication's own newest page."""
    rows = payloads.select(*keep, F.posexplode(F.slice(F.from_json("payload", POLICY_LIST), 1, per_payload)).alias("position", "r"))
    when = F.coalesce("r.DOCRELPUBTIME", F.lit(""))
    found = dates.date_text(when)
    return rows.select(
        *keep, "position",
        F.col("r.TITLE").alias("title"),
        urls.canonical(F.col("r.URL")).alias("url"),
        F.coalesce("r.SUB_TITLE", F.lit("")).alias("summary"),
        found.alias("published"),
        F.when(found.isNotNull(), F.lit("api")).when(dates.date_hint(when), F.lit("hint_unparsed")).otherwise(
            F.lit("no_date_hint")
        ).alias("date_evidence"),
    )


def search_articles(rows: DataFrame, keep: list[str], domain: Column | None = None) -> DataFrame:
    """Search-result rows (title, link, publish_date, content, media) as articles."""
    addressed = rows.withColumn("_url", urls.canonical(F.coalesce("link", F.lit("")))).filter("_url != ''")
    hosted = addressed.withColumn("_host", urls.host(F.col("_url"))).withColumn("_when", F.coalesce("publish_date", F.lit("")))
    kept = hosted.filter(
        ~urls.under_any(F.col("_host"), fixed.DICTIONARY_DOMAINS) & (F.coalesce("title", F.lit("")) != "")
    )
    if domain is not None:
        kept = kept.filter((domain == "") | _below(F.col("_host"), domain))
    dated = kept.withColumn("_stated", dates.date_text(F.col("_when"))).withColumn(
        "_coded", dates.url_date(F.col("_host"), urls.path(F.col("_url")))
    )
    return dated.select(
        *keep,
        F.substring("title", 1, 250).alias("title"),
        F.col("_url").alias("url"),
        F.coalesce("_stated", "_coded").alias("published"),
        F.when(F.coalesce("media", F.lit("")) != "", F.col("media")).otherwise(F.col("_host")).alias("source"),
        F.substring(F.coalesce("content", F.lit("")), 1, 2000).alias("summary"),
        F.when(F.col("_stated").isNotNull(), F.lit("search")).when(F.col("_coded").isNotNull(), F.lit("url")).when(
            dates.date_hint(F.col("_when")), F.lit("hint_unparsed")
        ).otherwise(F.lit("no_date_hint")).alias("date_evidence"),
    )


def _below(host: Column, domain: Column) -> Column:
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def unwrapped_news(rows: DataFrame, domain: Column | None = None) -> DataFrame:
    """Feed rows behind a news wrapper, under their real address and publisher; what stays wrapped drops."""
    opened = rows.withColumn("url", urls.unwrap(F.col("url"))).filter("url != ''").withColumn("source", urls.host(F.col("url")))
    return opened if domain is None else opened.filter(_below(F.col("source"), domain))


def broad_listing_reads(rows: DataFrame, source: list[str], order: str, limit: int = 6) -> DataFrame:
    """Undated rows of a broad listing that are directly relevant and worth opening, first few per source."""
    seen = F.concat(F.col("title"), F.lit(" "), F.substring("summary", 1, 500))
    hits = rows.filter(F.col("published").isNull() & seen.rlike(fixed.BROAD_LISTING_TERMS))
    w = Window.partitionBy(*source).orderBy(order)
    return hits.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).drop("n")


