"""Feed documents held in a table, parsed with Spark's XML functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import dates, text

OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
_LINKS = "array<struct<_href:string,_rel:string,_VALUE:string>>"
_CATEGORIES = "array<struct<_term:string,_VALUE:string>>"
RSS = (
    "channel struct<item:array<struct<guid:string,title:string,link:" + _LINKS + ",description:string,"
    "encoded:string,category:" + _CATEGORIES + ",pubDate:string,date:string,creator:array<string>,author:array<string>>>>"
)
ATOM = (
    "entry array<struct<id:string,title:string,link:" + _LINKS + ",summary:string,content:string,"
    "published:string,updated:string,category:" + _CATEGORIES + ",author:array<struct<name:string>>>>"
)


def _text(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def link(links: Column) -> Column:
    """First alternate address, or the text of the element."""
    options = F.transform(
        links,
        lambda x: F.when(
            (_text(x["_href"]) != "") & (F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), _text(x["_href"])
        ).when(_text(x["_VALUE"]) != "", _text(x["_VALUE"])),
    )
    return F.coalesce(F.try_element_at(F.filter(options, lambda o: o.isNotNull()), F.lit(1)), F.lit(""))


def _tags(categories: Column) -> Column:
    said = F.transform(categories, lambda c: _text(c["_VALUE"]))
    terms = F.transform(categories, lambda c: _text(c["_term"]))
    return text.ordered_unique(F.coalesce(F.concat(said, terms), F.array().cast("array<string>")))


def _first_time(*values: Column) -> Column:
    return F.coalesce(*[dates.feed_timestamp(v) for v in values])


def _common(entry: dict[str, Column]) -> list[Column]:
    summary, content = text.strip_tags(entry["summary"]), text.strip_tags(entry["content"])
    whole = F.array_join(text.ordered_unique(F.array(summary, content)), "\n\n")
    return [
        F.when(entry["id"] != "", entry["id"]).otherwise(entry["url"]).alias("entry_id"),
        text.strip_tags(entry["title"]).alias("title"),
        entry["url"].alias("url"),
        summary.alias("summary"),
        whole.alias("content"),
        text.ordered_unique(entry["authors"]).alias("authors"),
        entry["tags"].alias("tags"),
        "published_at",
    ]


def rss_entries(feeds: DataFrame, first_day: Column, last_day: Column, keep: list[str]) -> DataFrame:
    """Entries of RSS documents published inside a closed Beijing-day window.

    feeds: ``keep`` columns and ``xml``. The window is applied before any text is cleaned; undated entries drop.
    """
    parsed = feeds.select(*keep, F.explode(F.from_xml("xml", RSS, OPTIONS)["channel"]["item"]).alias("e"))
    dated = parsed.withColumn("published_at", _first_time(F.col("e.pubDate"), F.col("e.date"))).filter(
        dates.in_closed_days(F.col("published_at"), first_day, last_day)
    )
    none = F.array().cast("array<string>")
    entry = {
        "id": _text(F.col("e.guid")), "title": _text(F.col("e.title")), "url": link(F.col("e.link")),
        "summary": _text(F.col("e.description")), "content": _text(F.col("e.encoded")),
        "authors": F.concat(F.coalesce("e.author", none), F.coalesce("e.creator", none)), "tags": _tags(F.col("e.category")),
    }
    return dated.select(*keep, *_common(entry)).filter("title != '' AND url != ''")


def atom_entries(feeds: DataFrame, first_day: Column, last_day: Column, keep: list[str]) -> DataFrame:
    """Entries of Atom documents; the publication date wins over the update date."""
    parsed = feeds.select(*keep, F.explode(F.from_xml("xml", ATOM, OPTIONS)["entry"]).alias("e"))
    dated = parsed.withColumn("published_at", _first_time(F.col("e.published"), F.col("e.updated"))).filter(
        dates.in_closed_days(F.col("published_at"), first_day, last_day)
    )
    authors = F.coalesce(F.transform("e.author", lambda a: _text(a["name"])), F.array().cast("array<string>"))
    entry = {
        "id": _text(F.col("e.id")), "title": _text(F.col("e.title")), "url": link(F.col("e.link")),
        "summary": _text(F.col("e.summary")), "content": _text(F.col("e.content")),
        "authors": authors, "tags": _tags(F.col("e.category")),
    }
    return dated.select(*keep, *_common(entry)).filter("title != '' AND url != ''")


def paper_entries(feeds: DataFrame, today: Column, lookback: int, keep: list[str]) -> DataFrame:
    """Papers whose version date is proven: zoned submission and revision times in order and in the window."""
    e = F.explode(F.from_xml("xml", ATOM, OPTIONS)["entry"]).alias("e")
    zoned = r"(?:Z|[+-]\d{2}:?\d{2})$"
    first_raw, revised_raw = _text(F.col("e.published")), _text(F.col("e.updated"))
    rows = (
        feeds.select(*keep, e)
        .filter(first_raw.rlike(zoned) & revised_raw.rlike(zoned))
        .withColumn("first", dates.feed_timestamp(first_raw))
        .withColumn("revised", dates.feed_timestamp(revised_raw))
        .filter("first <= revised")
        .withColumn("revised_day", dates.utc_day(F.col("revised")))
        .filter(F.col("revised_day").between(F.date_sub(today, max(0, lookback - 1)), today))
    )
    pattern = r"^https?://(?:www\.)?arxiv\.org/abs/([^/?#]+?)(v\d+)?$"
    number = F.regexp_extract(_text(F.col("e.id")), pattern, 1)
    version = F.regexp_extract(_text(F.col("e.id")), pattern, 2)
    first_version = F.when(F.col("first") == F.col("revised"), F.lit("v1")).otherwise(F.lit(""))
    return rows.filter(number != "").select(
        *keep,
        text.squash(_text(F.col("e.title"))).alias("title"),
        F.concat(F.lit("https://arxiv.org/abs/"), number).alias("url"),
        text.squash(_text(F.col("e.summary"))).alias("summary"),
        F.col("revised_day").alias("published"),
        dates.utc_day(F.col("first")).alias("first_submitted"),
        F.col("revised_day").alias("last_revised"),
        F.when(version != "", version).otherwise(first_version).alias("version"),
        F.lit("arxiv_version").alias("date_evidence"),
    ).filter("title != '' AND summary != ''")
