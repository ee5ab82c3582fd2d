"""Text and nested-record forms of finished editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import text


def _safe_link(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit(")"), F.lit("%29")), F.lit("("), F.lit("%28"))


def source_names(names: Column) -> Column:
    """At most five distinct publisher names in first-mention order."""
    return F.slice(F.array_distinct(names), 1, 5)


def item_lines() -> Column:
    """Block of one briefing item from its columns."""
    c = F.col
    title = F.when(c("display_title") != "", c("display_title")).otherwise(c("title"))
    day = F.coalesce(
        F.date_format("event_date", "yyyy-MM-dd"),
        F.when(c("date_evidence") == "recent_first_seen", F.lit("近期")).otherwise(F.date_format("published", "yyyy-MM-dd")),
    )
    tags = F.array_join(F.transform(F.slice("tags", 1, 3), text.escape_markdown), "／")
    links = F.concat(
        F.lit("[原文]("), _safe_link(c("url")), F.lit(")"),
        F.when(c("product_url") != "", F.concat(F.lit(" [查看产品页]("), _safe_link(c("product_url")), F.lit(")"))).otherwise(F.lit("")),
    )
    names = F.array_join(F.transform(source_names(c("source_names")), text.escape_markdown), "、")
    return F.array_join(
        F.filter(
            F.array(
                F.concat(F.lit("**"), c("pick_rank").cast("string"), F.lit(". ["), c("category"), F.lit("] "), text.escape_markdown(title), F.lit("**")),
                F.concat(F.lit("推荐指数："), text.stars(c("ranking"))),
                F.concat(day, F.lit(" · "), tags, F.when(c("exploration"), F.lit(" · 探索")).otherwise(F.lit(""))),
                F.when(c("summary") != "", text.escape_markdown(text.shorten(c("summary")))),
                F.concat(F.lit("（来源："), names, F.lit("）"), links),
            ),
            lambda line: line.isNotNull(),
        ),
        "\n",
    )


def briefings(picks: DataFrame, heading: str) -> DataFrame:
    """One text per edition (at most MAX_ITEMS blocks, so the collected list is bounded) and its length check.

    A text over the limit is reported as too long; it is never cut.
    """
    blocks = picks.filter(F.col("pick_rank") <= fixed.MAX_ITEMS).withColumn("block", item_lines())
    grouped = blocks.groupBy("edition_day", "profile_id").agg(
        F.array_sort(F.collect_list(F.struct("pick_rank", "block"))).alias("b")
    )
    title = F.concat(F.lit(heading + " | "), F.date_format("edition_day", "yyyy-MM-dd"))
    body = F.concat(title, F.lit("\n\n"), F.array_join(F.transform("b", lambda r: r["block"]), "\n\n"))
    return grouped.select(
        "edition_day", "profile_id", title.alias("title"), body.alias("body"), (F.length(body) > fixed.BRIEFING_LIMIT).alias("too_long")
    )


def section_position(channel: Column) -> Column:
    """Fixed section order; unknown sections come last."""
    out = F.lit(len(fixed.SECTION_ORDER))
    for i, name in enumerate(fixed.SECTION_ORDER):
        out = F.when(channel == name, F.lit(i)).otherwise(out)
    return out


def digest_lines(picks: DataFrame) -> DataFrame:
    """One digest text per profile: channels in fixed order, picks in rank order."""
    line = F.concat_ws(
        "\n",
        F.concat(F.col("pick_rank").cast("string"), F.lit(". "), F.col("title")),
        F.concat(F.lit("推荐理由："), F.col("reason")),
        F.substring("digest", 1, 120),
        F.col("url"),
    )
    per_channel = picks.groupBy("profile_id", "channel_id").agg(
        F.array_sort(F.collect_list(F.struct("pick_rank", line.alias("line")))).alias("rows")
    )
    section = F.concat(F.lit("📚 "), F.col("channel_id"), F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n\n"))
    ordered = per_channel.select("profile_id", section_position(F.col("channel_id")).alias("p"), "channel_id", section.alias("section"))
    return ordered.groupBy("profile_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("p", "channel_id", "section"))), lambda r: r["section"]), "\n\n"
        ).alias("digest")
    )


def report_records(runs: DataFrame, picks: DataFrame) -> DataFrame:
    """One nested record per profile and channel: counters and its picks, ready for a JSON writer."""
    items = picks.groupBy("profile_id", "channel_id").agg(
        F.array_sort(F.collect_list(F.struct("pick_rank", "id", "title", "url", "final_score"))).alias("items")
    )
    return runs.join(items, ["profile_id", "channel_id"], "left")


def preview_rows(picks: DataFrame, english: bool) -> DataFrame:
    """Flat picks with product name and version for release channels and localised labels."""
    products = F.col("channel_id") == "products"
    labels = F.create_map(*[F.lit(x) for pair in fixed.RECOMMENDATION_ENGLISH.items() for x in pair])
    label = F.coalesce(F.try_element_at(labels, F.col("recommendation")), F.col("recommendation")) if english else F.col("recommendation")
    return picks.select(
        "profile_id", "channel_id", F.col("pick_rank").alias("rank"), "id", "title", "url",
        F.when(products, text.product_name(F.col("source"))).otherwise(F.lit("")).alias("product_name"),
        F.when(products, F.col("title")).otherwise(F.lit("")).alias("version"),
        label.alias("recommendation"),
    )


def scored_records(picks: DataFrame) -> DataFrame:
    """Briefing records with their score columns and star text."""
    return picks.withColumn("stars", text.stars(F.col("ranking")))
