"""Counts that describe a run: date coverage, failures, funnels, quality issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import scores


def date_coverage(parsed: DataFrame, source: str) -> DataFrame:
    """Per source: rows parsed, dated at listing, rate, undated by kind, rows kept and dated after the window.

    parsed: source, published, date_evidence, kept (inside the freshness window or undated).
    """
    dated = F.col("published").isNotNull()
    counts = parsed.groupBy(source).agg(
        F.count(F.lit(1)).alias("parsed"),
        F.count_if(dated).alias("dated_at_listing"),
        F.count_if(F.col("date_evidence") == "hint_unparsed").alias("hint_unparsed"),
        F.count_if(F.col("date_evidence") == "no_date_hint").alias("no_date_hint"),
        F.count_if("kept").alias("returned"),
        F.count_if(F.col("kept") & dated).alias("dated"),
    )
    return counts.withColumn("date_rate_pct", scores.rounded(F.col("dated_at_listing") * 100 / F.col("parsed"), 1))


def with_failures(coverage: DataFrame, failures: DataFrame, source: str) -> DataFrame:
    """Failed and deferred sources as rows of zeros beside the successful ones."""
    zero = [F.lit(0).cast("long").alias(c) for c in ("parsed", "dated_at_listing", "hint_unparsed", "no_date_hint", "returned", "dated")]
    failed = failures.select(source, *zero, F.lit(None).cast("double").alias("date_rate_pct"), "status", "error_type")
    ok = coverage.withColumn("status", F.lit("ok")).withColumn("error_type", F.lit(""))
    return ok.unionByName(failed)


def with_detail_checks(coverage: DataFrame, checks: DataFrame, source: str) -> DataFrame:
    """Outcome of opening undated items' pages, joined by source. checks: source, status, dated."""
    status = F.col("status")
    detail = checks.groupBy(source).agg(
        F.count(F.lit(1)).alias("detail_checked"),
        F.count_if("dated").alias("detail_date_resolved"),
        F.count_if(status == "hint_unparsed").alias("detail_hint_unparsed"),
        F.count_if(status == "no_date_hint").alias("detail_no_date_hint"),
        F.count_if(status == "read_failed").alias("detail_read_failed"),
    )
    joined = coverage.join(detail, source, "left")
    return joined.fillna(0, [c for c in detail.columns if c != source])


def source_probe(items: DataFrame, source: str, order: str) -> DataFrame:
    """Parsed, dated and relevant rows per source with one sample, a relevant row when there is one."""
    relevant = F.size("matches") > 0
    sample = F.struct("title", "url", "published")
    return items.groupBy(source).agg(
        F.count(F.lit(1)).alias("parsed"),
        F.count_if(F.col("published").isNotNull()).alias("dated"),
        F.count_if(relevant).alias("relevant"),
        F.min_by(sample, F.struct((~relevant).alias("m"), F.col(order))).alias("sample"),
    )


def selection_funnel(items: DataFrame, edition: list[str]) -> DataFrame:
    """Per edition: pool, eligible, accepted, and the category mix of what was analysed."""
    mix = [
        F.count_if(F.col("analysed") & (F.col("category") == c)).alias(f"analysed_{name}")
        for c, name in zip(fixed.CATEGORIES, ("industry", "capital", "policy", "academic"))
    ]
    return items.groupBy(*edition).agg(
        F.count(F.lit(1)).alias("pool"), F.count_if("eligible").alias("eligible"), F.count_if("accepted").alias("accepted"), *mix
    )


def issues_by_stage(issues: DataFrame) -> DataFrame:
    return issues.groupBy("day", "stage", "detail").agg(F.count(F.lit(1)).alias("n"))


def channel_status(channels: DataFrame) -> DataFrame:
    """A channel has failed only when nothing was scanned and every expected source reported an error."""
    failed = (
        (F.col("errors_count") > 0) & (F.col("scanned_count") == 0)
        & (F.col("errors_count") >= F.greatest("expected_sources", F.lit(1)))
    )
    return channels.withColumn("status", F.when(failed, F.lit("error")).otherwise(F.lit("ok"))).withColumn(
        "message", F.when(failed, F.concat("title", F.lit("的上游来源暂时不可用"))).otherwise(F.lit(""))
    )


def channel_catalogue(sources: DataFrame) -> DataFrame:
    return sources.groupBy("channel_id").agg(F.count_distinct("source").alias("source_count"))
