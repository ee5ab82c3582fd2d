"""Repository snapshots: personal relevance, picks and rank history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import text
from broadsheet.operators import gates, matching


def score(repos: DataFrame, profile: dict, readme: str | None = None) -> DataFrame:
    """Relevance, matched interests, recommendation and reason for one profile."""
    about = F.coalesce(F.col(readme), F.lit("")) if readme else F.lit("")
    places = [
        (F.concat_ws(" ", "name", F.array_join("topics", " ")), 30), (F.coalesce("description", F.lit("")), 20), (F.substring(about, 1, 3000), 8)
    ]
    scored = repos.withColumn("_s", matching.score_against([{"profile_id": "", **profile}], places)[0])
    barred = F.size("_s.excluded") > 0
    points = (
        F.col("_s.points")
        - F.when(barred, 35).otherwise(0)
        + F.least(F.lit(20), F.floor(F.col("stars_today") / 50))
        + F.greatest(F.lit(0), 6 - F.least(F.col("rank"), F.lit(6)))
        + F.when(F.col("license") != "", 5).otherwise(0)
    )
    out = scored.withColumn("relevance_score", F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("int"))
    matched, excluded = F.col("_s.matched"), F.col("_s.excluded")
    return (
        out.withColumn("matched_interests", matched)
        .withColumn("recommendation", recommendation(F.col("relevance_score"), F.size(matched) > 0, barred))
        .withColumn("why", reason(matched, excluded, F.col("stars_today"), F.col("rank")))
        .drop("_s")
    )


def recommendation(value: Column, matched: Column, barred: Column) -> Column:
    return (
        F.when(barred | ~matched, F.lit(fixed.SKIP))
        .when(value >= 50, F.lit(fixed.EXPLORE))
        .when(value >= 20, F.lit(fixed.WATCH))
        .otherwise(F.lit(fixed.SKIP))
    )


def reason(matched: Column, excluded: Column, today: Column, rank: Column) -> Column:
    join = lambda a, n: F.array_join(F.slice(a, 1, n), "、")
    also = F.when(F.size(matched) > 0, F.concat(F.lit("；虽命中 "), join(matched, 2))).otherwise(F.lit(""))
    return (
        F.when(F.size(excluded) > 0, F.concat(F.lit("命中过滤词："), join(excluded, 2), also, F.lit("，仍降低推荐。")))
        .when(
            F.size(matched) > 0,
            F.concat(F.lit("命中你的关注词："), join(matched, 3), F.lit("；今日新增约 "), text.thousands(today), F.lit(" Stars。")),
        )
        .otherwise(F.concat(F.lit("与关注词匹配较弱；因 Trending 排名第 "), rank.cast("string"), F.lit(" 暂时保留观察。")))
    )


def picks(scored: DataFrame, edition: list[str], wanted: int) -> DataFrame:
    """Best recommended repositories of every edition with ``pick_rank``."""
    w = Window.partitionBy(*edition).orderBy(F.desc("relevance_score"), "rank")
    kept = scored.filter(F.col("recommendation") != fixed.SKIP)
    return kept.withColumn("pick_rank", F.row_number().over(w)).filter(F.col("pick_rank") <= max(1, wanted))


def rank_change(previous: Column, rank: Column) -> Column:
    delta = previous - rank
    return (
        F.when(previous.isNull(), F.lit("NEW"))
        .when(delta > 0, F.concat(F.lit("↑"), delta.cast("string")))
        .when(delta < 0, F.concat(F.lit("↓"), (-delta).cast("string")))
        .otherwise(F.lit("—"))
    )


def rank_history(snapshots: DataFrame) -> DataFrame:
    """Rank in the directly preceding snapshot and the change since, for all days in one pass.

    Snapshot days are few, so their order is a small table; the ranks meet by equality on repository and
    snapshot number rather than by a search through time.
    """
    days = snapshots.select("snapshot_day").distinct()
    # One row per snapshot day: the single-partition window orders days, not repositories.
    numbered = days.withColumn("day_no", F.row_number().over(Window.orderBy("snapshot_day")))
    current = snapshots.join(numbered, "snapshot_day")
    w = Window.partitionBy("full_name").orderBy("day_no")
    before = F.lag(F.struct("day_no", "rank")).over(w)
    previous = F.when(before["day_no"] == F.col("day_no") - 1, before["rank"])
    return (
        current.withColumn("previous_rank", previous)
        .withColumn("is_new", F.col("previous_rank").isNull())
        .withColumn("rank_change", rank_change(F.col("previous_rank"), F.col("rank")))
        .drop("day_no")
    )


def fallback_summary(repos: DataFrame, english: bool = False) -> DataFrame:
    """Summary, highlights, category and use case for repositories nobody assessed."""
    topics = F.array_join(F.slice("topics", 1, 4), ", " if english else "、")
    seen = F.lower(F.concat_ws(" ", "name", "description", "language", F.array_join("topics", " ")))
    bare = F.regexp_replace(F.trim("description"), r"[。.]+$", "")
    if english:
        plain = F.concat(F.lit("An open-source project primarily written in "), "language")
        lines = [
            F.concat(F.lit("About "), text.thousands(F.col("stars_today")), F.lit(" new Stars today")),
            F.concat(F.lit("Primary language: "), "language"),
            F.when(topics != "", F.concat(F.lit("Topics: "), topics)),
        ]
    else:
        plain = F.concat(F.lit("一个以 "), "language", F.lit(" 为主的开源项目"))
        lines = [
            F.concat(F.lit("今日新增约 "), text.thousands(F.col("stars_today")), F.lit(" Stars")),
            F.concat(F.lit("主要语言："), "language"),
            F.when(topics != "", F.concat(F.lit("关键词："), topics)),
        ]
    chinese_category = gates.repository_category(seen)
    return (
        repos.withColumn("summary", F.when(bare != "", bare).otherwise(plain))
        .withColumn("highlights", F.filter(F.array(*lines), lambda x: x.isNotNull()))
        .withColumn("category", gates.repository_category(seen, english))
        .withColumn("use_cases", F.array(gates.repository_use_case(chinese_category, english)))
    )


def data_line(stars: Column, today: Column, forks: Column, language: Column, license_name: Column) -> Column:
    parts = [
        F.concat(F.lit("⭐ "), text.thousands(stars)),
        F.concat(F.lit("今日 +"), text.thousands(today)),
        F.concat(F.lit("Fork "), text.thousands(forks)),
        F.when((language != "") & (F.lower(language) != "unknown"), language),
        F.when((license_name != "") & ~F.lower(license_name).isin(*fixed.UNLISTED_LICENSES), license_name),
    ]
    return F.array_join(reduce(lambda a, b: F.concat(a, b), [F.filter(F.array(p), lambda x: x.isNotNull()) for p in parts]), " · ")
