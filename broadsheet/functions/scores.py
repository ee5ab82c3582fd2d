"""Scores as column expressions; every one stays inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import dates, text, urls


def rounded(value: Column, digits: int) -> Column:
    """A double rounded by its exact binary value, true ties to the even digit.

    The product with the power of ten is taken with its rounding error (split in halves of 26 bits), which decides
    when the rounded product looks like a tie.
    """
    scale = float(10**digits)
    value = value.cast("double")
    wide = value * F.lit(134217729.0)
    high = wide - (wide - value)
    product = value * F.lit(scale)
    error = (high * F.lit(scale) - product) + (value - high) * F.lit(scale)
    whole = F.floor(product)
    over = product - whole.cast("double") - F.lit(0.5)
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (whole % 2 != 0))))
    return (whole + up.cast("int")).cast("double") / F.lit(scale)


def sql_rounded(value: str, digits: int) -> str:
    """The same as DuckDB SQL."""
    s = f"{10**digits}::DOUBLE"
    x = f"(({value})::DOUBLE)"
    high = f"({x} * 134217729 - ({x} * 134217729 - {x}))"
    over = f"({x} * {s} - floor({x} * {s}) - 0.5::DOUBLE)"
    error = f"(({high} * {s} - {x} * {s}) + ({x} - {high}) * {s})"
    return (
        f"((floor({x} * {s}) + CASE WHEN {over} > 0 OR ({over} = 0 AND ({error} > 0 OR ({error} = 0 AND "
        f"floor({x} * {s}) % 2 <> 0))) THEN 1 ELSE 0 END) / {s})"
    )


def freshness(today: Column, value: Column, tiers=fixed.FRESHNESS_TIERS) -> Column:
    age = dates.age_days(today, value)
    out = F.lit(0.0)
    for upper, factor in reversed(tiers):
        out = F.when(age < upper, F.lit(float(factor))).otherwise(out)
    inside = F.coalesce((age >= 0) & (age < fixed.FRESHNESS_LIMIT_DAYS), F.lit(False))
    return F.when(inside, out).otherwise(F.lit(0.0))


def configured_rating(host: Column, ratings=fixed.DOMAIN_RATINGS) -> Column:
    """struct(authority, recognition) of the longest configured suffix of a host, or NULL.

    A rating table that grows is joined instead (operators.reputation).
    """
    pairs = [
        part
        for domain, (authority, recognition) in ratings.items()
        for part in (
            F.lit(domain),
            F.struct(F.lit(float(authority)).alias("authority"), F.lit(float(recognition)).alias("recognition")),
        )
    ]
    table = F.create_map(*pairs)
    hits = F.filter(
        F.transform(urls.host_suffixes(host), lambda s: F.try_element_at(table, s)), lambda r: r.isNotNull()
    )
    return F.try_element_at(hits, F.lit(1))


def source_factor(url: Column, kind: Column, authority: Column, recognition: Column,
                  ratings=fixed.DOMAIN_RATINGS) -> Column:
    """Stored publisher rating when there is one, else kind, government, paper and domain defaults."""

    def default(i: int, host: Column, configured: Column) -> Column:
        by_kind = F.lit(0.0)
        for name, values in fixed.KIND_RATINGS.items():
            by_kind = F.when(kind == name, F.lit(float(values[i]))).otherwise(by_kind)
        by_host = F.when(host.isin(*fixed.PAPER_HOSTS), F.lit(float(fixed.PAPER_RATING[i]))).when(
            urls.government(host), F.lit(float(fixed.GOV_RATING[i]))
        )
        return F.coalesce(configured["authority" if i == 0 else "recognition"], by_host, by_kind)

    def factor(host: Column, configured: Column) -> Column:
        stored = authority.isNotNull() & recognition.isNotNull()
        a = F.when(stored, authority.cast("double")).otherwise(default(0, host, configured))
        r = F.when(stored, recognition.cast("double")).otherwise(default(1, host, configured))
        return (a * fixed.AUTHORITY_WEIGHT + r * fixed.RECOGNITION_WEIGHT) / 100

    return text.given(urls.host(url), lambda host: text.given(configured_rating(host, ratings), lambda configured: factor(host, configured)))


def publisher_rating(url: Column, ratings=fixed.DOMAIN_RATINGS) -> Column:
    """struct(authority, recognition, basis) for a publisher met for the first time."""
    host = urls.host(url)
    configured = configured_rating(host, ratings)

    def row(authority, recognition, basis: str) -> Column:
        return F.struct(
            (authority if isinstance(authority, Column) else F.lit(float(authority))).alias("authority"),
            (recognition if isinstance(recognition, Column) else F.lit(float(recognition))).alias("recognition"),
            F.lit(fixed.RATING_BASIS[basis]).alias("basis"),
        )

    under = lambda d: (host == d) | host.endswith("." + d)
    return (
        F.when(configured.isNotNull(), row(configured["authority"], configured["recognition"], "configured"))
        .when(urls.government(host), row(100, 85, "government"))
        .when(host.endswith(".edu.cn") | host.endswith(".ac.cn"), row(80, 45, "campus"))
        .when(host == fixed.SHARED_ACCOUNT_HOST, row(40, 40, "account"))
        .when(under("sohu.com") | host.endswith(".163.com"), row(40, 60, "platform"))
        .when(under("china.com"), row(45, 60, "reprint"))
        .when(host != "", row(50, 40, "new"))
        .otherwise(row(0, 0, "none"))
    )


def category_factor(category: Column, weights=fixed.DEFAULT_CATEGORY_WEIGHTS) -> Column:
    out = F.lit(1.0)
    for name, weight in weights.items():
        out = F.when(category == name, F.lit(float(weight))).otherwise(out)
    return out


def topic_factor(category: Column, text: Column, factor: float = fixed.EEG_WITHOUT_EMOTION_FACTOR) -> Column:
    lower = (category == fixed.ACADEMIC) & text.rlike(fixed.EEG_WORDS) & ~text.rlike(fixed.EMOTION_WORDS)
    return F.when(lower, F.lit(factor)).otherwise(F.lit(1.0))


def effective_relevance(base: Column, category: Column, topic_text: Column,
                        weights=fixed.DEFAULT_CATEGORY_WEIGHTS) -> Column:
    weighted = base.cast("double") * category_factor(category, weights) * topic_factor(category, topic_text)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), weighted))


def shortlist_score(effective: Column, fresh: Column) -> Column:
    return rounded(effective * fresh, 4)


def ranking_score(effective: Column, factor: Column) -> Column:
    return rounded(effective * factor, 4)


def business_score(priority: Column, relevance: Column) -> Column:
    """Highest rule weight, blended with an assessed relevance when present."""
    bounded = F.greatest(F.lit(0), F.least(F.lit(100), relevance))
    return F.when(relevance.isNull(), priority.cast("double")).otherwise(
        rounded(priority * 0.6 + bounded * 0.4, 2)
    )


def combined_score(status: Column, rule: Column, relevance: Column, novelty: Column) -> Column:
    assessed = (relevance * 0.6 + novelty * 0.4) * 10
    return F.when(status == "ai", rounded(rule * 0.4 + assessed * 0.6, 2)).otherwise(rule.cast("double"))


def policy_authority(hosts: Column) -> Column:
    """1.0 national origin, 0.8 local origin or listed media, 0.7 otherwise."""
    national_roots = [d for d in fixed.NATIONAL_POLICY_HOSTS if d not in ("gov.cn", "www.gov.cn")]
    national = F.exists(
        hosts, lambda h: h.isin("gov.cn", "www.gov.cn") | urls.under_any(h, national_roots)
    )
    local = F.exists(
        hosts, lambda h: h.endswith(".gov.cn") | urls.under_any(h, fixed.LOCAL_POLICY_MEDIA)
    )
    return F.when(national, F.lit(1.0)).when(local, F.lit(0.8)).otherwise(F.lit(0.7))


def estimated_relevance(text: Column, top_weight: Column) -> Column:
    """Score of the first hint whose patterns all match, else the top rule weight, else the default."""
    hints = [
        F.when(
            reduce(lambda a, b: a & b, [text.rlike(f"(?i){p}") for p in patterns]), F.lit(score)
        )
        for score, patterns in fixed.PRIORITY_HINTS
    ]
    return F.coalesce(*hints, top_weight, F.lit(fixed.DEFAULT_RELEVANCE)).cast("int")


def queue_estimate(relevance: Column, fresh: Column, published: Column) -> Column:
    return F.when(published.isNull(), F.lit(0.0)).otherwise(relevance * fresh)


def source_priority(url: Column, authority: Column, recognition: Column) -> Column:
    return source_factor(url, F.lit("secondary"), authority, recognition)


def date_priority(first_reported: Column, published: Column) -> Column:
    return F.coalesce(dates.ordinal(F.coalesce(first_reported, published)), F.lit(0))
