"""Dates found in text, URLs and feeds; calendar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed

MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december", *MONTHS,
]


def day(year: Column, month: Column, day_of_month: Column) -> Column:
    """A date, or NULL where the parts name no calendar day."""
    text = F.concat(
        F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day_of_month, 2, "0")
    )
    return F.try_to_date(text, "yyyy-MM-dd")


def _month_number(name: Column) -> Column:
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    numbers = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    short = F.substring(F.lower(name), 1, 3)
    return F.when(F.array_contains(names, F.lower(name)), F.try_element_at(numbers, short)).cast("string")


def _english(text: Column, pattern: str, month: int, dom: int, year: int) -> Column:
    """First match of an English date that names a real day."""
    split = r"([A-Za-z]{3,9}) (\d{1,2}), (\d{4})" if month == 1 else r"(\d{1,2}) ([A-Za-z]{3,9}) (\d{4})"
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    days = F.transform(
        found,
        lambda m: day(
            F.regexp_extract(m, split, year),
            _month_number(F.regexp_extract(m, split, month)),
            F.regexp_extract(m, split, dom),
        ),
    )
    return F.try_element_at(F.filter(days, lambda d: d.isNotNull()), F.lit(1))


def date_text(text: Column) -> Column:
    """The publication day stated in free text, numeric forms first, NULL when none is valid."""
    part = lambda i: F.regexp_extract(text, fixed.NUMERIC_DATE, i)
    numeric = day(part(1), part(2), part(3))
    return F.coalesce(
        numeric,
        _english(text, fixed.MONTH_FIRST_DATE, 1, 2, 3),
        _english(text, fixed.DAY_FIRST_DATE, 2, 1, 3),
    )


def date_hint(text: Column) -> Column:
    return text.rlike(fixed.DATE_HINT)


def url_date(host: Column, path: Column) -> Column:
    """Day encoded in the two known article path formats."""
    digits = (
        F.when(host.endswith(".eastmoney.com"), F.regexp_extract(path, r"^/a/(20\d{6})\d+\.html$", 1))
        .when(
            host.isin("chinaventure.com.cn", "www.chinaventure.com.cn"),
            F.regexp_extract(path, r"^/news/\d+-(20\d{6})-\d+\.html$", 1),
        )
        .otherwise(F.lit(""))
    )
    return day(F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))


def grouped_card_date(group_text: Column, card_text: Column) -> Column:
    """Month/day of a listing card under a 'year month' heading, only when the months agree."""
    heading = r"(20\d{2})\s*年\s*(\d{1,2})\s*月"
    year = F.regexp_extract(group_text, heading, 1)
    month = F.regexp_extract(group_text, heading, 2)
    card = r"^\s*(\d{1,2})[-/]\s*(\d{1,2})\s*$"
    card_month, card_day = F.regexp_extract(card_text, card, 1), F.regexp_extract(card_text, card, 2)
    agrees = (month != "") & (month.try_cast("int") == card_month.try_cast("int"))
    return F.when(agrees, day(year, card_month, card_day))


def feed_timestamp(text: Column) -> Column:
    """RFC 822 or ISO 8601 text as a UTC instant; a missing zone means UTC."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},?\s+", "")
    bare = F.regexp_replace(bare, r"\s+(?:GMT|UTC|UT|Z)$", " +0000")
    rfc = F.coalesce(
        *[
            F.try_to_timestamp(F.regexp_replace(bare, r"\s+", " "), F.lit(p))
            for p in ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm")
        ]
    )
    iso = F.regexp_replace(F.trim(text), r"(\d)Z$", "$1+00:00")
    zoned = iso.rlike(r"(?:[+-]\d{2}:?\d{2})$")
    shaped = iso.rlike(r"^\d{4}-\d{2}-\d{2}")
    utc = F.when(zoned | ~shaped, iso).otherwise(
        F.when(F.length(iso) > 10, F.concat(iso, F.lit("+00:00"))).otherwise(F.concat(iso, F.lit("T00:00:00+00:00")))
    )
    return F.coalesce(rfc, F.when(shaped, utc.try_cast("timestamp")))


def beijing_day(instant: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, fixed.BEIJING))


def utc_day(instant: Column) -> Column:
    return F.to_date(instant)


def in_closed_days(instant: Column, first: Column, last: Column) -> Column:
    """Closed Beijing-day window."""
    return beijing_day(instant).between(first, last)


def ordinal(day_column: Column) -> Column:
    return F.datediff(day_column, F.to_date(F.lit(fixed.ORDINAL_ORIGIN))) + 1


def news_day(event_day: Column, first_reported: Column, published: Column) -> Column:
    return F.coalesce(event_day, first_reported, published)


def age_days(today: Column, value: Column) -> Column:
    return F.datediff(today, value)


def in_window(today: Column, value: Column, days: Column) -> Column:
    """Half-open calendar window; undated and future values are outside."""
    age = age_days(today, value)
    return F.coalesce((age >= 0) & (age < days), F.lit(False))


def quote_supports(event_day: Column, quote: Column, page_day: Column) -> Column:
    """Does a quoted snippet prove the event day, given the page's own dated header?"""
    m, d = F.month(event_day), F.dayofmonth(event_day)
    relative_today = quote.rlike(r"今天|今日|当日|本日") & (event_day == page_day)
    relative_yesterday = quote.rlike(r"昨天|昨日") & (event_day == F.date_sub(page_day, 1))
    month_day = F.concat(m.cast("string"), F.lit(r"\s*月\s*"), d.cast("string"), F.lit(r"\s*日?"))
    short = F.concat(
        F.lit(r"(?<!\d)"), F.lpad(m.cast("string"), 2, "0"), F.lit(r"[-/.]"),
        F.lpad(d.cast("string"), 2, "0"), F.lit(r"(?!\d)"),
    )
    return F.coalesce(
        (date_text(quote) == event_day), F.lit(False)
    ) | F.coalesce(relative_today, F.lit(False)) | F.coalesce(relative_yesterday, F.lit(False)) | F.coalesce(
        F.rlike(quote, month_day) | F.rlike(quote, short) | quote.contains(F.date_format(event_day, "yyyy-MM-dd")),
        F.lit(False),
    )


def claims_known_day(text: Column, first_reported: Column, evidence: Column) -> Column:
    """Text about an undated item that nevertheless names its discovery day."""
    year, m, d = (f(first_reported).cast("string") for f in (F.year, F.month, F.dayofmonth))
    short = F.concat(m, F.lit("月"), d, F.lit("日"))
    named = (
        text.contains(F.date_format(first_reported, "yyyy-MM-dd"))
        | text.contains(F.concat(year, F.lit("年"), short))
        | text.contains(short)
    )
    said = text.rlike(r"今日|今天|当日|本日") | F.coalesce(named, F.lit(False))
    return F.coalesce(evidence == "recent_first_seen", F.lit(False)) & said
