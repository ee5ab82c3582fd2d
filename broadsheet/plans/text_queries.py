"""Scalar library over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import dates, text, urls
from broadsheet.plans.registry import query
from broadsheet.plans.tables import ARTICLES, articles, load, sql_normal, sql_title_key, with_sql

_PAIRS = """list_filter(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'),
    lambda s: s <> ''), lambda s: {'k': split_part(s, '=', 1), 'v': CASE WHEN contains(s, '=') THEN substr(s, instr(s, '=') + 1) ELSE '' END}),
    lambda p: NOT starts_with(lower(p.k), 'utm_') AND lower(p.k) NOT IN ('fbclid', 'gclid', 'spm'))"""


@query(
    "canonical_urls",
    f"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme,
        lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS netloc,
        regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
        list_aggregate(list_transform({_PAIRS}, lambda p: p.k || '=' || p.v), 'string_agg', '&') AS q FROM pages),
      c AS (SELECT page_id, scheme || '://' || netloc || CASE WHEN path = '' THEN '/' ELSE path END
        || CASE WHEN coalesce(q, '') = '' THEN '' ELSE '?' || q END AS canonical FROM p)
    SELECT page_id, canonical, sha256(canonical) AS identity FROM c WHERE canonical <> ''""",
)
def canonical_urls(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))
    return pages.filter("canonical != ''").withColumn("identity", text.digest(F.col("canonical")))


@query(
    "host_keys",
    """WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM pages),
      l AS (SELECT page_id, host, string_split(host, '.') AS parts FROM h)
    SELECT page_id, host, regexp_replace(host, '^www\\.', '') AS publisher,
      CASE WHEN len(parts) >= 3 AND parts[-2] || '.' || parts[-1] IN ('com.cn', 'co.uk', 'com.hk')
           THEN parts[-3] || '.' || parts[-2] || '.' || parts[-1]
           WHEN len(parts) >= 2 THEN parts[-2] || '.' || parts[-1] ELSE host END AS root FROM l""",
)
def host_keys(spark, sf_dir):
    host = urls.host(F.col("url"))
    return load(spark, sf_dir, "pages").select(
        "page_id",
        host.alias("host"),
        urls.publisher_key(F.col("url"), F.lit("")).alias("publisher"),
        urls.root_domain(host).alias("root"),
    )


@query(
    "title_keys",
    f"""SELECT doc_id, k AS title_key, sha256('title:' || k) AS alias, n AS normal, len(k)::INT AS key_length
    FROM (SELECT doc_id, {sql_title_key("split_part(text, chr(10), 1)")} AS k,
          {sql_normal("split_part(text, chr(10), 1)")} AS n FROM documents)""",
)
def title_keys(spark, sf_dir):
    title = F.split("text", "\n")[0]
    key = text.title_key(title)
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        key.alias("title_key"),
        text.digest(F.concat(F.lit("title:"), key)).alias("alias"),
        text.normalize(title).alias("normal"),
        F.length(key).alias("key_length"),
    )


_DATED = """(CASE doc_id % 8
   WHEN 0 THEN 'seen 2024-' || (doc_id % 14) || '-' || (doc_id % 33) || ' by ' || source
   WHEN 1 THEN '2024年' || (doc_id % 12 + 1) || '月' || (doc_id % 28 + 1) || '日 ' || source
   WHEN 2 THEN 'posted ' || ['January', 'Feb', 'Mar', 'April', 'May', 'Junk'][doc_id % 6 + 1] || ' ' || (doc_id % 30 + 1) || ', 2023 end'
   WHEN 3 THEN (doc_id % 30 + 1) || ' ' || ['Sep', 'October', 'Nov', 'Dec'][doc_id % 4 + 1] || ' 2022'
   WHEN 4 THEN 'updated ' || (doc_id % 12 + 1) || '月' || (doc_id % 28 + 1) || '日'
   WHEN 5 THEN '2024/2/' || (doc_id % 31 + 1)
   ELSE split_part(text, chr(10), 1) END)"""


def _dated_text():
    """Date phrases of every supported shape, valid and not, derived from the documents."""
    n = F.col("doc_id")
    s = lambda c: c.cast("string")
    pick = lambda names, m: F.element_at(F.array(*[F.lit(x) for x in names]), (n % m + 1).cast("int"))
    return (
        F.when(n % 8 == 0, F.concat(F.lit("seen 2024-"), s(n % 14), F.lit("-"), s(n % 33), F.lit(" by "), F.col("source")))
        .when(n % 8 == 1, F.concat(F.lit("2024年"), s(n % 12 + 1), F.lit("月"), s(n % 28 + 1), F.lit("日 "), F.col("source")))
        .when(n % 8 == 2, F.concat(F.lit("posted "), pick(["January", "Feb", "Mar", "April", "May", "Junk"], 6), F.lit(" "), s(n % 30 + 1), F.lit(", 2023 end")))
        .when(n % 8 == 3, F.concat(s(n % 30 + 1), F.lit(" "), pick(["Sep", "October", "Nov", "Dec"], 4), F.lit(" 2022")))
        .when(n % 8 == 4, F.concat(F.lit("updated "), s(n % 12 + 1), F.lit("月"), s(n % 28 + 1), F.lit("日")))
        .when(n % 8 == 5, F.concat(F.lit("2024/2/"), s(n % 31 + 1)))
        .otherwise(F.split("text", "\n")[0])
    )


@query(
    "date_extraction",
    f"""WITH t AS (SELECT doc_id, {_DATED} AS phrase FROM documents),
    n AS (SELECT doc_id, phrase, regexp_extract(phrase, '(20\\d{{2}})[-/.年](\\d{{1,2}})[-/.月](\\d{{1,2}})', ['y', 'm', 'd']) AS p,
        regexp_extract(phrase, '\\b([A-Za-z]{{3,9}}) (\\d{{1,2}}), (\\d{{4}})\\b', ['m', 'd', 'y']) AS a,
        regexp_extract(phrase, '\\b(\\d{{1,2}}) ([A-Za-z]{{3,9}}) (\\d{{4}})\\b', ['d', 'm', 'y']) AS b FROM t)
    SELECT doc_id, coalesce(
        try_cast(CASE WHEN p.y <> '' THEN p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') END AS DATE),
        try_strptime(a.m || ' ' || a.d || ' ' || a.y, ['%B %d %Y', '%b %d %Y'])::DATE,
        try_strptime(b.d || ' ' || b.m || ' ' || b.y, ['%d %B %Y', '%d %b %Y'])::DATE) AS found_day,
      regexp_matches(phrase, '20\\d{{2}}[-/年]\\d{{1,2}}[-/月]\\d{{1,2}}|(^|\\D)\\d{{1,2}}[-/月]\\d{{1,2}}(日|\\b)') AS hinted
    FROM n""",
)
def date_extraction(spark, sf_dir):
    phrase = _dated_text()
    return load(spark, sf_dir, "documents").select(
        "doc_id", dates.date_text(phrase).alias("found_day"), dates.date_hint(phrase).alias("hinted")
    )


@query(
    "date_quotes",
    f"""WITH t AS (SELECT doc_id, {_DATED} AS quote, DATE '2024-01-01' + (doc_id % 40)::INT AS page_day,
        DATE '2024-01-01' + (doc_id % 28)::INT AS event_day FROM documents),
    n AS (SELECT *, regexp_extract(quote, '(20\\d{{2}})[-/.年](\\d{{1,2}})[-/.月](\\d{{1,2}})', ['y', 'm', 'd']) AS p,
        regexp_extract(quote, '\\b([A-Za-z]{{3,9}}) (\\d{{1,2}}), (\\d{{4}})\\b', ['m', 'd', 'y']) AS a,
        regexp_extract(quote, '\\b(\\d{{1,2}}) ([A-Za-z]{{3,9}}) (\\d{{4}})\\b', ['d', 'm', 'y']) AS b FROM t)
    SELECT doc_id, coalesce(coalesce(
        try_cast(CASE WHEN p.y <> '' THEN p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') END AS DATE),
        try_strptime(a.m || ' ' || a.d || ' ' || a.y, ['%B %d %Y', '%b %d %Y'])::DATE,
        try_strptime(b.d || ' ' || b.m || ' ' || b.y, ['%d %B %Y', '%d %b %Y'])::DATE) = event_day, FALSE)
      OR regexp_matches(quote, month(event_day) || '\\s*月\\s*' || day(event_day) || '\\s*日?')
      OR regexp_matches(quote, '(^|\\D)' || lpad(month(event_day)::VARCHAR, 2, '0') || '[-/.]' || lpad(day(event_day)::VARCHAR, 2, '0') || '($|\\D)')
      OR contains(quote, event_day::VARCHAR) AS supported
    FROM n""",
)
def date_quotes(spark, sf_dir):
    n = F.col("doc_id")
    start = F.to_date(F.lit("2024-01-01"))
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        dates.quote_supports(
            F.date_add(start, (n % 28).cast("int")), _dated_text(), F.date_add(start, (n % 40).cast("int"))
        ).alias("supported"),
    )


@query(
    "display_rules",
    with_sql(ARTICLES)
    + r"""SELECT doc_id, len(s) >= 12 AND s <> trim(title) AND len(regexp_replace(s, '[^A-Za-z一-鿿]', '', 'g')) >= 8
          AND lower(s) NOT IN ('doc', 'pdf', 'read more', 'click here') AND NOT starts_with(s, 'Abstract page for arXiv paper')
          AND NOT regexp_matches(s, '^[\d.+\-$]') AS usable,
        CASE WHEN len(trim(summary)) <= 40 THEN trim(summary) ELSE rtrim(substr(trim(summary), 1, 39)) || '…' END AS cut,
        replace(regexp_replace(title, '([\\`*_\[\]<>])', '\\\1', 'g'), chr(10), ' ') AS escaped
    FROM (SELECT *, trim(regexp_replace(summary, '\s+', ' ', 'g')) AS s FROM articles)""",
)
def display_rules(spark, sf_dir):
    return articles(spark, sf_dir).select(
        "doc_id",
        text.usable_summary(F.col("summary"), F.col("title")).alias("usable"),
        text.truncate(F.col("summary"), 40).alias("cut"),
        text.escape_markdown(F.col("title")).alias("escaped"),
    )


@query(
    "shortened_text",
    with_sql(ARTICLES)
    + r"""SELECT doc_id, len(t)::INT AS whole_length, CASE WHEN len(t) <= 100 THEN t END AS short_form, TRUE AS within_limit
    FROM (SELECT doc_id, trim(regexp_replace(body, '\s+', ' ', 'g')) AS t FROM articles)""",
)
def shortened_text(spark, sf_dir):
    """Both shortenings of every body: short texts stay whole, long ones keep the limit (forms tested on vectors)."""
    body = F.col("body")
    base = articles(spark, sf_dir).select(
        "doc_id", text.squash(body).alias("t"), text.shorten(body).alias("short"), text.fit(body).alias("fitted")
    )
    whole = F.length("t") <= 100
    return base.select(
        "doc_id", F.length("t").alias("whole_length"), F.when(whole, F.col("short")).alias("short_form"),
        ((F.length("short") <= 100) & (F.length("fitted") <= 100)).alias("within_limit"),
    )


@query(
    "title_facts",
    with_sql(ARTICLES)
    + r"""SELECT doc_id, array_to_string(regexp_extract_all(body, '(\d+(?:\.\d+)?)', 1), '|') AS numbers,
        regexp_matches(lower(title || ' ' || source), 'weekly|week in review|roundup|digest|newsletter|周报|周刊|一周(要闻|回顾)|合集|资讯汇总') AS aggregate_page,
        len(string_split(trim(regexp_replace(body, '\s+', ' ', 'g')), ' '))::INT AS words
    FROM articles""",
)
def title_facts(spark, sf_dir):
    return articles(spark, sf_dir).select(
        "doc_id",
        F.array_join(text.numbers(F.col("body")), "|").alias("numbers"),
        F.concat_ws(" ", "title", "source").rlike(fixed.AGGREGATE_PAGE).alias("aggregate_page"),
        F.size(F.split(text.squash(F.col("body")), " ")).alias("words"),
    )


@query(
    "item_aliases",
    with_sql(ARTICLES)
    + f"""SELECT doc_id, sha256('url:' || url) AS alias FROM articles
    UNION SELECT doc_id, sha256('title:' || {sql_title_key("title")}) FROM articles""",
)
def item_aliases(spark, sf_dir):
    keys = text.aliases(F.col("title"), F.col("summary"), F.col("category"), F.array("url"))
    return articles(spark, sf_dir).select("doc_id", F.explode(keys).alias("alias"))
