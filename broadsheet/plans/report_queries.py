"""Finished editions as text and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions import text
from broadsheet.operators import coverage, quotas, reports
from broadsheet.plans import dimensions as dim
from broadsheet.plans.registry import query
from broadsheet.plans.rule_queries import CHANNEL_ITEMS, GATE_SQL, INTERESTS, channel_items
from broadsheet.plans.selection_queries import (
    CHANNEL_PICKS, SCORED, SELECT_SQL, _profile_table, channel_assessed, channel_runs, final_order, scored_items,
)
from broadsheet.plans.tables import ARTICLES, ASSESSMENTS, articles, first_word, with_sql

_STARS = """repeat('★', (h // 2)::INT) || CASE WHEN h % 2 = 1 THEN '☆' ELSE '' END"""
# the line of the summary, which a title without a word does not have
_WORD = r"regexp_extract(a.title, '(\p{L}{3,})', 1)"
_FIRST_WORD = f"CASE WHEN {_WORD} = '' THEN '' WHEN length({_WORD}) <= 100 THEN {_WORD} || chr(10) ELSE left({_WORD}, 99) || '…' || chr(10) END"
_ESCAPED = r"replace(regexp_replace(title, '([\\`*_\[\]<>])', '\\\1', 'g'), chr(10), ' ')"


@query(
    "briefing_text",
    with_sql(ARTICLES, ASSESSMENTS, GATE_SQL, SCORED, SELECT_SQL)
    + f""", ranked AS (SELECT edition_day, profile_id, x.id AS id, x.category AS category, x.published AS published, greatest(0, least(10, floor(x.ranking / 10 + 0.5)))::INT AS h,
        row_number() OVER (PARTITION BY edition_day, profile_id ORDER BY x.ranking DESC, x.shortlist DESC, x.identity DESC) AS n FROM picks),
      blocks AS (SELECT r.edition_day, r.profile_id, n, '**' || n || '. [' || r.category || '] ' || {_ESCAPED} || '**' || chr(10) || '推荐指数：' || {_STARS} || chr(10)
        || r.published || ' · ' || a.source || chr(10) || {_FIRST_WORD} || '（来源：' || a.source || '）[原文](' || a.url || ')' AS block
        FROM ranked r JOIN articles a ON a.doc_id = r.id::BIGINT)
    SELECT edition_day, profile_id, 'Daily | ' || edition_day || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY n) AS body FROM blocks GROUP BY edition_day, profile_id""",
)
def briefing_text(spark, sf_dir):
    picks = quotas.select_edition(scored_items(spark, sf_dir)).select("edition_day", "profile_id", "id", "category", "ranking", "pick_rank")
    facts = articles(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("id"), "title", "url", "published", first_word(F.col("title")).alias("summary"),
        F.array("source").alias("tags"), F.array("source").alias("source_names"), F.lit("").alias("display_title"), F.lit(None).cast("date").alias("event_date"),
        F.lit("listing").alias("date_evidence"), F.lit(False).alias("exploration"), F.lit("").alias("product_url"),
    )
    return reports.briefings(picks.join(facts, "id"), "Daily").select("edition_day", "profile_id", "body")


def channel_picks(spark, sf_dir):
    rows = quotas.cut(channel_assessed(spark, sf_dir))
    picked = quotas.keyword_coverage(rows, ["profile_id", "channel_id"], _profile_table(spark), 3, final_order())
    facts = channel_items(spark, sf_dir).select(F.col("doc_id").alias("id"), "url")
    return picked.join(rows.select("profile_id", "channel_id", "id", "title", "source", "final_score", "matched_keywords"), ["profile_id", "channel_id", "id"]).join(facts, "id")


_CHANNEL = with_sql(ARTICLES, CHANNEL_ITEMS, INTERESTS, ASSESSMENTS, CHANNEL_PICKS)


@query(
    "digest_text",
    _CHANNEL
    + """, lines AS (SELECT p.profile_id, p.channel_id, p.pick_rank, p.pick_rank || '. ' || a.title || chr(10) || '推荐理由：' || a.source || chr(10) || a.source || chr(10) || a.url AS line
        FROM picks p JOIN articles a ON a.doc_id = p.id),
      sections AS (SELECT profile_id, channel_id, '📚 ' || channel_id || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY pick_rank) AS section FROM lines GROUP BY profile_id, channel_id)
    SELECT profile_id, string_agg(section, chr(10) || chr(10) ORDER BY CASE channel_id WHEN 'academic' THEN 2 WHEN 'blogs' THEN 3 WHEN 'products' THEN 4 WHEN 'news' THEN 5 WHEN 'security' THEN 6 END) AS digest
    FROM sections GROUP BY profile_id""",
)
def digest_text(spark, sf_dir):
    return reports.digest_lines(channel_picks(spark, sf_dir).withColumn("reason", F.col("source")).withColumn("digest", F.col("source")))


@query(
    "report_records",
    _CHANNEL
    + """SELECT p.profile_id, p.channel_id, s.n AS scanned, count(*) AS n_items, string_agg(p.id::VARCHAR, '|' ORDER BY p.pick_rank) AS ids FROM picks p
      JOIN (SELECT profile_id, channel_id, count(*) AS n FROM best GROUP BY ALL) s USING (profile_id, channel_id) GROUP BY ALL""",
)
def report_records(spark, sf_dir):
    records = reports.report_records(channel_runs(spark, sf_dir), channel_picks(spark, sf_dir))
    return records.select(
        "profile_id", "channel_id", "scanned", F.size("items").cast("long").alias("n_items"),
        F.array_join(F.transform("items", lambda r: r["id"].cast("string")), "|").alias("ids"),
    )


@query(
    "preview_rows",
    _CHANNEL
    + """SELECT p.profile_id, p.channel_id, p.pick_rank AS rank, p.id, CASE WHEN p.channel_id = 'products' THEN a.source ELSE '' END AS product_name,
      CASE WHEN p.channel_id = 'products' THEN a.title ELSE '' END AS version, 'Watch' AS recommendation,
      CASE WHEN p.channel_id <> 'products' THEN a.title WHEN a.source = 'src1' THEN 'First Product：' || a.title WHEN a.source = 'src2' THEN 'Second Product：' || a.title ELSE a.source || '：' || a.title END AS shown
    FROM picks p JOIN articles a ON a.doc_id = p.id""",
)
def preview_rows(spark, sf_dir):
    picks = channel_picks(spark, sf_dir).withColumn("recommendation", F.lit("关注"))
    rows = reports.preview_rows(picks, english=True)
    shown = text.display_title(F.col("channel_id"), F.col("title"), F.col("source"), F.col("source"), dim.PRODUCT_NAMES)
    named = picks.select("profile_id", "channel_id", "id", shown.alias("shown"))
    return rows.drop("title", "url").join(named, ["profile_id", "channel_id", "id"])


@query(
    "channel_catalogue",
    with_sql(ARTICLES, CHANNEL_ITEMS) + "SELECT channel_id, count(DISTINCT source) AS source_count FROM items GROUP BY channel_id",
)
def channel_catalogue(spark, sf_dir):
    return coverage.channel_catalogue(channel_items(spark, sf_dir))


@query(
    "channel_status",
    with_sql(ARTICLES, CHANNEL_ITEMS)
    + """SELECT source AS channel_id, CASE WHEN scanned = 0 AND errors > 0 THEN 'error' ELSE 'ok' END AS status FROM
      (SELECT source, count(*) FILTER (WHERE len(content) > 4000) AS scanned, count(*) FILTER (WHERE len(content) <= 4000) AS errors FROM items GROUP BY source)""",
)
def channel_status(spark, sf_dir):
    """Sources as one-source channels: long entries were scanned, short ones stand for failed reads."""
    long = F.length("content") > 4000
    channels = channel_items(spark, sf_dir).groupBy(F.col("source").alias("channel_id")).agg(
        F.count_if(long).alias("scanned_count"), F.count_if(~long).alias("errors_count"), F.first("source").alias("title")
    )
    return coverage.channel_status(channels.withColumn("expected_sources", F.lit(1))).select("channel_id", "status")


@query(
    "scored_records",
    with_sql(ARTICLES, ASSESSMENTS, GATE_SQL, SCORED)
    + f"SELECT edition_day, id, ranking, {_STARS} AS stars FROM (SELECT *, greatest(0, least(10, floor(ranking / 10 + 0.5)))::INT AS h FROM scored)",
)
def scored_records(spark, sf_dir):
    return reports.scored_records(scored_items(spark, sf_dir)).select("edition_day", "id", "ranking", "stars")
