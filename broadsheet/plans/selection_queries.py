"""Ranking and selection of items per edition and per channel."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import scores, text
from broadsheet.operators import gates, matching, planning, quotas
from broadsheet.plans import dimensions as dim
from broadsheet.plans.registry import query
from broadsheet.plans.rule_queries import (
    CHANNEL_ITEMS, GATE_SQL, INTERESTS, assessed, channel_items,
)
from broadsheet.plans.tables import ARTICLES, ASSESSMENTS, sql_host, with_sql


def scored_items(spark, sf_dir):
    """Accepted articles with both stage scores per edition they can appear in."""
    gated = gates.apply_assessment(assessed(spark, sf_dir)).filter("accepted AND published IS NOT NULL")
    none = F.lit(None).cast("double")
    once = F.struct(
        "effective", scores.source_factor(F.col("url"), F.col("source_kind"), none, none).alias("source_factor"),
        gates.company_keys(F.col("title"), F.col("summary"), F.col("companies")).alias("companies"), text.digest(F.col("url")).alias("identity"),
    )
    # A generated column: what an article has once is not computed again for its editions and the filter on its scores.
    rated = gated.withColumn("r", F.explode(F.array(once)))
    days = F.sequence("published", F.date_add("published", fixed.LOOKBACK_DAYS - 1))
    editions = rated.withColumn("edition_day", F.explode(days))
    fresh = scores.freshness(F.col("edition_day"), F.col("published"))
    return editions.select(
        "edition_day", "profile_id", F.col("doc_id").cast("string").alias("id"), "title", "url", "source", "category",
        "r.companies",
        F.col("published").alias("day"), "published", fresh.alias("freshness"),
        "r.source_factor", "r.effective",
        scores.shortlist_score(F.col("r.effective"), fresh).alias("shortlist"),
        scores.ranking_score(F.col("r.effective"), F.col("r.source_factor")).alias("ranking"),
        "r.identity",
    ).filter("shortlist > 0 AND ranking > 0")


_H = sql_host("url")
SCORED = f"""hosted AS (SELECT *, {_H} AS host FROM gate WHERE accepted AND published IS NOT NULL),
rated AS (SELECT *, CASE WHEN regexp_matches(host, '(^|\\.)gov\\.cn$') THEN 100 WHEN regexp_matches(host, '(^|\\.)stcn\\.com$') THEN 85
      WHEN regexp_matches(host, '(^|\\.)arxiv\\.org$') THEN 70
      ELSE CASE source_kind WHEN 'original' THEN 85 WHEN 'media' THEN 80 WHEN 'secondary' THEN 60 ELSE 0 END END::DOUBLE AS authority,
    CASE WHEN regexp_matches(host, '(^|\\.)gov\\.cn$') THEN 95 WHEN regexp_matches(host, '(^|\\.)stcn\\.com$') THEN 85
      WHEN regexp_matches(host, '(^|\\.)arxiv\\.org$') THEN 85
      ELSE CASE source_kind WHEN 'original' THEN 60 WHEN 'media' THEN 70 WHEN 'secondary' THEN 50 ELSE 0 END END::DOUBLE AS recognition FROM hosted),
scored AS (SELECT *, {scores.sql_rounded('effective * freshness', 4)} AS shortlist, {scores.sql_rounded('effective * source_factor', 4)} AS ranking,
    sha256(url) AS identity, doc_id::VARCHAR AS id, published AS day,
    list_sort(list_distinct(CASE WHEN len(word) >= 2 THEN [replace(lower(word), 'ß', 'ss')] ELSE [] END)) AS companies
  FROM (SELECT *, (authority * 0.7::DOUBLE + recognition * 0.3::DOUBLE) / 100 AS source_factor,
      CASE WHEN lag = 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS freshness, published + lag::INT AS edition_day
    FROM (SELECT *, unnest(range(3)) AS lag FROM rated))
  WHERE {scores.sql_rounded('effective * freshness', 4)} > 0 AND {scores.sql_rounded('effective * source_factor', 4)} > 0)"""


@query(
    "freshness_and_rank_scores",
    with_sql(ARTICLES, ASSESSMENTS, GATE_SQL, SCORED)
    + "SELECT edition_day, profile_id, id, freshness, source_factor, shortlist, ranking FROM scored",
)
def freshness_and_rank_scores(spark, sf_dir):
    return scored_items(spark, sf_dir).select(
        "edition_day", "profile_id", "id", "freshness", "source_factor", "shortlist", "ranking"
    )


_ITEM = """{'day': day, 'shortlist': shortlist, 'published': published, 'identity': identity, 'id': id, 'category': category,
   'companies': companies, 'ranking': ranking, 'freshness': freshness}"""


def _fits(item: str, held: str, relaxed: int) -> str:
    return (
        f"len(list_filter({held}, lambda c: c.category = {item}.category)) < (CASE WHEN {item}.category = '学术' THEN 2 ELSE 3 END) + {relaxed} "
        f"AND len(list_filter({item}.companies, lambda k: len(list_filter({held}, lambda c: list_contains(c.companies, k))) >= 2 + {relaxed})) = 0"
    )


def _best(pool: str, held: str) -> str:
    """Best nominee of a pool: head per category by time tier first, then the top of the heads."""
    key = "{'f': x.freshness, 'r': x.ranking, 's': x.shortlist, 'i': x.identity, 'x': x}"
    heads = ", ".join(
        f"list_sort(list_transform(list_filter({pool}, lambda x: x.category = '{c}' AND NOT list_contains(list_transform({held}, lambda h: h.id), x.id) "
        f"AND {_fits('x', held, 0)}), lambda x: {key}), 'DESC')[1].x"
        for c in fixed.CATEGORIES
    )
    return (
        "list_sort(list_transform(list_filter([" + heads + "], lambda x: x IS NOT NULL), "
        "lambda x: {'r': x.ranking, 's': x.shortlist, 'i': x.identity, 'x': x}), 'DESC')[1:1]"
    )


SELECT_SQL = f"""bags AS (SELECT edition_day, profile_id, list({_ITEM} ORDER BY day DESC, shortlist DESC, published DESC, identity DESC) AS items
    FROM scored GROUP BY ALL),
first_pass AS (SELECT *, list_reduce(list_transform(items, lambda x: [x]), lambda acc, y:
    CASE WHEN len(acc) < 10 AND {_fits("y[1]", "acc", 1)} THEN list_concat(acc, y) ELSE acc END, items[1:0]) AS s1 FROM bags),
listed AS (SELECT *, list_concat(s1, list_filter(items, lambda x: NOT list_contains(list_transform(s1, lambda h: h.id), x.id))[1:10 - len(s1)]) AS short FROM first_pass),
filled AS (SELECT *, list_reduce(list_transform(range(7), lambda i: items[1:1]), lambda acc, y:
    list_concat(acc, list_transform({_best("short", "acc")}, lambda b: b.x)), items[1:0]) AS p1 FROM listed),
refilled AS (SELECT *, list_filter(items, lambda x: NOT list_contains(list_transform(short, lambda h: h.id), x.id)) AS outside FROM filled),
picked AS (SELECT *, list_reduce(list_transform(range(7), lambda i: items[1:1]), lambda acc, y: CASE WHEN len(acc) >= 7 THEN acc ELSE
    list_concat(acc, list_transform({_best("outside", "acc")}, lambda b: b.x)) END, p1) AS p2 FROM refilled),
picks AS (SELECT edition_day, profile_id, unnest(p2, recursive := false) AS x FROM picked)"""


@query(
    "shortlist_10",
    with_sql(ARTICLES, ASSESSMENTS, GATE_SQL, SCORED, SELECT_SQL)
    + "SELECT edition_day, profile_id, x.id AS id FROM (SELECT edition_day, profile_id, unnest(short) AS x FROM listed)",
)
def shortlist_10(spark, sf_dir):
    rows = scored_items(spark, sf_dir)
    listed = quotas.shortlist(quotas.cut(rows), ["day", "shortlist", "published", "identity"])
    return listed.select("edition_day", "profile_id", "id")


@query(
    "edition_picks",
    with_sql(ARTICLES, ASSESSMENTS, GATE_SQL, SCORED, SELECT_SQL)
    + """SELECT edition_day, profile_id, x.id AS id, x.category AS category, x.ranking AS ranking, x.shortlist AS shortlist,
      (row_number() OVER (PARTITION BY edition_day, profile_id ORDER BY x.ranking DESC, x.shortlist DESC, x.identity DESC))::INT AS pick_rank FROM picks""",
)
def edition_picks(spark, sf_dir):
    return quotas.select_edition(scored_items(spark, sf_dir)).select(
        "edition_day", "profile_id", "id", "category", "ranking", "shortlist", "pick_rank"
    )


def _profile_table(spark):
    return spark.createDataFrame([(p["profile_id"], p["interests"]) for p in dim.PROFILES], "profile_id string, interests array<string>")


def _channel_scored(spark, sf_dir):
    """Items of every profile's channels; one scan and one scoring pass for all profiles."""
    return matching.score_interests(channel_items(spark, sf_dir), dim.PROFILES).select(
        "profile_id", "channel_id", "source", "title", F.col("doc_id").alias("id"), "matched_keywords", "rule_score", "ts"
    )


def rule_order():
    return [F.desc("rule_score"), F.desc("ts"), F.lower(F.col("title")), F.col("id")]


@query(
    "top_per_source",
    with_sql(ARTICLES, CHANNEL_ITEMS, INTERESTS)
    + """SELECT profile_id, source, doc_id AS id, source_rank FROM (SELECT profile_id, source, doc_id, (row_number() OVER
      (PARTITION BY profile_id, channel_id, source ORDER BY rule_score DESC, ts DESC, lower(title), doc_id))::INT AS source_rank FROM scored)
      WHERE source_rank <= 6""",
)
def top_per_source(spark, sf_dir):
    best = quotas.top_per_source(_channel_scored(spark, sf_dir), ["profile_id", "channel_id", "source"], 6, rule_order())
    return best.select("profile_id", "source", "id", "source_rank")


def channel_candidates(spark, sf_dir):
    """Best rows per source, written once because both the shortlist and the counters read them."""
    return quotas.cut(quotas.top_per_source(_channel_scored(spark, sf_dir), ["profile_id", "channel_id", "source"], 6, rule_order()))


def channel_shortlist(spark, sf_dir, best=None):
    best = channel_candidates(spark, sf_dir) if best is None else best
    picked = quotas.keyword_coverage(best, ["profile_id", "channel_id"], _profile_table(spark), 6, rule_order())
    return best.join(picked, ["profile_id", "channel_id", "id"]).withColumnRenamed("pick_rank", "shortlist_rank")


def channel_assessed(spark, sf_dir, best=None):
    """Shortlist with channel assessments from labels; unassessed items use the rule fallback."""
    from broadsheet.plans.tables import assessments

    found = assessments(spark, sf_dir).select(F.col("doc_id").alias("id"), "relevance", F.lit("ai").alias("status"))
    joined = channel_shortlist(spark, sf_dir, best).join(found, "id", "left")
    rel = F.floor(F.col("relevance") / 10).cast("int")
    return joined.withColumn(
        "final_score",
        scores.combined_score(F.coalesce("status", F.lit("fallback")), F.col("rule_score"), rel, F.lit(5)),
    )


def final_order():
    return [F.desc("final_score"), F.desc("ts"), F.lower(F.col("title")), F.col("id")]


def _sql_cover(items: str, interests: list[str], limit: int) -> str:
    """Nested covering steps over a sorted list, one per interest, then fill."""
    listed = "[" + ", ".join(f"'{i}'" for i in interests) + "]"
    return f"""list_reduce(list_transform({listed}, lambda k: [{{'n': 0::BIGINT, 'id': 0::BIGINT, 'kw': [k]}}]), lambda acc, y:
      CASE WHEN len(acc) >= {limit} OR list_contains(flatten(list_transform(acc, lambda a: a.kw)), y[1].kw[1]) THEN acc
      ELSE list_concat(acc, list_filter({items}, lambda r: list_contains(r.kw, y[1].kw[1]) AND NOT list_contains(list_transform(acc, lambda a: a.n), r.n))[1:1]) END, {items}[1:0])"""


def _cover_case(items: str, limit: int) -> str:
    return "CASE profile_id " + " ".join(
        f"WHEN '{p['profile_id']}' THEN {_sql_cover(items, p['interests'], limit)}" for p in dim.PROFILES
    ) + " END"


def _coverage_sql(source: str, score: str, limit: int, tag: str) -> str:
    return f"""{tag}_bags AS (SELECT profile_id, channel_id, list({{'n': n, 'id': doc_id, 'kw': matched}} ORDER BY n) AS items FROM
      (SELECT *, row_number() OVER (PARTITION BY profile_id, channel_id ORDER BY {score} DESC, ts DESC, lower(title), doc_id) AS n FROM {source}) GROUP BY ALL),
    {tag}_cov AS (SELECT *, {_cover_case("items", limit)} AS cov FROM {tag}_bags),
    {tag}_sel AS (SELECT profile_id, channel_id, list_concat(cov, list_filter(items, lambda r: NOT list_contains(list_transform(cov, lambda a: a.n), r.n)))[1:{limit}] AS sel FROM {tag}_cov),
    {tag} AS (SELECT profile_id, channel_id, unnest(sel).id AS id, unnest(range(1, len(sel) + 1))::INT AS pick_rank FROM {tag}_sel)"""


CHANNEL_PICKS = (
    """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, channel_id, source ORDER BY rule_score DESC, ts DESC, lower(title), doc_id) AS sr FROM scored) WHERE sr <= 6), """
    + _coverage_sql("best", "rule_score", 6, "short")
    + """, final AS (SELECT b.*, CASE WHEN a.relevance IS NULL THEN rule_score::DOUBLE
        ELSE """
    + scores.sql_rounded("rule_score * 0.4::DOUBLE + ((a.relevance // 10) * 0.6::DOUBLE + 5 * 0.4::DOUBLE) * 10 * 0.6::DOUBLE", 2)
    + """ END AS final_score
      FROM best b JOIN short s ON b.profile_id = s.profile_id AND b.channel_id = s.channel_id AND b.doc_id = s.id LEFT JOIN assessments a ON a.doc_id = b.doc_id), """
    + _coverage_sql("final", "final_score", 3, "picks")
)


@query(
    "keyword_coverage_shortlist",
    with_sql(ARTICLES, CHANNEL_ITEMS, INTERESTS, ASSESSMENTS, CHANNEL_PICKS)
    + "SELECT profile_id, channel_id, id, pick_rank AS shortlist_rank FROM short",
)
def keyword_coverage_shortlist(spark, sf_dir):
    return channel_shortlist(spark, sf_dir).select("profile_id", "channel_id", "id", "shortlist_rank")


@query(
    "keyword_coverage_picks",
    with_sql(ARTICLES, CHANNEL_ITEMS, INTERESTS, ASSESSMENTS, CHANNEL_PICKS)
    + "SELECT p.profile_id, p.channel_id, p.id, p.pick_rank, f.final_score FROM picks p JOIN final f ON p.profile_id = f.profile_id AND p.channel_id = f.channel_id AND p.id = f.doc_id",
)
def keyword_coverage_picks(spark, sf_dir, best=None):
    rows = quotas.cut(channel_assessed(spark, sf_dir, best))
    picked = quotas.keyword_coverage(rows, ["profile_id", "channel_id"], _profile_table(spark), 3, final_order())
    return picked.join(rows.select("profile_id", "channel_id", "id", "final_score"), ["profile_id", "channel_id", "id"])


@query(
    "channel_runs",
    with_sql(ARTICLES, CHANNEL_ITEMS, INTERESTS, ASSESSMENTS, CHANNEL_PICKS)
    + """SELECT b.profile_id, b.channel_id, b.scanned, s.shortlisted, p.picked FROM
      (SELECT profile_id, channel_id, count(*) AS scanned FROM best GROUP BY ALL) b
      JOIN (SELECT profile_id, channel_id, count(*) AS shortlisted FROM short GROUP BY ALL) s USING (profile_id, channel_id)
      JOIN (SELECT profile_id, channel_id, count(*) AS picked FROM picks GROUP BY ALL) p USING (profile_id, channel_id)""",
)
def channel_runs(spark, sf_dir):
    """Counters of every channel run: items kept in the window, shortlist size, picks."""
    group = ["profile_id", "channel_id"]
    best = channel_candidates(spark, sf_dir)
    scanned = best.groupBy(*group).agg(F.count(F.lit(1)).alias("scanned"))
    short = channel_shortlist(spark, sf_dir, best).groupBy(*group).agg(F.count(F.lit(1)).alias("shortlisted"))
    picks = keyword_coverage_picks(spark, sf_dir, best).groupBy(*group).agg(F.count(F.lit(1)).alias("picked"))
    return scanned.join(short, group).join(picks, group)


@query(
    "finalists",
    with_sql(ARTICLES, ASSESSMENTS, GATE_SQL, SCORED)
    + """SELECT edition_day, profile_id, id, check_order FROM (SELECT *, (row_number() OVER (PARTITION BY edition_day, profile_id ORDER BY shortlist DESC, effective DESC, identity DESC, id))::INT AS check_order FROM scored)
      WHERE check_order <= 10""",
)
def finalists(spark, sf_dir):
    rows = scored_items(spark, sf_dir).withColumn("relevance", F.col("effective"))
    return planning.finalists(rows).select("edition_day", "profile_id", "id", "check_order")


_LINK_ONLY = f"""failed AS (SELECT edition_day, profile_id, p2, list({_ITEM} ORDER BY ranking DESC, shortlist DESC, identity DESC) AS lost FROM scored JOIN picked USING (edition_day, profile_id)
    WHERE id::BIGINT % 2 = 1 GROUP BY ALL),
held AS (SELECT *, list_filter(p2, lambda h: h.id::BIGINT % 2 = 0) AS good FROM failed),
backfilled AS (SELECT edition_day, profile_id, good, list_reduce(list_transform(lost, lambda x: [x]), lambda acc, y:
    CASE WHEN len(acc) < 7 AND {_fits("y[1]", "acc", 0)} THEN list_concat(acc, y) ELSE acc END, good) AS after FROM held)"""


@query(
    "link_only_backfill",
    with_sql(ARTICLES, ASSESSMENTS, GATE_SQL, SCORED, SELECT_SQL, _LINK_ONLY)
    + "SELECT edition_day, profile_id, x.id AS id FROM (SELECT edition_day, profile_id, unnest(after[len(good) + 1:]) AS x FROM backfilled)",
)
def link_only_backfill(spark, sf_dir):
    """Odd-numbered documents stand for items whose summary failed; they fill what the good picks leave free."""
    rows = quotas.cut(scored_items(spark, sf_dir))
    good = quotas.select_edition(rows).filter("cast(id AS long) % 2 = 0")
    return quotas.link_only_backfill(good, rows.filter("cast(id AS long) % 2 = 1")).select("edition_day", "profile_id", "id")
