"""Repository picks, planning, event groups, reputation and page checks over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import dates, scores, text, urls
from broadsheet.operators import coverage, events, gates, ledger, matching, planning, quotas, repositories, reputation
from broadsheet.plans import dimensions as dim
from broadsheet.plans.registry import query
from broadsheet.plans.rule_queries import PLACES, RULE_ROWS
from broadsheet.plans.selection_queries import scored_items
from broadsheet.plans.source_queries import REPOS, repositories_view, search_rows
from broadsheet.plans.tables import (
    ARTICLES, OBSERVATIONS, articles, first_word, load, observations, sql_host, sql_normal, with_sql,
)
from broadsheet.session import cut


def _sql_repo_interest(term: str) -> str:
    rx = f"'(^|[^a-z0-9]){term}($|[^a-z0-9])'"
    return f"CASE WHEN regexp_matches(nn, {rx}) THEN 30 WHEN regexp_matches(nd, {rx}) THEN 20 ELSE 0 END"


_P = dim.REPO_PROFILE
_POINTS = " + ".join(_sql_repo_interest(t) for t in _P["interests"])
_MATCHED = "list_filter([" + ", ".join(f"CASE WHEN {_sql_repo_interest(t)} > 0 THEN '{t}' END" for t in _P["interests"]) + "], lambda x: x IS NOT NULL)"
REPO_SCORES = f"""named AS (SELECT *, {sql_normal("name || ' ' || topic")} AS nn, {sql_normal("description")} AS nd FROM repos),
pointed AS (SELECT *, {_POINTS} AS points, {_MATCHED} AS matched, regexp_matches(nn || ' ' || nd || ' ', '(^|[^a-z0-9])rusty($|[^a-z0-9])') AS barred FROM named),
repo_scores AS (SELECT *, greatest(0, least(100, points - CASE WHEN barred THEN 35 ELSE 0 END + least(20, stars_today // 50) + greatest(0, 6 - least(rank, 6))
    + CASE WHEN license <> '' THEN 5 ELSE 0 END))::INT AS relevance_score FROM pointed),
labelled AS (SELECT *, CASE WHEN barred OR len(matched) = 0 THEN '略过' WHEN relevance_score >= 50 THEN '深挖' WHEN relevance_score >= 20 THEN '关注' ELSE '略过' END AS recommendation FROM repo_scores)"""


@query(
    "repo_scores",
    with_sql(REPOS, REPO_SCORES)
    + """SELECT snapshot_day, full_name, relevance_score, recommendation, array_to_string(matched, '|') AS matched,
      CASE WHEN barred THEN '命中过滤词：rusty' || CASE WHEN len(matched) > 0 THEN '；虽命中 ' || array_to_string(matched[1:2], '、') ELSE '' END || '，仍降低推荐。'
        WHEN len(matched) > 0 THEN '命中你的关注词：' || array_to_string(matched[1:3], '、') || '；今日新增约 ' || stars_today || ' Stars。'
        ELSE '与关注词匹配较弱；因 Trending 排名第 ' || rank || ' 暂时保留观察。' END AS why FROM labelled""",
)
def repo_scores(spark, sf_dir):
    return repositories.score(repositories_view(spark, sf_dir), dim.REPO_PROFILE).select(
        "snapshot_day", "full_name", "relevance_score", "recommendation", F.array_join("matched_interests", "|").alias("matched"), "why"
    )


@query(
    "repo_picks",
    with_sql(REPOS, REPO_SCORES)
    + """SELECT snapshot_day, full_name, relevance_score, pick_rank FROM (SELECT *, (row_number() OVER (PARTITION BY snapshot_day ORDER BY relevance_score DESC, rank))::INT AS pick_rank
      FROM labelled WHERE recommendation <> '略过') WHERE pick_rank <= 3""",
)
def repo_picks(spark, sf_dir):
    scored = repositories.score(repositories_view(spark, sf_dir), dim.REPO_PROFILE)
    return repositories.picks(scored, ["snapshot_day"], 3).select("snapshot_day", "full_name", "relevance_score", "pick_rank")


@query(
    "rank_history",
    with_sql(REPOS)
    + """, days AS (SELECT snapshot_day, lag(snapshot_day) OVER (ORDER BY snapshot_day) AS before FROM (SELECT DISTINCT snapshot_day FROM repos))
    SELECT r.snapshot_day, r.full_name, r.rank::INT AS rank, p.rank::INT AS previous_rank, CASE WHEN p.rank IS NULL THEN 'NEW' WHEN p.rank > r.rank THEN '↑' || (p.rank - r.rank)
      WHEN p.rank < r.rank THEN '↓' || (r.rank - p.rank) ELSE '—' END AS rank_change
    FROM repos r JOIN days d ON r.snapshot_day = d.snapshot_day LEFT JOIN repos p ON p.full_name = r.full_name AND p.snapshot_day = d.before""",
)
def rank_history(spark, sf_dir):
    return repositories.rank_history(repositories_view(spark, sf_dir)).select(
        "snapshot_day", "full_name", "rank", "previous_rank", "rank_change"
    )


@query(
    "repo_fallback_summaries",
    with_sql(REPOS)
    + """SELECT snapshot_day, full_name, '今日新增约 ' || stars_today || ' Stars|主要语言：' || language || '|关键词：' || topic AS highlights,
      CASE WHEN regexp_matches(t, 'ai|llm|machine-learning|agent|model') THEN 'AI / 机器学习' WHEN regexp_matches(t, 'developer|cli|tool|sdk|ide|terminal') THEN '开发工具'
        WHEN regexp_matches(t, 'web|frontend|backend|react|vue|app') THEN 'Web / 应用' WHEN regexp_matches(t, 'database|data|cloud|kubernetes|infra') THEN '数据 / 基础设施'
        WHEN regexp_matches(t, 'security|privacy|vulnerability|pentest') THEN '安全' WHEN regexp_matches(t, 'tutorial|awesome|learn|course|book') THEN '学习资源' ELSE '其他' END AS category,
      '⭐ ' || format('{:,}', stars) || ' · 今日 +' || stars_today || ' · Fork ' || forks || ' · ' || language || CASE WHEN license <> '' THEN ' · ' || license ELSE '' END AS data_line
    FROM (SELECT *, lower(name || ' ' || description || ' ' || language || ' ' || topic) AS t FROM repos)""",
)
def repo_fallback_summaries(spark, sf_dir):
    c = F.col
    out = repositories.fallback_summary(repositories_view(spark, sf_dir))
    line = repositories.data_line(c("stars"), c("stars_today"), c("forks"), c("language"), c("license"))
    return out.select("snapshot_day", "full_name", F.array_join("highlights", "|").alias("highlights"), "category", line.alias("data_line"))


def _days(spark, sf_dir):
    return observations(spark, sf_dir).select("day").distinct()


#: The sample rules under the topics of a deployment; one rule is not searched, and the academic topic never is.
_TOPICS = {"企业": "new product", "眼镜可穿戴": "glasses", fixed.POLICY: "standards", fixed.ACADEMIC: "papers"}
_TOPIC_NAMES = {"core": ["企业", "眼镜可穿戴", fixed.ACADEMIC], "funding": ["眼镜可穿戴"], "policy": [fixed.POLICY]}


def _search_rules():
    for i, r in enumerate(dim.RULES):
        names = list(dict.fromkeys(n for t in r["topics"] for n in _TOPIC_NAMES[t]))
        yield i, r["id"], r["weight"], r["groups"], names, f" {r['query']} ", r["exploration"], r["id"] != "r03"


def _rules_table(spark):
    return spark.createDataFrame(
        list(_search_rules()),
        "position int, id string, weight int, groups array<array<string>>, topics array<string>, query string, exploration boolean, search_enabled boolean",
    )


_RULE_VALUES = ", ".join(
    f"({i}, '{name}', {weight}, {topics}, {str(exploration).upper()}, '{words}', {len(groups)})"
    for i, name, weight, groups, topics, words, exploration, enabled in _search_rules() if enabled
)


@query(
    "query_plan_calendar",
    with_sql(
        OBSERVATIONS,
        f"rules AS (SELECT position, id, weight, unnest(topics) AS topic, exploration, trim(words) AS words, n FROM (VALUES {_RULE_VALUES}) v(position, id, weight, topics, exploration, words, n))",
        """ranked AS (SELECT * EXCLUDE (n), words || CASE WHEN n = 1 AND topic = '企业' THEN ' new' WHEN n = 1 AND topic = '眼镜可穿戴' THEN ' glasses' WHEN topic = '政策' THEN ' 中国' ELSE '' END AS query,
          row_number() OVER (PARTITION BY topic ORDER BY weight DESC, position) AS n FROM rules WHERE topic <> '学术')""",
        "pool AS (SELECT *, row_number() OVER (PARTITION BY topic, exploration ORDER BY n) - 1 AS turn FROM ranked WHERE n > 4)",
        "sizes AS (SELECT topic, count(*) FILTER (WHERE NOT exploration) AS regular, count(*) FILTER (WHERE exploration) AS exploratory FROM pool GROUP BY topic)",
        "days AS (SELECT DISTINCT day, (day - DATE '0001-01-01') + 1 AS o FROM observations)",
        "cal AS (SELECT day, o, s.*, exploratory > 0 AND o % 10 = 0 AS explore FROM days CROSS JOIN sizes s)",
    )
    + """SELECT day, c.topic, r.id, query, FALSE AS rotating, len(query) > 70 AS too_long FROM cal c JOIN ranked r ON r.topic = c.topic AND r.n <= 4
    UNION ALL SELECT day, c.topic, p.id, query, TRUE, len(query) > 70 FROM cal c JOIN pool p ON p.topic = c.topic AND p.exploration = (explore OR regular = 0)
      AND p.turn = CASE WHEN explore THEN (o // 10) % exploratory WHEN regular = 0 THEN o % exploratory ELSE o % regular END""",
)
def query_plan_calendar(spark, sf_dir):
    return planning.query_calendar(_days(spark, sf_dir), _rules_table(spark), _TOPICS).select("day", "topic", "id", "query", "rotating", "too_long")


@query(
    "site_rotation",
    with_sql(OBSERVATIONS)
    + """, days AS (SELECT DISTINCT day, ((day - DATE '0001-01-01') + 1) % 2 AS g FROM observations),
      sites AS (SELECT s_suppkey AS id, s_suppkey % 2 AS g, s_acctbal > 5000 AS official, s_suppkey AS position FROM supplier)
    SELECT day, id, CASE WHEN row_number() OVER (PARTITION BY day ORDER BY official DESC, position) <= 4 THEN 'scheduled' ELSE 'deferred' END AS status
    FROM days JOIN sites USING (g)""",
)
def site_rotation(spark, sf_dir):
    sites = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 2).cast("int").alias("rotation_group"),
        (F.col("s_acctbal") > 5000).alias("official"), F.col("s_suppkey").alias("position"),
    )
    return planning.site_calendar(_days(spark, sf_dir), sites).select("day", "id", "status")


@query(
    "widened_search",
    with_sql(ARTICLES)
    + """, rows AS (SELECT doc_id, source, doc_id % 3 AS query_no, doc_id % 5 < 3 AS one_day, url, CASE WHEN doc_id % 4 <> 0 THEN seen_day END AS published FROM articles
        WHERE doc_id % 13 <> 0 AND (doc_id % 4 = 0 OR DATE '2024-01-20' - seen_day BETWEEN 0 AND 1)),
      h AS (SELECT source, count(DISTINCT CASE WHEN published IS NOT NULL AND (one_day OR query_no < 0) THEN url END) AS h0,
        count(DISTINCT CASE WHEN published IS NOT NULL AND (one_day OR query_no < 1) THEN url END) AS h1 FROM rows GROUP BY source)
    SELECT doc_id, source FROM rows JOIN h USING (source) WHERE one_day OR (query_no = 0 AND h0 < 2) OR (query_no = 1 AND h0 < 2 AND h1 < 2)""",
)
def widened_search(spark, sf_dir):
    day = F.when(F.col("publish_date") != "", F.col("seen_day"))
    today = F.to_date(F.lit("2024-01-20"))
    rows = search_rows(spark, sf_dir).withColumn("published", day).withColumn("id", F.col("link")).filter(~urls.dictionary_site(F.col("link")))
    fresh = gates.fresh_collection(rows, today, F.lit(2))
    return planning.widened_search(fresh, ["source"]).select("doc_id", "source")


def queue_items(spark, sf_dir):
    """Documents as queued candidates of a daily edition, with rule weights and source identity."""
    matched = matching.match_rules(articles(spark, sf_dir), dim.RULES)
    none = F.lit(None).cast("double")
    today = F.date_add("seen_day", 1)
    fresh = scores.freshness(today, F.col("published"))
    relevance = F.coalesce(matching.top_weight(F.col("matches")), F.lit(fixed.DEFAULT_RELEVANCE))
    return matched.select(
        F.trunc("seen_day", "month").alias("edition_day"), "profile_id", F.col("doc_id").cast("string").alias("id"),
        text.digest(F.col("url")).alias("identity"), "category", urls.publisher_key(F.col("url"), F.col("source")).alias("source_key"),
        (F.size("matches") % 4).alias("tier"), relevance.alias("relevance"),
        scores.queue_estimate(relevance, fresh, F.col("published")).alias("estimate"),
        scores.source_priority(F.col("url"), none, none).alias("source_priority"),
        scores.date_priority(F.lit(None).cast("date"), F.col("published")).alias("date_priority"),
        planning.needs_read(F.col("published"), text.usable_summary(F.col("summary"), F.col("title")), F.col("body")).alias("needs_read"),
        (F.col("doc_id") % 2 == 0).alias("trusted_undated"), F.col("published").isNull().alias("undated"),
        ((F.size("matches") > 0) & F.forall("matches", lambda m: m["exploration"])).alias("exploration"),
        F.lit(True).alias("exploration_due"),
    )


QUEUE = f"""queue AS (SELECT date_trunc('month', seen_day)::DATE AS edition_day, profile_id, doc_id::VARCHAR AS id, category,
    coalesce(h.n, 0) % 4 AS tier, coalesce(h.w, 20) AS relevance, CASE WHEN published IS NULL THEN 0.0 ELSE coalesce(h.w, 20) * 0.8::DOUBLE END AS estimate,
    coalesce(h.e, FALSE) AS exploration FROM articles a LEFT JOIN (SELECT doc_id, count(*) AS n, max(weight) AS w, bool_and(exploration) AS e FROM hits GROUP BY doc_id) h USING (doc_id))"""


@query(
    "queue_head",
    with_sql(ARTICLES, PLACES, RULE_ROWS, QUEUE)
    + """, due AS (SELECT *, exploration AND row_number() OVER (PARTITION BY edition_day, profile_id, exploration ORDER BY tier DESC, estimate DESC, category = '学术', category <> '政策', id) = 1 AS first FROM queue)
    SELECT edition_day, profile_id, id, queue_position FROM (SELECT *, (row_number() OVER (PARTITION BY edition_day, profile_id
      ORDER BY first DESC, exploration, tier DESC, estimate DESC, category = '学术', category <> '政策', id))::INT AS queue_position FROM due) WHERE queue_position <= 96""",
)
def queue_head(spark, sf_dir):
    queue = queue_items(spark, sf_dir)
    allowance = queue.select(*quotas.EDITION).distinct().withColumn("allowance", F.lit(1))
    return planning.queue_head(queue, allowance).select("edition_day", "profile_id", "id", "queue_position")


@query(
    "round_robin_plan",
    with_sql(ARTICLES, PLACES, RULE_ROWS, QUEUE)
    + """SELECT edition_day, profile_id, id, analysis_order FROM (SELECT *, (row_number() OVER (PARTITION BY edition_day, profile_id ORDER BY turn,
        CASE category WHEN '政策' THEN 0 WHEN '行业' THEN 1 WHEN '资本' THEN 2 ELSE 3 END))::INT AS analysis_order FROM
      (SELECT *, row_number() OVER (PARTITION BY edition_day, profile_id, category ORDER BY tier DESC, estimate DESC, id) AS turn FROM queue)) WHERE analysis_order <= 48""",
)
def round_robin_plan(spark, sf_dir):
    order = [F.desc("tier"), F.desc("estimate"), F.col("id")]
    return planning.round_robin(queue_items(spark, sf_dir), order, fixed.ANALYSIS_BUDGET).select(
        "edition_day", "profile_id", "id", "analysis_order"
    )


@query("analysis_plan")
def analysis_plan(spark, sf_dir):
    return planning.analysis_plan(queue_items(spark, sf_dir)).select(
        "edition_day", "profile_id", "id", "category", "analysis_order", "stage"
    )


@query(
    "listing_candidates",
    with_sql(ARTICLES, PLACES, RULE_ROWS)
    + """, w AS (SELECT a.doc_id, source, coalesce((SELECT max(weight) FROM hits h WHERE h.doc_id = a.doc_id), 0) AS weight, len(trim(summary)) < 30 AS trusted FROM articles a),
      e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM w WHERE weight = 0 AND trusted) WHERE n <= 6),
      b AS (SELECT doc_id, source, weight FROM w WHERE weight > 0 UNION ALL SELECT doc_id, source, weight FROM e)
    SELECT doc_id, source, listing_rank FROM (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY weight DESC, doc_id))::INT AS listing_rank FROM b) WHERE listing_rank <= 40""",
)
def listing_candidates(spark, sf_dir):
    matched = matching.match_rules(articles(spark, sf_dir), dim.RULES)
    rows = matched.select(
        "doc_id", "source", F.col("doc_id").alias("position"), F.coalesce(matching.top_weight(F.col("matches")), F.lit(0)).alias("weight"),
        (F.length(F.trim("summary")) < 30).alias("trusted"),
    )
    return planning.listing_candidates(rows, ["source"]).select("doc_id", "source", "listing_rank")


def _grouped(spark, sf_dir):
    """Batches of forty consecutive documents; an assessor groups every eighth one of a language.

    In every sixth batch the assessor names items that must not be grouped; in every tenth one member has no date.
    """
    doc = F.col("doc_id")
    base = articles(spark, sf_dir)
    items = base.select(
        "profile_id", F.expr("doc_id div 40").alias("batch_no"), doc.cast("string").alias("id"), "title", "url",
        "category", (doc % 5 != 3).alias("accepted"),
        F.when(doc % 400 != 127, F.date_add(F.to_date(F.lit("2024-01-01")), (doc * 5 % 11).cast("int"))).alias("published"),
        F.lit(None).cast("date").alias("first_reported"), (doc * 37 % 100).cast("double").alias("ranking"),
        F.array(F.struct("url", F.col("source").alias("name"))).alias("sources"), doc.alias("doc_id"),
    )
    named = items.filter((F.col("accepted") & (F.col("category") != fixed.ACADEMIC)) | (F.col("batch_no") % 6 == 5))
    groups = named.groupBy("profile_id", "batch_no", (F.col("doc_id") % 8).alias("group_no")).agg(
        F.transform(F.array_sort(F.collect_list("doc_id")), lambda d: d.cast("string")).alias("members")
    )
    return items.drop("doc_id"), groups.filter(F.size("members") > 1)


@query(
    "event_groups",
    with_sql(ARTICLES)
    + """, items AS (SELECT *, doc_id // 40 AS batch_no, doc_id % 8 AS group_no, CASE WHEN doc_id % 400 <> 127 THEN DATE '2024-01-01' + (doc_id * 5 % 11)::INT END AS day, (doc_id * 37 % 100)::DOUBLE AS r,
        regexp_matches(url, '^https?://[^/]*\\.gov\\.cn/') AS gov, doc_id % 5 <> 3 AND category <> '学术' AS eligible FROM articles),
      named AS (SELECT * FROM items WHERE eligible OR batch_no % 6 = 5),
      g AS (SELECT profile_id, batch_no, group_no, max(day) - min(day) AS span, count(DISTINCT category) AS categories,
          bool_or(NOT eligible OR day IS NULL) AS wrong FROM named GROUP BY ALL HAVING count(*) > 1),
      void AS (SELECT profile_id, batch_no FROM g WHERE wrong),
      ok AS (SELECT i.* FROM named i JOIN g USING (profile_id, batch_no, group_no) ANTI JOIN void USING (profile_id, batch_no) WHERE categories = 1 AND span <= 7)
    SELECT profile_id, batch_no, group_no, (list(doc_id::VARCHAR ORDER BY gov DESC, r DESC, doc_id))[1] AS id, min(day) AS first_reported,
      count(DISTINCT url) AS n_sources FROM ok GROUP BY ALL""",
)
def event_groups(spark, sf_dir):
    items, groups = _grouped(spark, sf_dir)
    primaries, _ = events.merge_declared_groups(items, groups, ["profile_id", "batch_no"])
    return primaries.select("profile_id", "batch_no", "group_no", "id", "first_reported", F.size("sources").cast("long").alias("n_sources"))


@query("prior_coverage")
def prior_coverage(spark, sf_dir):
    """Picks of each edition against what the same profile was sent on earlier days."""
    picks = cut(quotas.select_edition(scored_items(spark, sf_dir)).select("edition_day", "profile_id", "id", "category", "companies"))
    titles = articles(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "title")
    facts = cut(picks.join(titles, "id").select(
        "edition_day", "profile_id", "id", "category", text.title_key(F.col("title")).alias("title_key"),
        text.policy_document(F.col("title"), F.col("category")).alias("document"),
        events.name_list(F.col("companies"), F.lit("")).alias("names"), F.lit(None).cast("date").alias("event_day"),
    ))
    history = facts.withColumnRenamed("edition_day", "day").withColumnRenamed("id", "sent_id")
    priors = cut(events.possible_priors(facts, history))
    # every third candidate was decided before: as new where its number is even
    keyed = priors.groupBy("id", "event_day", "edition_day", "profile_id").agg(F.array_sort(F.collect_list(F.struct("prior_rank", "sent_id"))).alias("p"))
    decided = keyed.filter("cast(id as long) % 3 = 0").select(
        "id", "event_day", F.array_join(F.transform("p", lambda r: r["sent_id"]), ":").alias("prior_key"), (F.col("id").cast("long") % 2 == 1).alias("duplicate")
    ).distinct()
    return events.coverage_verdicts(priors, decided)


@query(
    "publisher_ratings",
    with_sql(ARTICLES)
    + f""", keyed AS (SELECT doc_id, source, url, {sql_host("url")} AS host, CASE WHEN {sql_host("url")} = 'mp.weixin.qq.com' THEN 'wechat:' || lower(trim(source))
        ELSE regexp_replace({sql_host("url")}, '^www\\.', '') END AS publisher_key FROM articles),
      rated AS (SELECT publisher_key, arg_min(source, doc_id) AS name, any_value(host) AS host FROM keyed GROUP BY publisher_key),
      fresh AS (SELECT *, CASE WHEN regexp_matches(host, '(^|\\.)(gov\\.cn|stcn\\.com|arxiv\\.org)$') THEN '已配置的独立域名' WHEN regexp_matches(host, '\\.edu\\.cn$') THEN '高校或科研机构域名'
          WHEN host = 'mp.weixin.qq.com' THEN '公众号身份未独立核实' WHEN regexp_matches(host, '(^|\\.)sohu\\.com$') THEN '媒体平台账号未独立核实' ELSE '新域名待核实' END AS basis,
        CASE WHEN regexp_matches(host, '(^|\\.)gov\\.cn$') THEN 100 WHEN regexp_matches(host, '(^|\\.)stcn\\.com$') THEN 85 WHEN regexp_matches(host, '(^|\\.)arxiv\\.org$') THEN 70
          WHEN regexp_matches(host, '\\.edu\\.cn$') THEN 80 WHEN host = 'mp.weixin.qq.com' THEN 40 WHEN regexp_matches(host, '(^|\\.)sohu\\.com$') THEN 40 ELSE 50 END::DOUBLE AS authority FROM rated)
    SELECT publisher_key, CASE WHEN known AND basis <> '已配置的独立域名' THEN 'earlier' ELSE basis END AS basis, CASE WHEN known AND basis <> '已配置的独立域名' THEN 11.0 ELSE authority END::DOUBLE AS authority
    FROM (SELECT *, publisher_key IN (SELECT publisher_key FROM keyed WHERE doc_id % 9 = 4 OR doc_id % 10 = 0) AS known FROM fresh)""",
)
def publisher_ratings(spark, sf_dir):
    """Reputation table after a run: some publishers were rated earlier, configured domains are overridden."""
    items = articles(spark, sf_dir).select("doc_id", "source", "url", F.col("seen_day").alias("day"), F.col("doc_id").alias("seq"))
    earlier = items.filter("doc_id % 9 = 4 OR doc_id % 10 = 0").select(
        urls.publisher_key(F.col("url"), F.col("source")).alias("publisher_key"), "source", "url", "day"
    )
    stored = earlier.groupBy("publisher_key").agg(
        F.min("source").alias("name"), F.min("url").alias("url"), F.lit(11.0).alias("authority"), F.lit(12.0).alias("recognition"),
        F.lit("earlier").alias("basis"), F.min("day").alias("first_seen"),
    )
    return reputation.attach(items, stored)[1].select("publisher_key", "basis", "authority")


@query(
    "longest_suffix_ratings",
    """WITH h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM pages),
      r AS (SELECT DISTINCT split_part(host, '.', -2) || '.' || split_part(host, '.', -1) AS domain, 1 AS rating FROM h
        UNION ALL SELECT DISTINCT split_part(host, '.', -3) || '.' || split_part(host, '.', -2) || '.' || split_part(host, '.', -1), 2 FROM h WHERE host LIKE 'blog.%')
    SELECT host, arg_max(domain, len(domain)) AS domain, arg_max(rating, len(domain))::INT AS rating FROM h JOIN r ON host = domain OR ends_with(host, '.' || domain) GROUP BY host""",
)
def longest_suffix_ratings(spark, sf_dir):
    hosts = load(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host")).distinct()
    last = lambda n: F.array_join(F.slice(F.split("host", r"\."), -n, n), ".")
    ratings = hosts.select(last(2).alias("domain"), F.lit(1).alias("rating")).distinct().unionByName(
        hosts.filter(F.col("host").startswith("blog.")).select(last(3).alias("domain"), F.lit(2).alias("rating")).distinct()
    )
    return reputation.longest_suffix(hosts, ratings)


@query(
    "policy_authority",
    with_sql(ARTICLES)
    + f"""SELECT doc_id, CASE WHEN regexp_matches({sql_host("url")}, '\\.gov\\.cn$') THEN 0.8 ELSE 0.7 END::DOUBLE AS authority FROM articles""",
)
def policy_authority(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", scores.policy_authority(F.array(urls.host(F.col("url")))).alias("authority"))


@query(
    "official_domains",
    with_sql(ARTICLES)
    + """, c AS (SELECT DISTINCT replace(lower(regexp_extract(title, '(\\p{L}{3,})', 1)), 'ß', 'ss') AS company FROM articles),
      s AS (SELECT lower(split_part(p_name, ' ', 2)) AS name FROM part UNION SELECT 'the' UNION SELECT 'und')
    SELECT company, name || '.com' AS domain FROM c JOIN s ON company <> '' AND (contains(company, name) OR contains(name, company))""",
)
def official_domains(spark, sf_dir):
    companies = articles(spark, sf_dir).select(text.fold_case(first_word(F.col("title"))).alias("company")).distinct()
    names = load(spark, sf_dir, "part").select(F.lower(F.element_at(F.split("p_name", " "), 2)).alias("company")).distinct()
    extra = spark.createDataFrame([("the",), ("und",)], "company string")
    sources = names.unionByName(extra).distinct().withColumn("url", F.concat(F.lit("https://www."), "company", F.lit(".com/")))
    return reputation.official_domains(companies, sources)


@query(
    "product_pages",
    with_sql(ARTICLES)
    + """, launches AS (SELECT doc_id, regexp_extract(title, '(\\p{L}{3,})', 1) AS product FROM articles WHERE regexp_extract(title, '(\\p{L}{3,})', 1) <> '')
    SELECT doc_id::VARCHAR AS id, 'https://www.maker' || doc_id || '.com/p/' || (CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END) AS product_url FROM launches WHERE doc_id % 5 <> 0""",
)
def product_pages(spark, sf_dir):
    """Every article as a launch with four search results: news, official first, official second, marketplace."""
    doc = F.col("doc_id").cast("string")
    base = articles(spark, sf_dir).withColumn("product", first_word(F.col("title"))).filter("product != ''")
    launches = base.select(
        doc.alias("id"), "url", F.concat(F.lit("Maker"), doc).alias("company"), "product", F.array(F.concat(F.lit("maker"), doc, F.lit(".com"))).alias("domains")
    )
    site = F.concat(F.lit("https://www.maker"), doc, F.lit(".com"))
    links = F.array(F.concat(site, F.lit("/news/0")), F.concat(site, F.lit("/p/1")), F.concat(site, F.lit("/p/2")), F.lit("https://item.jd.com/9"))
    found = base.select(doc.alias("id"), F.posexplode(links).alias("position", "link"), F.lit("").alias("media"))
    heading = F.when(F.col("doc_id") % 5 == 0, F.lit("0")).otherwise(F.concat(F.lit("Buy "), "product"))
    pages = base.select(F.concat(site, F.lit("/p/1")).alias("url"), F.when(F.col("doc_id") % 4 == 0, F.lit("1")).otherwise(heading).alias("headings"), F.lit("").alias("text")).unionByName(
        base.select(F.concat(site, F.lit("/p/2")).alias("url"), heading.alias("headings"), F.lit("").alias("text"))
    )
    return reputation.product_pages(launches, found, pages)


@query(
    "verified_pages",
    with_sql(ARTICLES)
    + """, pick AS (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN 0 WHEN doc_id % 2 = 0 THEN 1 END AS place FROM articles)
    SELECT doc_id::VARCHAR AS id, place IS NOT NULL AS verified, CASE WHEN place = 1 THEN 'https://alt.example.org/' || doc_id ELSE 'https://main.example.org/' || doc_id END AS url,
      CASE WHEN place = 0 AND doc_id % 4 = 1 THEN DATE '2024-03-01' ELSE published END AS published, CASE WHEN place IS NULL THEN 0 ELSE len(body) END::INT AS body_length FROM pick""",
)
def verified_pages(spark, sf_dir):
    doc = F.col("doc_id").cast("string")
    main, alt = F.concat(F.lit("https://main.example.org/"), doc), F.concat(F.lit("https://alt.example.org/"), doc)
    base = articles(spark, sf_dir).filter("body != ''")
    items = base.select(
        doc.alias("id"), main.alias("url"), "source", F.array(main, alt).alias("source_urls"), "published",
        F.lit("listing").alias("date_evidence"), F.lit("search").alias("summary_kind"), "summary",
    )
    stated = F.col("doc_id") % 4 == 1
    page = lambda url, keep: base.filter(keep).select(
        url.alias("url"), F.lit("reader").alias("name"), "body", "summary",
        F.when(stated, F.to_date(F.lit("2024-03-01"))).alias("published"), F.when(stated, F.lit("article_meta")).otherwise(F.lit("no_date_hint")).alias("date_evidence"),
    )
    read = page(main, "doc_id % 3 != 0").unionByName(page(alt, "doc_id % 2 = 0").withColumn("published", F.lit(None).cast("date")))
    return events.verified_pages(items, read).select("id", "verified", "url", "published", F.length("body").alias("body_length"))


@query(
    "thin_enrichment",
    with_sql(ARTICLES)
    + r"""SELECT doc_id::VARCHAR AS id, CASE WHEN len(body) >= 300 THEN '' WHEN doc_id % 2 = 0 THEN body ELSE '' END AS summary,
        CASE WHEN len(body) >= 300 THEN len(body) WHEN doc_id % 2 = 0 AND us THEN len(body) ELSE greatest(len(body), 400) END::INT AS body_length
      FROM (SELECT *, len(s) >= 12 AND s <> 'x' AND len(regexp_replace(s, '[^A-Za-z一-鿿]', '', 'g')) >= 8 AND NOT regexp_matches(s, '^[\d.+\-$]') AS us
        FROM (SELECT *, trim(regexp_replace(body, '\s+', ' ', 'g')) AS s FROM articles))""",
)
def thin_enrichment(spark, sf_dir):
    doc = F.col("doc_id").cast("string")
    url = F.concat(F.lit("https://thin.example.org/"), doc)
    base = articles(spark, sf_dir)
    items = base.select(
        doc.alias("id"), url.alias("url"), F.lit("x").alias("title"), F.lit("").alias("summary"), "body", F.array(url, F.concat(url, F.lit("/b"))).alias("source_urls")
    )
    search = base.filter("doc_id % 2 = 0").select(url.alias("url"), F.col("body").alias("summary"))
    pages = base.select(F.concat(url, F.lit("/b")).alias("url"), F.repeat(F.lit("y"), 400).alias("body"), F.lit("").alias("summary"))
    return events.enrich_thin(items, search, pages).select("id", "summary", F.length("body").alias("body_length"))


def _parsed(spark, sf_dir):
    today = F.to_date(F.lit("2024-02-05"))
    return articles(spark, sf_dir).withColumn(
        "date_evidence", F.when(F.col("published").isNotNull(), F.lit("listing")).when(F.col("doc_id") % 2 == 0, F.lit("hint_unparsed")).otherwise(F.lit("no_date_hint"))
    ).withColumn("kept", F.col("published").isNull() | dates.in_window(today, F.col("published"), F.lit(30)))


COVERAGE = f"""parsed AS (SELECT *, CASE WHEN published IS NOT NULL THEN 'listing' WHEN doc_id % 2 = 0 THEN 'hint_unparsed' ELSE 'no_date_hint' END AS date_evidence,
    published IS NULL OR DATE '2024-02-05' - published BETWEEN 0 AND 29 AS kept FROM articles),
cov AS (SELECT source, count(*) AS parsed, count(published) AS dated_at_listing, count(*) FILTER (WHERE date_evidence = 'hint_unparsed') AS hint_unparsed,
    count(*) FILTER (WHERE date_evidence = 'no_date_hint') AS no_date_hint, count(*) FILTER (WHERE kept) AS returned,
    count(*) FILTER (WHERE kept AND published IS NOT NULL) AS dated, {scores.sql_rounded('count(published) * 100 / count(*)', 1)} AS date_rate_pct FROM parsed GROUP BY source)"""


@query(
    "source_coverage",
    with_sql(ARTICLES, COVERAGE)
    + """SELECT c.*, coalesce(d.checked, 0) AS detail_checked, coalesce(d.resolved, 0) AS detail_date_resolved, coalesce(d.failed, 0) AS detail_read_failed
    FROM cov c LEFT JOIN (SELECT source, count(*) AS checked, count(*) FILTER (WHERE doc_id % 3 = 0) AS resolved, count(*) FILTER (WHERE doc_id % 5 = 1) AS failed
      FROM parsed WHERE published IS NULL GROUP BY source) d USING (source)""",
)
def source_coverage(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    checks = parsed.filter("published IS NULL").select(
        "source", F.when(F.col("doc_id") % 5 == 1, F.lit("read_failed")).otherwise(F.col("date_evidence")).alias("status"), (F.col("doc_id") % 3 == 0).alias("dated")
    )
    return coverage.with_detail_checks(coverage.date_coverage(parsed, "source"), checks, "source").drop("detail_hint_unparsed", "detail_no_date_hint")


@query(
    "source_probe",
    with_sql(ARTICLES, PLACES, RULE_ROWS)
    + """, r AS (SELECT *, doc_id IN (SELECT doc_id FROM hits) AS hit FROM articles)
    SELECT source, count(*) AS parsed, count(published) AS dated, count(*) FILTER (WHERE hit) AS relevant, (list(url ORDER BY hit DESC, doc_id))[1] AS sample_url FROM r GROUP BY source""",
)
def source_probe(spark, sf_dir):
    matched = matching.match_rules(articles(spark, sf_dir), dim.RULES)
    return coverage.source_probe(matched, "source", "doc_id").select("source", "parsed", "dated", "relevant", F.col("sample.url").alias("sample_url"))


@query(
    "selection_funnel",
    with_sql(ARTICLES)
    + """SELECT profile_id, count(*) AS pool, count(*) FILTER (WHERE published IS NOT NULL) AS eligible, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS accepted,
      count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels) AND category = '行业') AS analysed_industry, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels) AND category = '资本') AS analysed_capital,
      count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels) AND category = '政策') AS analysed_policy, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels) AND category = '学术') AS analysed_academic
    FROM articles GROUP BY profile_id""",
)
def selection_funnel(spark, sf_dir):
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = articles(spark, sf_dir).join(labels, "doc_id", "left").select(
        "profile_id", "category", F.col("published").isNotNull().alias("eligible"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("accepted"),
        F.col("quality").isNotNull().alias("analysed"),
    )
    return coverage.selection_funnel(rows, ["profile_id"])


@query(
    "issue_log",
    with_sql(OBSERVATIONS)
    + "SELECT day, 'collect' AS stage, CASE WHEN value > 10 THEN 'timeout' ELSE 'missing_date' END AS detail, count(*) AS n FROM observations WHERE status = 'error' AND day >= DATE '2024-04-15' - 90 GROUP BY ALL",
)
def issue_log(spark, sf_dir):
    issues = observations(spark, sf_dir).filter("status = 'error'").select(
        "day", F.lit("collect").alias("stage"), F.when(F.col("value") > 10, F.lit("timeout")).otherwise(F.lit("missing_date")).alias("detail")
    )
    return coverage.issues_by_stage(ledger.expire(issues, F.to_date(F.lit("2024-04-15")), fixed.ERROR_DAYS))


@query(
    "first_wins_distinct",
    with_sql(ARTICLES) + "SELECT url, min(doc_id) AS doc_id, arg_min(title, doc_id) AS title FROM articles GROUP BY url",
)
def first_wins_distinct(spark, sf_dir):
    return ledger.first_by_order(articles(spark, sf_dir).select("url", "doc_id", "title"), ["url"], ["doc_id"])


@query(
    "launch_candidates",
    with_sql(ARTICLES)
    + r"""SELECT doc_id, len(word) BETWEEN 2 AND 80 AND doc_id % 3 <> 0 AND doc_id % 4 <> 0 AS launch,
      regexp_matches(lower(body), '发布|推出|launch(ed|es)?|unveil(ed|s)?|introduc(ed|es)') AS mentions
    FROM (SELECT *, regexp_extract(title, '(\p{L}{3,})', 1) AS word FROM articles)""",
)
def launch_candidates(spark, sf_dir):
    doc, word = F.col("doc_id"), first_word(F.col("title"))
    product = F.when(doc % 4 == 0, F.lit("absent product 9")).otherwise(word)
    launch = gates.confirmed_launch(doc % 3 != 0, product, F.lit("Maker"), F.lit("Maker"), F.concat_ws(" ", "title", "body"))
    return articles(spark, sf_dir).select("doc_id", launch.alias("launch"), gates.launch_candidate(F.col("body")).alias("mentions"))
