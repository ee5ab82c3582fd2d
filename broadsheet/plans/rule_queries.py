"""Rule matching, interest profiles and admission gates over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import dates, scores, text
from broadsheet.operators import gates, matching
from broadsheet.plans import dimensions as dim
from broadsheet.plans.registry import query
from broadsheet.sources import payloads
from broadsheet.plans.tables import (
    ARTICLES, ASSESSMENTS, articles, assessments, first_word, sql_host, sql_normal, with_sql,
)


def _sql_rule(rule: dict, place: str = "w") -> str:
    groups = []
    for group in rule["groups"]:
        terms = "|".join(text.py_normalize(t) for t in group)
        groups.append(f"regexp_matches({place}, '(^|[^a-z0-9])({terms})($|[^a-z0-9])')")
    return "(" + " AND ".join(groups) + ")"


PLACES = f"""places AS (SELECT doc_id, {sql_normal("w")} AS w FROM (
    SELECT doc_id, unnest(list_concat([title, summary, title || ' ' || substr(summary, 1, 500)],
      list_transform(list_filter(regexp_split_to_array(body, '[\\n。！？!?]+'), lambda p: trim(p) <> ''),
        lambda p: substr(p, 1, 800)))) AS w FROM articles))"""
RULE_ROWS = "hits AS (" + " UNION ".join(
    f"SELECT doc_id, '{r['id']}' AS rule_id, {r['weight']} AS weight, {str(r['exploration']).upper()} AS exploration, "
    f"'{r['groups'][0][0]}' AS tag FROM places WHERE {_sql_rule(r)}"
    for r in dim.RULES
) + ")"


#: A summary that may be shown as it is.
_TOLD = "研究团队发布了新的可穿戴设备，并说明了试验的结果和上市时间。"


@query("rule_matches", with_sql(ARTICLES, PLACES, RULE_ROWS) + "SELECT doc_id, rule_id, weight FROM hits")
def rule_matches(spark, sf_dir):
    matched = matching.match_rules(articles(spark, sf_dir), dim.RULES)
    return matched.select("doc_id", F.explode("matches").alias("m")).select(
        "doc_id", F.col("m.id").alias("rule_id"), F.col("m.weight").alias("weight")
    )


@query("rule_table_matches", with_sql(ARTICLES, PLACES, RULE_ROWS) + "SELECT doc_id, rule_id FROM hits")
def rule_table_matches(spark, sf_dir):
    """The same matches with the rules as a table joined on terms."""
    rules = spark.createDataFrame([(r["id"], r["groups"]) for r in dim.RULES], "id string, groups array<array<string>>")
    return matching.match_rule_table(articles(spark, sf_dir), "doc_id", rules)


GATED = f"""gated AS (
  SELECT a.*, coalesce((SELECT max(weight) FROM hits h WHERE h.doc_id = a.doc_id), 0)::DOUBLE AS score,
    (SELECT count(*) FROM hits h WHERE h.doc_id = a.doc_id) AS n_hits,
    coalesce((SELECT bool_and(exploration) FROM hits h WHERE h.doc_id = a.doc_id), FALSE) AS exploration,
    CASE WHEN category = '政策' THEN '政策' WHEN category = '学术' OR contains(url, 'arxiv.org') THEN '学术'
         WHEN regexp_matches(head, '(?i)融资|并购|收购|天使轮|种子轮|[ABCDEF]轮|funding|raises|acquisition') THEN '资本'
         WHEN regexp_matches(head, '(?i)论文|研究团队|研究者|实验组|试验|准确率|解码|模型|dataset|decoding|accuracy|paper|study')
          AND NOT regexp_matches(head, '(?i)融资|新品|SDK|产品发布|版本更新|release|launch|studio') THEN '学术'
         ELSE '行业' END AS hinted
  FROM (SELECT *, title || ' ' || substr(summary, 1, 300) AS head FROM articles) a
  WHERE url <> '' AND NOT regexp_matches({sql_normal("title || ' ' || summary")}, '(^|[^a-z0-9])(asthnt|spam)($|[^a-z0-9])'))"""


@query(
    "prepared_items",
    with_sql(ARTICLES, PLACES, RULE_ROWS, GATED)
    + """SELECT g.doc_id, n_hits > 0 AS accepted, hinted AS category, exploration, score,
      coalesce((SELECT string_agg(tag, '|' ORDER BY weight DESC, rule_id) FROM
        (SELECT * FROM hits h WHERE h.doc_id = g.doc_id ORDER BY weight DESC LIMIT 3)), '') AS tags FROM gated g""",
)
def prepared_items(spark, sf_dir):
    out = gates.prepare(articles(spark, sf_dir), dim.RULES, dim.EXCLUDED)
    return out.select("doc_id", "accepted", "category", "exploration", "score", F.array_join("tags", "|").alias("tags"))


def channel_items(spark, sf_dir):
    """Documents as channel entries: a channel per source group, tags from the summary's first words."""
    doc = F.col("doc_id")
    channels = F.array(*[F.lit(c) for c in dim.CHANNELS])
    return articles(spark, sf_dir).select(
        "doc_id", "title", "summary", F.col("body").alias("content"), "source", "url",
        F.array("source", "profile_id").alias("tags"),
        F.element_at(channels, (F.substring("source", 4, 3).cast("int") % 5 + 1)).alias("channel_id"),
        (F.unix_timestamp(F.to_timestamp(F.lit("2024-01-01 00:00:00"))) + doc * 977 % 2592000).alias("ts"),
    )


CHANNEL_ITEMS = """items AS (
  SELECT doc_id, title, summary, body AS content, source, url, profile_id AS lang,
    ['news', 'blogs', 'academic', 'products', 'security'][substr(source, 4, 3)::INT % 5 + 1] AS channel_id,
    1704067200 + doc_id * 977 % 2592000 AS ts FROM articles)"""


def _sql_interest(interest: str) -> str:
    terms = "|".join(text.interest_terms(interest))
    rx = f"'(^|[^a-z0-9])({terms})($|[^a-z0-9])'"
    return (
        f"CASE WHEN regexp_matches(nt, {rx}) THEN 30 WHEN regexp_matches(ng, {rx}) THEN 20 "
        f"WHEN regexp_matches(nb, {rx}) THEN 10 ELSE 0 END"
    )


def _sql_profile(p: dict) -> str:
    points = " + ".join(_sql_interest(i) for i in p["interests"])
    names = ", ".join(f"CASE WHEN {_sql_interest(i)} > 0 THEN '{i}' END" for i in p["interests"])
    barred = "|".join(text.py_normalize(w) for w in p["exclude"])
    where = f"WHERE NOT regexp_matches(everything, '(^|[^a-z0-9])({barred})($|[^a-z0-9])')" if barred else ""
    return (
        f"SELECT '{p['profile_id']}' AS profile_id, doc_id, channel_id, source, title, ts, least(100, {points}) AS rule_score, "
        f"list_filter([{names}], lambda x: x IS NOT NULL) AS matched FROM normal {where}"
    )


INTERESTS = (
    f"""normal AS (SELECT *, nt || ' ' || ng || ' ' || nb AS everything FROM (
      SELECT *, {sql_normal("title")} AS nt, {sql_normal("source || ' ' || lang")} AS ng,
        {sql_normal("summary || ' ' || content")} AS nb FROM items)), """
    + "scored AS (" + " UNION ALL ".join(_sql_profile(p) for p in dim.PROFILES) + ")"
)


@query(
    "interest_scores",
    with_sql(ARTICLES, CHANNEL_ITEMS, INTERESTS)
    + "SELECT profile_id, doc_id, rule_score, array_to_string(matched, '|') AS matched FROM scored",
)
def interest_scores(spark, sf_dir):
    scored = matching.score_interests(channel_items(spark, sf_dir), dim.PROFILES)
    return scored.select("profile_id", "doc_id", "rule_score", F.array_join("matched_keywords", "|").alias("matched"))


@query(
    "window_filter",
    with_sql(ARTICLES)
    + """SELECT doc_id, published, DATE '2024-02-05' - published AS age,
      CASE WHEN published IS NULL OR NOT (DATE '2024-02-05' - published BETWEEN 0 AND 29) THEN 0.0
        WHEN DATE '2024-02-05' - published < 1 THEN 1.0 WHEN DATE '2024-02-05' - published < 3 THEN 0.8
        WHEN DATE '2024-02-05' - published < 7 THEN 0.45 WHEN DATE '2024-02-05' - published < 14 THEN 0.2 ELSE 0.05 END::DOUBLE AS freshness
    FROM articles WHERE published IS NULL OR DATE '2024-02-05' - published BETWEEN 0 AND 29""",
)
def window_filter(spark, sf_dir):
    today = F.to_date(F.lit("2024-02-05"))
    kept = gates.fresh_collection(articles(spark, sf_dir), today, F.lit(30))
    return kept.select(
        "doc_id", "published", F.datediff(today, "published").alias("age"),
        scores.freshness(today, F.col("published")).alias("freshness"),
    )


def assessed(spark, sf_dir):
    """Articles with their assessment columns; unassessed rows keep NULLs."""
    found = assessments(spark, sf_dir).select(
        "doc_id", F.col("relevance").alias("a_relevance"), F.col("accept").alias("a_accept"),
        F.col("source_kind").alias("a_source_kind"),
    )
    return (
        articles(spark, sf_dir)
        .join(found, "doc_id", "left")
        .withColumn("a_category", F.col("category"))
        .withColumn("a_companies", F.array(first_word(F.col("title")), F.lit("公司")))
        .withColumn("a_subject", first_word(F.col("title")))
        .withColumn("a_tags", F.array(F.substring("title", 1, 30), F.lit("[x]")))
        .withColumn("date_evidence", F.when(F.col("published").isNull(), F.lit("recent_first_seen")).otherwise(F.lit("listing")))
    )


GATE_SQL = f"""assessed AS (
  SELECT a.*, s.relevance AS a_relevance, s.accept AS a_accept, s.source_kind,
    regexp_extract(title, '([\\p{{L}}]{{3,}})', 1) AS word,
    least(100.0::DOUBLE, greatest(0.0::DOUBLE, s.relevance::DOUBLE * CASE WHEN category = '学术' THEN 1.0 ELSE 1.2 END::DOUBLE)) AS effective
  FROM articles a LEFT JOIN assessments s USING (doc_id)),
gate AS (SELECT *, coalesce(a_accept AND effective >= 60 AND (published IS NOT NULL OR category IN ('行业', '资本'))
    AND (category <> '政策' OR regexp_matches({sql_host("url")}, '(^|\\.)gov\\.cn$')) AND source_kind <> 'unknown', FALSE) AS accepted
  FROM assessed)"""


@query(
    "assessment_gate",
    with_sql(ARTICLES, PLACES, RULE_ROWS, ASSESSMENTS, GATE_SQL)
    + f""", blend AS (SELECT *, weight * 0.6::DOUBLE + least(100, greatest(0, a_relevance)) * 0.4::DOUBLE AS mixed FROM
        (SELECT g.*, coalesce((SELECT max(weight) FROM hits h WHERE h.doc_id = g.doc_id), 0)::DOUBLE AS weight FROM gate g))
    SELECT doc_id, accepted, effective, coalesce(source_kind, 'unknown') AS source_kind,
      CASE WHEN a_relevance IS NULL THEN weight ELSE {scores.sql_rounded("mixed", 2)} END AS score,
      CASE WHEN len(word) >= 2 THEN word ELSE '' END AS companies, CASE WHEN len(word) >= 2 THEN word ELSE '' END AS subject FROM blend""",
)
def assessment_gate(spark, sf_dir):
    matched = matching.match_rules(assessed(spark, sf_dir), dim.RULES)
    priority = F.coalesce(matching.top_weight(F.col("matches")), F.lit(0))
    return gates.apply_assessment(matched, priority).select(
        "doc_id", "accepted", "effective", "source_kind", "score", F.array_join("companies", "|").alias("companies"), "subject"
    )


def _payloads(spark, sf_dir):
    """Assessor replies as JSON text, with the faults an assessor makes: repeats, strangers, bad types."""
    rows = assessments(spark, sf_dir)
    doc = F.col("doc_id")
    relevance = F.when(doc % 13 == 0, F.lit('"eighty"')).when(doc % 17 == 0, F.lit("180")).otherwise(
        F.col("relevance").cast("string")
    )
    category = F.when(doc % 11 == 0, F.lit("其他")).otherwise(F.lit("行业"))
    tags = F.when(doc % 23 == 0, F.lit("[1]")).otherwise(F.lit('["a"]'))
    body = F.concat(
        F.lit('{"relevance": '), relevance, F.lit(', "accept": true, "category": "'), category,
        F.lit('", "tags": '), tags, F.lit("}"),
    )
    once = rows.select(
        F.when(doc % 29 == 0, F.concat(F.lit("x"), doc.cast("string"))).otherwise(doc.cast("string")).alias("id"),
        body.alias("payload"),
        F.when(doc % 7 == 0, F.lit(2)).otherwise(F.lit(1)).alias("times"),
    )
    return once.select("id", "payload", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


@query(
    "assessment_issues",
    """WITH s AS (SELECT CASE WHEN doc_id % 29 = 0 THEN 'x' || doc_id ELSE doc_id::VARCHAR END AS id, doc_id FROM labels),
      k AS (SELECT doc_id::VARCHAR AS id FROM documents)
    SELECT coalesce(s.id, k.id) AS id, CASE WHEN k.id IS NULL THEN 'unknown_id' WHEN s.id IS NULL THEN 'missing'
      WHEN doc_id % 7 = 0 THEN 'duplicate_id' WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 'invalid_score'
      WHEN doc_id % 11 = 0 THEN 'invalid_category' WHEN doc_id % 23 = 0 THEN 'invalid_tags' END AS issue
    FROM s FULL JOIN k ON s.id = k.id""",
)
def assessment_issues(spark, sf_dir):
    known = articles(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"))
    return gates.assessment_issues(_payloads(spark, sf_dir), known)


@query(
    "event_review_issues",
    with_sql(ARTICLES)
    + r"""SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'event_date_unsubstantiated'
        WHEN doc_id % 6 = 2 THEN 'roundup_focus_unsubstantiated'
        WHEN doc_id % 6 = 3 THEN 'event_category_invalid'
        WHEN doc_id % 6 = 4 THEN 'no_single_relevant_event' END AS issue FROM articles""",
)
def event_review_issues(spark, sf_dir):
    """Reviews derived from the articles themselves, one fault per residue class."""
    doc, blank = F.col("doc_id"), F.lit("")
    reviews = articles(spark, sf_dir).select(
        "doc_id", "title", "body",
        F.col("seen_day").alias("page_day"),
        F.lit(True).alias("relevant"),
        (doc % 6 != 4).alias("single_event"),
        F.when(doc % 6 == 1, F.col("seen_day")).alias("event_day"),
        F.when(doc % 6 == 1, F.substring("title", 1, 12)).otherwise(blank).alias("date_quote"),
        F.when(doc % 6 == 2, F.concat(F.lit("\u0001"), "title")).otherwise(blank).alias("focus_quote"),
        first_word(F.col("title")).alias("subject"),
        F.when(doc % 6 == 3, F.lit("其他")).otherwise(F.lit("行业")).alias("category"),
        F.array(first_word(F.col("body"))).alias("tags"),
    )
    short = reviews.withColumn("subject", F.substring("subject", 1, 80)).withColumn(
        "tags", F.transform("tags", lambda t: F.substring(t, 1, 18))
    )
    return gates.review_issues(short).select("doc_id", "issue")


@query(
    "signal_tiers",
    with_sql(ARTICLES)
    + r"""SELECT doc_id, CASE WHEN regexp_matches(seen, '(?i)\b(eeg|bci|ecog)\b|brain.computer|neurofeedback|dry electrode') THEN 3
       WHEN regexp_matches(seen, '(?i)headphones?|headsets?|earbuds?') AND regexp_matches(seen, '(?i)education|classroom|learning|attention|sleep|emotion|affective|cognitive') THEN 2
       ELSE 0 END AS tier FROM (SELECT doc_id, title || ' ' || substr(summary, 1, 2000) || ' ' || substr(body, 1, 1000) AS seen FROM articles)""",
)
def signal_tiers(spark, sf_dir):
    c = F.col
    return articles(spark, sf_dir).select(
        "doc_id", gates.signal_tier(c("title"), c("summary"), c("body"), c("url"), F.lit(False)).alias("tier")
    )


@query(
    "channel_score_issues",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'score' WHEN doc_id % 7 = 0 THEN 'empty' WHEN doc_id % 11 <> 0 THEN 'language' END AS issue FROM documents""",
)
def channel_score_issues(spark, sf_dir):
    doc = F.col("doc_id")
    rows = articles(spark, sf_dir).select(
        "doc_id",
        F.when(doc % 5 == 0, F.lit("7.5")).otherwise((doc % 11).cast("string")).alias("relevance"),
        F.lit("4").alias("novelty"),
        F.when(doc % 7 == 0, F.lit(" ")).when(doc % 11 == 0, F.lit("摘要内容")).otherwise(F.concat("source", F.lit(" text"))).alias("digest"),
        F.when(doc % 11 == 0, F.lit("推荐理由")).otherwise(F.concat("source", F.lit(" why"))).alias("reason"),
    )
    c = F.col
    return rows.select("doc_id", gates.channel_score_issue(c("relevance"), c("novelty"), c("digest"), c("reason")).alias("issue"))


@query(
    "company_keys",
    with_sql(ARTICLES)
    + """SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(
        CASE WHEN regexp_matches(title || ' ' || summary, '(?i)(^|[^A-Za-z])(Apple|苹果公司|苹果)($|[^A-Za-z])') THEN ['apple'] ELSE [] END,
        CASE WHEN regexp_matches(title || ' ' || summary, '(?i)(^|[^A-Za-z])(Muse|InteraXon)($|[^A-Za-z])') THEN ['muse'] ELSE [] END,
        CASE WHEN doc_id % 5 = 0 THEN ['muse'] ELSE [] END,
        [replace(lower(regexp_extract(title, '(\\p{L}{3,})', 1)), 'ß', 'ss')]))), '|') AS companies FROM articles""",
)
def company_keys(spark, sf_dir):
    named = F.when(F.col("doc_id") % 5 == 0, F.array(first_word(F.col("title")), F.lit("INTERAXON"))).otherwise(F.array(first_word(F.col("title"))))
    keys = gates.company_keys(F.col("title"), F.col("summary"), named)
    return articles(spark, sf_dir).select("doc_id", F.array_join(keys, "|").alias("companies"))


@query(
    "estimated_relevance",
    with_sql(ARTICLES, PLACES, RULE_ROWS)
    + """SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)eeg|electroencephal') AND regexp_matches(t, '(?i)emotion recognition|affective computing|emotion decoding') THEN 85
        ELSE coalesce((SELECT max(weight) FROM hits h WHERE h.doc_id = a.doc_id), 20) END::INT AS relevance
      FROM (SELECT *, title || ' ' || substr(summary, 1, 2000) AS t FROM articles) a""",
)
def estimated_relevance(spark, sf_dir):
    matched = matching.match_rules(articles(spark, sf_dir), dim.RULES)
    seen = F.concat(F.col("title"), F.lit(" "), F.substring("summary", 1, 2000))
    return matched.select("doc_id", scores.estimated_relevance(seen, matching.top_weight(F.col("matches"))).alias("relevance"))


@query(
    "first_seen_proxy",
    with_sql(ARTICLES)
    + """SELECT doc_id, CASE WHEN published IS NULL AND doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN seen_day ELSE published END AS published,
      CASE WHEN published IS NULL AND doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN 'recent_first_seen' WHEN doc_id % 3 = 0 THEN 'hint_unparsed' ELSE 'no_date_hint' END AS date_evidence FROM articles""",
)
def first_seen_proxy(spark, sf_dir):
    items = articles(spark, sf_dir).select(
        F.col("doc_id").alias("id"), "published", F.lit(None).cast("date").alias("first_reported"), F.lit("no_date_hint").alias("listed_evidence"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("hint_unparsed")).otherwise(F.lit("no_date_hint")).alias("date_evidence"),
    )
    trusted = articles(spark, sf_dir).filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("seen_day").alias("first_seen"))
    return gates.first_seen_proxy(items, trusted).select(F.col("id").alias("doc_id"), "published", "date_evidence")


@query(
    "summary_evidence",
    with_sql(ARTICLES, PLACES, RULE_ROWS)
    + f""", own AS (SELECT doc_id, list(rule_id) AS ids FROM hits GROUP BY doc_id),
      lines AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS i FROM articles),
      seen AS (SELECT *, {sql_normal("substr(line, 1, 800)")} AS w FROM lines LEFT JOIN own USING (doc_id))
    SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN '{_TOLD}' ELSE substr(coalesce(string_agg(line, chr(10) ORDER BY i), ''), 1, 6000) END) AS evidence
    FROM seen WHERE doc_id % 3 = 0 OR i < 4 OR {" OR ".join(f"(list_contains(ids, '{r['id']}') AND {_sql_rule(r)})" for r in dim.RULES)} GROUP BY doc_id""",
)
def summary_evidence(spark, sf_dir):
    """Evidence texts, compared by digest; every third item comes with a usable summary."""
    told = F.when(F.col("doc_id") % 3 == 0, F.lit(_TOLD)).otherwise(F.lit(""))
    matched = matching.match_rules(articles(spark, sf_dir), dim.RULES)
    items = matched.withColumn("rule_ids", F.transform("matches", lambda m: m["id"])).withColumn("summary", told)
    return gates.summary_evidence(items, dim.RULES).select("doc_id", F.sha2("evidence", 256).alias("evidence"))


@query(
    "strict_freshness",
    with_sql(ARTICLES)
    + """, dated AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN seen_day - 3 END AS event_day, CASE WHEN doc_id % 4 = 1 THEN seen_day - 5 END AS first_reported,
        CASE WHEN doc_id % 20 = 1 THEN seen_day + 4 WHEN doc_id % 30 <> 11 THEN seen_day - 4 END AS first_submitted, seen_day AS last_revised FROM articles)
    SELECT doc_id FROM dated WHERE (published IS NULL OR DATE '2024-02-05' - coalesce(event_day, first_reported, published) BETWEEN 0 AND 6)
      AND (doc_id % 10 <> 1 OR coalesce(first_submitted <= last_revised AND published = last_revised, FALSE))""",
)
def strict_freshness(spark, sf_dir):
    """Collection under strict dates: event day before first report before publication, papers by their proven version date."""
    doc, day = F.col("doc_id"), F.col("seen_day")
    rows = articles(spark, sf_dir).withColumns({
        "event_day": F.when(doc % 4 == 0, F.date_sub(day, 3)), "first_reported": F.when(doc % 4 == 1, F.date_sub(day, 5)),
        "first_submitted": F.when(doc % 20 == 1, F.date_add(day, 4)).when(doc % 30 != 11, F.date_sub(day, 4)), "last_revised": day,
    })
    return gates.fresh_collection(rows, F.to_date(F.lit("2024-02-05")), F.lit(7), strict=True).select("doc_id")


@query(
    "broad_listing_reads",
    with_sql(ARTICLES)
    + """SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM articles
      WHERE published IS NULL AND regexp_matches(title || ' EEG ' || substr(summary, 1, 500), '(?i)\\bEEG\\b')) WHERE n <= 6""",
)
def broad_listing_reads(spark, sf_dir):
    rows = articles(spark, sf_dir).withColumn("title", F.concat("title", F.lit(" EEG")))
    return payloads.broad_listing_reads(rows, ["source"], "doc_id").select("doc_id", "source")


@query(
    "channel_fallbacks",
    with_sql(ARTICLES, CHANNEL_ITEMS, INTERESTS)
    + """SELECT profile_id, doc_id, greatest(0, least(10, round_even(rule_score / 10, 0)))::INT AS relevance_score,
      CASE WHEN len(matched) = 0 THEN '根据规则排序入选。' ELSE '命中关注词：' || array_to_string(matched[1:3], '、') || '。' END AS reason FROM scored""",
)
def channel_fallbacks(spark, sf_dir):
    scored = matching.score_interests(channel_items(spark, sf_dir), dim.PROFILES)
    c = F.col
    made = gates.fallback_assessment(c("rule_score"), c("matched_keywords"), c("summary"), c("content"), c("title"))
    return scored.select("profile_id", "doc_id", made["relevance_score"].alias("relevance_score"), made["reason"].alias("reason"))


@query(
    "channel_scorers",
    with_sql(ARTICLES, CHANNEL_ITEMS)
    + "SELECT doc_id, CASE channel_id WHEN 'academic' THEN len(content) WHEN 'products' THEN len(title) * 2 ELSE len(title) END::INT AS channel_score FROM items",
)
def channel_scorers(spark, sf_dir):
    """A scorer per channel, each a function from the items to a column."""
    scorers = {"academic": lambda items: F.length(items["content"]), "products": lambda items: F.length(items["title"]) * 2}
    scored = matching.with_channel_scores(channel_items(spark, sf_dir), scorers, lambda items: F.length(items["title"]))
    return scored.select("doc_id", "channel_score")
