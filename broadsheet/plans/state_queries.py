"""Ledger and retention jobs over the event stream and the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions import scores, text
from broadsheet.operators import gates, ledger
from broadsheet.plans.registry import query
from broadsheet.plans.tables import (
    ARTICLES, ASSESSMENTS, OBSERVATIONS, articles, assessments, load, observations, sql_title_key, with_sql,
)


def _today():
    return F.to_date(F.lit("2024-02-05"))


def keyed_articles(spark, sf_dir):
    return articles(spark, sf_dir).withColumn("id", F.col("doc_id").cast("string")).withColumn("source_urls", F.array("url"))


def deliveries(spark, sf_dir):
    """Delivery marks: ten consecutive events each belong to one document, the latest status counts."""
    status = F.when(F.col("event_type") == "purchase", F.lit("sent")).when(F.col("event_type") == "signup", F.lit("pending")).otherwise(F.lit("failed"))
    marks = load(spark, sf_dir, "events").select(
        F.expr("event_id div 10").alias("doc_id"), F.col("event_id").alias("seq"), F.to_date("ts").alias("day"), status.alias("status")
    )
    keyed = keyed_articles(spark, sf_dir).select(
        "doc_id", "category", text.digest(F.concat(F.lit("url:"), F.col("url"))).alias("alias")
    )
    rows = marks.join(keyed, "doc_id").select("alias", "day", "status", "seq", "category")
    empty = rows.drop("category").limit(0)
    return ledger.mark(empty, rows.drop("category")), ledger.mark(empty, rows.filter("category = '政策'").drop("category"))


DELIVERIES = """marks AS (SELECT sha256('url:' || a.url) AS alias, a.category, e.event_id AS seq, e.ts::DATE AS day,
    CASE event_type WHEN 'purchase' THEN 'sent' WHEN 'signup' THEN 'pending' ELSE 'failed' END AS status
  FROM events e JOIN articles a ON e.event_id // 10 = a.doc_id),
delivered AS (SELECT alias, arg_max(day, seq) AS day, arg_max(status, seq) AS status FROM marks GROUP BY alias),
policy_delivered AS (SELECT alias, arg_max(day, seq) AS day, arg_max(status, seq) AS status FROM marks WHERE category = '政策' GROUP BY alias),
sent AS (SELECT alias FROM delivered WHERE status IN ('sent', 'pending') UNION SELECT alias FROM policy_delivered WHERE status IN ('sent', 'pending'))"""


@query("delivery_ledger", with_sql(ARTICLES, DELIVERIES) + "SELECT alias, day, status FROM delivered")
def delivery_ledger(spark, sf_dir):
    return deliveries(spark, sf_dir)[0].select("alias", "day", "status")


@query(
    "delivered_antijoin",
    with_sql(ARTICLES, DELIVERIES)
    + "SELECT doc_id, category FROM articles WHERE sha256('url:' || url) NOT IN (SELECT alias FROM sent)",
)
def delivered_antijoin(spark, sf_dir):
    delivered, policy = deliveries(spark, sf_dir)
    return ledger.undelivered(keyed_articles(spark, sf_dir), "doc_id", delivered, policy).select("doc_id", "category")


def tombstones(spark, sf_dir):
    """Title fingerprints of the benchmark passages' opening lines and of every toxic document."""
    toxic = load(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    titles = articles(spark, sf_dir).join(toxic, "doc_id", "left_semi")
    return titles.select(text.digest(F.concat(F.lit("title:"), text.title_key(F.col("title")))).alias("alias")).distinct()


TOMBSTONES = f"""tombstones AS (SELECT DISTINCT sha256('title:' || {sql_title_key("title")}) AS alias FROM articles
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


@query(
    "tombstone_antijoin",
    with_sql(ARTICLES, TOMBSTONES)
    + f"SELECT doc_id FROM articles WHERE sha256('title:' || {sql_title_key('title')}) NOT IN (SELECT alias FROM tombstones)",
)
def tombstone_antijoin(spark, sf_dir):
    return ledger.not_tombstoned(keyed_articles(spark, sf_dir), "doc_id", tombstones(spark, sf_dir)).select("doc_id")


@query(
    "ever_seen",
    with_sql(ARTICLES, DELIVERIES, TOMBSTONES, ASSESSMENTS)
    + f"""SELECT doc_id::VARCHAR AS id FROM articles WHERE sha256('url:' || url) IN (SELECT alias FROM sent)
      OR sha256('title:' || {sql_title_key('title')}) IN (SELECT alias FROM tombstones)
      OR doc_id IN (SELECT doc_id FROM assessments)""",
)
def ever_seen(spark, sf_dir):
    delivered, policy = deliveries(spark, sf_dir)
    stored = assessments(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"))
    return ledger.ever_seen(
        keyed_articles(spark, sf_dir), "id", tombstones(spark, sf_dir), ledger.sent_aliases(delivered, policy), stored
    )


def _sightings(spark, sf_dir):
    """Events before mid-month are the stored side, later ones the day's sightings."""
    seen = observations(spark, sf_dir)
    doc = F.col("event_id")
    rows = seen.select(
        F.col("item_id").cast("string").alias("id"), F.col("event_id").alias("seq"), "day",
        F.when(doc % 3 == 0, F.date_sub("day", (doc % 50).cast("int"))).alias("published"),
        F.when(doc % 3 == 0, F.lit("listing")).when(doc % 3 == 1, F.lit("no_date_hint")).otherwise(F.lit("hint_unparsed")).alias("date_evidence"),
        F.when(doc % 5 == 0, F.col("day")).alias("first_reported"),
        F.concat("status", F.lit(" "), F.repeat(F.lit("x"), (doc % 17).cast("int"))).alias("summary"),
        F.when(doc % 4 == 0, F.concat(F.lit("excerpt "), doc.cast("string"))).otherwise(F.lit("")).alias("excerpt"),
        F.when(doc % 97 == 0, F.col("day")).alias("released"),
    )
    return rows.filter("day < '2024-01-15'"), rows.filter("day >= '2024-01-15'")


def _merged(spark, sf_dir):
    stored, new = _sightings(spark, sf_dir)
    return ledger.upsert_candidates(ledger.sightings(stored), ledger.sightings(new)).drop("seq")


SIGHTINGS = """sightings AS (SELECT item_id::VARCHAR AS id, event_id AS seq, day,
    CASE WHEN event_id % 3 = 0 THEN day - (event_id % 50)::INT END AS published,
    CASE event_id % 3 WHEN 0 THEN 'listing' WHEN 1 THEN 'no_date_hint' ELSE 'hint_unparsed' END AS date_evidence,
    CASE WHEN event_id % 5 = 0 THEN day END AS first_reported, status || ' ' || repeat('x', (event_id % 17)::INT) AS summary,
    CASE WHEN event_id % 4 = 0 THEN 'excerpt ' || event_id ELSE '' END AS excerpt,
    CASE WHEN event_id % 97 = 0 THEN day END AS released FROM observations),
candidates AS (SELECT id, min(day) AS first_seen, max(day) AS last_seen,
    (list(summary ORDER BY len(summary) DESC, seq DESC))[1] AS summary,
    coalesce(arg_max(excerpt, seq) FILTER (WHERE excerpt <> ''), '') AS excerpt,
    arg_max(published, seq) FILTER (WHERE published IS NOT NULL) AS published,
    CASE WHEN count(published) > 0 THEN arg_max(date_evidence, seq) FILTER (WHERE published IS NOT NULL) ELSE arg_max(date_evidence, seq) END AS date_evidence,
    arg_max(first_reported, seq) FILTER (WHERE first_reported IS NOT NULL) AS first_reported, min(released) AS released
  FROM sightings GROUP BY id)"""


@query("first_seen_ledger", with_sql(OBSERVATIONS) + "SELECT item_id::VARCHAR AS id, min(day) AS first_seen FROM observations GROUP BY 1")
def first_seen_ledger(spark, sf_dir):
    stored, new = _sightings(spark, sf_dir)
    return ledger.first_seen(stored.select("id", F.col("day").alias("first_seen")), new)


@query("candidate_upsert", with_sql(OBSERVATIONS, SIGHTINGS) + "SELECT * FROM candidates")
def candidate_upsert(spark, sf_dir):
    return _merged(spark, sf_dir)


@query(
    "retention_split",
    with_sql(OBSERVATIONS, SIGHTINGS)
    + """SELECT id, CASE WHEN clock IS NOT NULL AND DATE '2024-02-05' - clock BETWEEN 0 AND 29 THEN 'keep' WHEN undated THEN 'drop' ELSE 'tombstone' END AS fate
    FROM (SELECT id, undated, CASE WHEN undated THEN first_seen ELSE coalesce(first_reported, published) END AS clock
      FROM (SELECT *, published IS NULL OR date_evidence = 'recent_first_seen' AS undated FROM candidates))""",
)
def retention_split(spark, sf_dir):
    merged = _merged(spark, sf_dir)
    return ledger.retention(merged, _today(), 30, True).select("id", "fate")


@query(
    "release_marks",
    with_sql(OBSERVATIONS, SIGHTINGS) + "SELECT id, coalesce(released, DATE '2024-02-05') AS released FROM candidates",
)
def release_marks(spark, sf_dir):
    return ledger.release(_merged(spark, sf_dir), _today()).select("id", "released")


@query(
    "ledger_expiry",
    with_sql(ARTICLES, DELIVERIES)
    + """SELECT alias, day, status FROM delivered WHERE day >= DATE '2025-01-15' - 365 OR status = 'pending'""",
)
def ledger_expiry(spark, sf_dir):
    return ledger.expire_deliveries(deliveries(spark, sf_dir)[0], F.to_date(F.lit("2025-01-15"))).select("alias", "day", "status")


@query(
    "delivery_due",
    with_sql(OBSERVATIONS)
    + """SELECT item_id, last_sent, coalesce(DATE '2024-01-31' - last_sent >= 3, TRUE) AS due FROM
      (SELECT item_id, max(day) FILTER (WHERE status = 'purchase') AS last_sent FROM observations GROUP BY 1)""",
)
def delivery_due(spark, sf_dir):
    sent = observations(spark, sf_dir).withColumn("status", F.when(F.col("status") == "purchase", F.lit("sent")))
    return ledger.delivery_due(sent, ["item_id"], F.to_date(F.lit("2024-01-31")), 3)


@query(
    "exploration_allowance",
    with_sql(OBSERVATIONS)
    + """SELECT item_id, count(*) AS total, count(*) FILTER (WHERE status = 'error') AS explored,
      (floor((count(*) + 7) * 0.1::DOUBLE) - count(*) FILTER (WHERE status = 'error'))::INT AS allowance FROM observations GROUP BY 1""",
)
def exploration_allowance(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("exploration", F.col("status") == "error")
    return ledger.exploration_allowance(rows, ["item_id"], 7, 0.1)


@query(
    "snapshot_diff",
    with_sql(OBSERVATIONS)
    + """SELECT DISTINCT item_id || ':' || status AS id FROM observations WHERE day >= DATE '2024-01-20'
      EXCEPT SELECT item_id || ':' || status FROM observations WHERE day < DATE '2024-01-05'""",
)
def snapshot_diff(spark, sf_dir):
    keyed = observations(spark, sf_dir).withColumn("id", F.concat(F.col("item_id").cast("string"), F.lit(":"), F.col("status")))
    return ledger.added_since(keyed.filter("day >= '2024-01-20'"), keyed.filter("day < '2024-01-05'"), "id")


@query(
    "rolled_back_ledger",
    with_sql(ARTICLES, DELIVERIES)
    + """SELECT d.alias, d.status FROM delivered d WHERE d.alias IN (SELECT alias FROM marks WHERE day < DATE '2024-01-10')""",
)
def rolled_back_ledger(spark, sf_dir):
    """Current ledger without aliases first marked after the earlier snapshot."""
    delivered, _ = deliveries(spark, sf_dir)
    marks = load(spark, sf_dir, "events").filter(F.to_date("ts") < "2024-01-10").select(F.expr("event_id div 10").alias("doc_id"))
    keyed = articles(spark, sf_dir).select("doc_id", text.digest(F.concat(F.lit("url:"), F.col("url"))).alias("alias"))
    prior = keyed.join(marks, "doc_id", "left_semi")
    return ledger.roll_back(delivered, prior, "alias").select("alias", "status")


@query(
    "rolled_back_tables",
    with_sql(OBSERVATIONS)
    + """, marks AS (SELECT item_id::VARCHAR AS k, day, status, CASE status WHEN 'purchase' THEN 'policy_delivered' WHEN 'click' THEN 'reports' WHEN 'view' THEN 'delivered' ELSE 'sent_events' END AS t FROM observations),
      rows AS (SELECT t, k, count(*) AS n, min(day) < DATE '2024-01-12' AS early FROM marks GROUP BY t, k),
      names AS (SELECT unnest(['delivered', 'policy_delivered', 'reports', 'sent_events']) AS t)
    SELECT t AS table_name, k AS key, n, NULL AS removed FROM rows WHERE early
    UNION ALL SELECT t, NULL, NULL, (SELECT count(*) FROM rows WHERE rows.t = names.t AND NOT early) FROM names
    UNION ALL SELECT 'counts', NULL, (SELECT count(*) FROM observations WHERE day < DATE '2024-01-12'), NULL""",
)
def rolled_back_tables(spark, sf_dir):
    """Four delivery tables taken back to an earlier day, what went from each, and the counts of that day."""
    kind = F.when(F.col("status") == "purchase", F.lit("policy_delivered")).when(F.col("status") == "click", F.lit("reports")).when(F.col("status") == "view", F.lit("delivered")).otherwise(F.lit("sent_events"))
    marks = observations(spark, sf_dir).select(F.col("item_id").cast("string").alias("k"), "day", kind.alias("t"))

    def version(rows):
        tables = {
            name: rows.filter(F.col("t") == name).groupBy(F.col("k").alias(key)).agg(F.count(F.lit(1)).alias("n")).withColumn("status", F.lit("sent"))
            for name, key in ledger.DELIVERY_KEYS.items()
        }
        return tables | {"counts": rows.agg(F.count(F.lit(1)).alias("n"))}

    tables, removed = ledger.roll_back_deliveries(version(marks), version(marks.filter("day < '2024-01-12'")))
    nothing = F.lit(None).cast("long")
    out = removed.select(F.col("table").alias("table_name"), F.lit(None).cast("string").alias("key"), nothing.alias("n"), "removed")
    for name, key in ledger.DELIVERY_KEYS.items():
        out = out.unionByName(tables[name].select(F.lit(name).alias("table_name"), F.col(key).alias("key"), "n", nothing.alias("removed")))
    return out.unionByName(tables["counts"].select(F.lit("counts").alias("table_name"), F.lit(None).cast("string").alias("key"), "n", nothing.alias("removed")))


@query(
    "assessment_cache",
    with_sql(ARTICLES, ASSESSMENTS)
    + """SELECT doc_id::VARCHAR AS id, CASE WHEN a.doc_id IN (SELECT doc_id FROM assessments WHERE relevance % 5 <> 0) THEN 'cached' ELSE 'pending' END AS status FROM articles a""",
)
def assessment_cache(spark, sf_dir):
    """Items with an unchanged cached decision against items that need one."""
    evidence = text.digest(F.concat(F.col("title"), F.substring("body", 1, 700)))
    items = keyed_articles(spark, sf_dir).select("id", "doc_id", F.lit("v1").alias("signature"), evidence.alias("evidence"))
    stale = assessments(spark, sf_dir).select("doc_id", "relevance")
    cache = items.join(stale, "doc_id").select(
        "id", F.when(F.col("relevance") % 5 == 0, F.lit("v0")).otherwise(F.lit("v1")).alias("signature"), "evidence", "relevance"
    )
    hit, pending = ledger.cached_and_pending(items, cache)
    return hit.select("id", F.lit("cached").alias("status")).unionByName(pending.select("id", F.lit("pending").alias("status")))


@query(
    "sent_history_backfill",
    with_sql(ARTICLES, DELIVERIES)
    + """SELECT a.doc_id::VARCHAR AS id, d.day, a.category FROM articles a JOIN delivered d ON d.alias = sha256('url:' || a.url)
      WHERE d.status IN ('sent', 'pending') AND a.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def sent_history_backfill(spark, sf_dir):
    history = load(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    return ledger.sent_history_backfill(keyed_articles(spark, sf_dir), deliveries(spark, sf_dir)[0], history)


@query(
    "recent_articles",
    with_sql(ARTICLES)
    + "SELECT doc_id, published, category FROM articles WHERE published >= DATE '2024-02-05' - 30 OR category = '政策'",
)
def recent_articles(spark, sf_dir):
    return ledger.recent_articles(articles(spark, sf_dir), _today(), 30).select("doc_id", "published", "category")


@query(
    "trusted_first_seen",
    with_sql(ARTICLES, ASSESSMENTS)
    + """SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN seen_day ELSE DATE '2024-02-05' END AS first_seen FROM articles
      WHERE published IS NULL AND category IN ('行业', '资本') AND (doc_id % 2 = 0 OR doc_id NOT IN (SELECT doc_id FROM assessments))
        AND (doc_id % 2 = 1 OR DATE '2024-02-05' - seen_day BETWEEN 0 AND 29)""",
)
def trusted_first_seen(spark, sf_dir):
    items = keyed_articles(spark, sf_dir).withColumn("list_kind", F.lit("html")).withColumn("date_evidence", F.lit("no_date_hint"))
    seen = items.filter("doc_id % 2 = 0").select("id", F.col("seen_day").alias("first_seen"))
    known = assessments(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"))
    return ledger.trusted_first_seen(items.select("id", "list_kind", "category", "published", "date_evidence"), seen, known, _today(), 30)


@query(
    "cleared_reviews",
    with_sql(ARTICLES, DELIVERIES, ASSESSMENTS, "sent_ids AS (SELECT DISTINCT doc_id FROM articles WHERE sha256('url:' || url) IN (SELECT alias FROM sent))",
             "unsent AS (SELECT doc_id FROM articles WHERE doc_id IN (SELECT doc_id FROM assessments) AND doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM sent_ids))")
    + """SELECT doc_id::VARCHAR AS id, kind FROM (SELECT doc_id, ['score', 'summary', 'dedup'][doc_id % 3 + 1] AS kind, doc_id % 3 = 0 OR doc_id % 5 = 0 AS today FROM articles) c
      WHERE NOT (kind = 'dedup' AND today) AND NOT (kind <> 'dedup' AND doc_id IN (SELECT doc_id FROM unsent))
        AND NOT (kind = 'score' AND today AND NOT (doc_id IN (SELECT doc_id FROM sent_ids)))""",
)
def cleared_reviews(spark, sf_dir):
    """Decision caches left after undoing one day's unsent reviews."""
    today = _today()
    items = keyed_articles(spark, sf_dir).join(assessments(spark, sf_dir).select("doc_id", "relevance"), "doc_id", "left")
    delivered, policy = deliveries(spark, sf_dir)
    aliases = ledger.exploded_aliases(items, "id")
    sent = ledger.keys_with_alias(aliases, "id", ledger.sent_aliases(delivered, policy))
    candidates = items.select("id", F.when(F.col("doc_id") % 3 == 0, today).alias("last_seen"))
    unsent = ledger.unsent_reviews(items, candidates, sent, today)
    kinds = F.array(F.lit("score"), F.lit("summary"), F.lit("dedup"))
    caches = items.select(
        "id", F.element_at(kinds, (F.col("doc_id") % 3 + 1).cast("int")).alias("kind"),
        F.when((F.col("doc_id") % 3 == 0) | (F.col("doc_id") % 5 == 0), today).otherwise(F.date_sub(today, 4)).alias("day"),
    )
    return ledger.clear_reviews(items, caches, unsent, sent, today, ["dedup"])[1].select("id", "kind")


@query(
    "expired_history",
    with_sql(ARTICLES)
    + "SELECT doc_id, seen_day AS day FROM articles WHERE seen_day >= DATE '2024-03-20' - 60 OR category = '政策'",
)
def expired_history(spark, sf_dir):
    rows = articles(spark, sf_dir).withColumn("day", F.col("seen_day"))
    return ledger.expire_sent_events(rows, F.to_date(F.lit("2024-03-20"))).select("doc_id", "day")


@query(
    "date_priorities",
    with_sql(ARTICLES)
    + "SELECT doc_id, coalesce((published - DATE '0001-01-01') + 1, 0)::INT AS priority FROM articles",
)
def date_priorities(spark, sf_dir):
    none = F.lit(None).cast("date")
    return articles(spark, sf_dir).select("doc_id", scores.date_priority(none, F.col("published")).cast("int").alias("priority"))


@query(
    "removed_candidates",
    with_sql(ARTICLES)
    + f""", graves AS (SELECT sha256('title:' || {sql_title_key("title")}) AS alias FROM articles WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
        UNION SELECT sha256('url:' || url) FROM articles WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
    SELECT doc_id::VARCHAR AS id FROM articles WHERE sha256('title:' || {sql_title_key("title")}) NOT IN (SELECT alias FROM graves) AND sha256('url:' || url) NOT IN (SELECT alias FROM graves)""",
)
def removed_candidates(spark, sf_dir):
    """What is left of the article table and its caches after toxic documents are removed for good."""
    items = keyed_articles(spark, sf_dir)
    toxic = items.join(load(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    none = toxic.select(F.lit("").alias("alias")).limit(0)
    _, kept, caches = ledger.remove_candidates(toxic, {"articles": items}, {"score": items.select("id")}, none)
    return kept["articles"].select("id").join(caches["score"], "id")


@query(
    "saved_articles",
    with_sql(ARTICLES, TOMBSTONES)
    + f"""SELECT doc_id::VARCHAR AS id, CASE WHEN sha256('title:' || {sql_title_key('title')}) IN (SELECT alias FROM tombstones) THEN title ELSE title || '!' END AS title FROM articles""",
)
def saved_articles(spark, sf_dir):
    """Stored articles replaced by newer rows, except under a tombstone."""
    stored = keyed_articles(spark, sf_dir).select("id", F.lit(0).alias("seq"), "title", "summary", "category", "source_urls")
    newer = stored.withColumn("seq", F.lit(1))
    graves = tombstones(spark, sf_dir)
    marked = ledger.save_articles(stored.withColumn("mark", F.lit("")), newer.withColumn("mark", F.lit("!")), graves)
    return marked.select("id", F.concat("title", "mark").alias("title"))


@query(
    "ledger_insert_or_ignore",
    with_sql(OBSERVATIONS) + "SELECT item_id::VARCHAR AS id, arg_min(status, event_id) AS status FROM observations GROUP BY 1",
)
def ledger_insert_or_ignore(spark, sf_dir):
    rows = observations(spark, sf_dir).select(F.col("item_id").cast("string").alias("id"), F.col("event_id").alias("seq"), "status", "day")
    return ledger.insert_or_ignore(
        ledger.first_by_order(rows.filter("day < '2024-01-10'"), ["id"], ["seq"]).select("id", "seq", "status"),
        rows.filter("day >= '2024-01-10'").select("id", "seq", "status"), "id",
    ).select("id", "status")


@query(
    "candidate_union",
    with_sql(ARTICLES)
    + """SELECT 0 AS provenance, doc_id FROM articles WHERE published >= DATE '2024-02-01' UNION ALL SELECT 1, doc_id FROM articles WHERE published IS NULL
      UNION ALL SELECT 2, doc_id FROM articles WHERE published >= DATE '2024-02-05' - 30 OR category = '政策'""",
)
def candidate_union(spark, sf_dir):
    rows = articles(spark, sf_dir)
    union = gates.candidate_union(
        rows.filter("published >= '2024-02-01'"), rows.filter("published IS NULL"), ledger.recent_articles(rows, _today(), 30)
    )
    return union.select("provenance", "doc_id")


@query(
    "recent_history",
    with_sql(ARTICLES) + "SELECT doc_id, seen_day AS day, category FROM articles WHERE seen_day >= DATE '2024-03-20' - 60 OR category = '政策'",
)
def recent_history(spark, sf_dir):
    """Sent items that still count on a day: those of the history window, and policies for ever."""
    sent = articles(spark, sf_dir).select("doc_id", F.col("seen_day").alias("day"), "category")
    return ledger.recent_history(sent, F.to_date(F.lit("2024-03-20")))


@query(
    "new_editions",
    with_sql(ARTICLES)
    + """, editions AS (SELECT DISTINCT seen_day AS edition_day, title AS body FROM articles),
      held AS (SELECT DISTINCT seen_day, title FROM articles WHERE doc_id % 4 < 2)
    SELECT edition_day, sha256(body) AS body FROM editions e WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.seen_day = e.edition_day AND h.title = e.body)""",
)
def new_editions(spark, sf_dir):
    """Editions not handed over before; half of them are sent or pending, an eighth failed and may go again."""
    rows = articles(spark, sf_dir).select("doc_id", F.col("seen_day").alias("edition_day"), F.col("title").alias("body"))
    status = F.when(F.col("doc_id") % 4 == 0, F.lit("sent")).when(F.col("doc_id") % 4 == 1, F.lit("pending")).when(F.col("doc_id") % 8 == 2, F.lit("failed"))
    key = F.concat(F.col("edition_day").cast("string"), F.lit(":"), text.digest(F.col("body")))
    handed = rows.select(key.alias("delivery_key"), status.alias("status")).filter("status is not null")
    return ledger.new_editions(rows.select("edition_day", "body").distinct(), handed).select("edition_day", F.sha2("body", 256).alias("body"))
