"""Merging declared reports of one event, and coverage by what was already sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import similarity, text, urls
from broadsheet.session import cut


def merge_declared_groups(items: DataFrame, groups: DataFrame, batch: list[str]) -> tuple[DataFrame, DataFrame]:
    """Apply an assessor's duplicate groups: (primaries with merged columns, ids they replace).

    items: batch, id, title, url, category, accepted, published, first_reported, ranking, sources
    array<struct<url,name>>. groups: batch, group_no, members array<string>. Only accepted items outside the
    academic category can be grouped. A malformed group, one that names any other item, and one with an
    undated member void their whole batch; a group mixing financing rounds, categories or more than seven
    days is left alone.
    """
    items = items.filter(F.col("accepted") & (F.col("category") != fixed.ACADEMIC))
    flagged = groups.withColumn(
        "malformed", (F.size("members") < 2) | (F.size(F.array_distinct("members")) != F.size("members"))
    )
    members = flagged.select(*batch, "group_no", "malformed", F.posexplode("members").alias("place", "id"))
    found = members.join(items, [*batch, "id"], "left")
    host = urls.host(F.col("url"))
    rounds = F.array_join(text.funding_rounds(F.col("title")), ",")
    checks = found.groupBy(*batch, "group_no").agg(
        F.max("malformed").alias("malformed"),
        F.max(F.col("url").isNull()).alias("stranger"),
        F.max(F.col("published").isNull()).alias("undated"),
        F.count_distinct(F.when(rounds != "", rounds)).alias("round_sets"),
        F.count_distinct("category").alias("categories"),
        F.datediff(F.max("published"), F.min("published")).alias("span"),
    )
    judged = checks.withColumn(
        "valid", (F.col("round_sets") <= 1) & (F.col("categories") == 1) & (F.col("span") <= 7)
    )
    placed = found.join(judged.select(*batch, "group_no", "valid"), [*batch, "group_no"])
    reuse = placed.groupBy(*batch, "id").agg(
        F.min(F.when(F.col("valid"), F.col("group_no"))).alias("first_valid"), F.max("group_no").alias("last_seen")
    )
    void = (
        judged.filter(F.col("malformed") | F.col("stranger") | (F.col("undated") & (F.col("round_sets") <= 1))).select(*batch)
        .unionByName(reuse.filter("first_valid < last_seen").select(*batch)).distinct()
    )
    accepted = placed.filter("valid").join(void, batch, "left_anti")
    lead = F.struct(host.endswith(".gov.cn").alias("g"), F.col("ranking").alias("r"), (-F.col("place")).alias("p"))
    ranked = accepted.withColumn("lead", lead)
    merged = ranked.groupBy(*batch, "group_no").agg(
        F.max_by("id", "lead").alias("id"),
        F.min(F.coalesce("first_reported", "published")).alias("first_reported"),
        F.max_by("place", "lead").alias("primary_place"),
        F.array_sort(F.collect_list(F.struct("place", "sources"))).alias("s"),
    )
    own = F.flatten(F.transform(F.filter("s", lambda r: r["place"] == F.col("primary_place")), lambda r: r["sources"]))
    rest = F.flatten(F.transform(F.filter("s", lambda r: r["place"] != F.col("primary_place")), lambda r: r["sources"]))
    primaries = merged.select(*batch, "group_no", "id", "first_reported", distinct_sources(F.concat(own, rest)).alias("sources"))
    removed = accepted.select(*batch, "id").join(primaries.select(*batch, "id"), [*batch, "id"], "left_anti")
    return primaries, removed


def distinct_sources(sources: Column) -> Column:
    """Source structs with the first of each url kept, in order."""
    seen = F.transform(sources, lambda s: s["url"])
    return F.filter(sources, lambda s, i: F.array_position(seen, s["url"]) == i + 1)


def name_list(companies: Column, subject: Column) -> Column:
    both = F.concat(companies, F.when(subject != "", F.array(subject)).otherwise(F.array().cast("array<string>")))
    return F.transform(F.filter(both, lambda n: F.length(n) >= 3), text.fold_case)


def _since(day: Column, days: int) -> Column:
    return F.floor(F.datediff(day, F.to_date(F.lit(fixed.ORDINAL_ORIGIN))) / days).cast("int")


def possible_priors(candidates: DataFrame, history: DataFrame, limit: int = fixed.PRIOR_LIMIT,
                    days: int = fixed.HISTORY_DAYS) -> DataFrame:
    """Up to five earlier sent items a candidate may repeat, newest first.

    candidates: edition_day, profile_id, id, event_day, title_key, document, names. history: profile_id, day,
    sent_id, title_key, document, names, category.

    A sent item that is remembered for some days is offered to the two periods of that length in which it counts, one
    that is remembered for ever to all, so a candidate meets only its profile's items of about twice the window and the
    profile's policies; equality joins on identity, document and names find the sure ones, and bounds on length and
    characters stand before the similarity, which is computed once for two titles and dealt over all tasks.
    """
    c = F.col
    spark = candidates.sparkSession
    # either side is read by six joins: written down once, with its letters
    old = cut(history.select(
        "profile_id", c("day").alias("sent_day"), "sent_id", c("title_key").alias("old_key"), c("document").alias("old_document"),
        c("names").alias("old_names"), (c("category") == fixed.POLICY).alias("forever"),
    ).distinct().withColumn("letters", similarity.letters(c("old_key"))))
    new = cut(
        candidates.select("edition_day", "profile_id", "id", "event_day", "title_key", "document", "names").distinct()
        .withColumn("own_letters", similarity.letters(c("title_key")))
    )
    remembered = (c("sent_day") < c("edition_day")) & (c("forever") | (c("sent_day") >= F.date_sub("edition_day", days)))
    key = ["edition_day", "profile_id", "id", "event_day", "sent_id", "sent_day", "document", "old_document"]

    by_identity = new.join(old, (new["profile_id"] == old["profile_id"]) & (c("id") == c("sent_id"))).drop(old["profile_id"])
    by_document = new.filter("document != ''").join(old.filter("old_document != ''"), (new["profile_id"] == old["profile_id"]) & (c("document") == c("old_document"))).drop(old["profile_id"])
    sure = by_identity.unionByName(by_document).filter(remembered).select(*key)

    new_names = new.select("profile_id", "edition_day", F.explode("names").alias("name")).distinct()
    old_names = old.select("profile_id", "sent_day", "forever", F.explode("old_names").alias("old_name")).distinct()
    matched = _name_matches(new_names.select("profile_id", "name").distinct(), old_names.select("profile_id", "old_name").distinct())
    by_name = (
        new.withColumn("name", F.explode("names")).join(matched, ["profile_id", "name"])
        .join(old.withColumn("old_name", F.explode("old_names")), ["profile_id", "old_name"]).filter(remembered).select(*key)
    )

    period = _since(c("edition_day"), days)
    first = _since(F.date_add("sent_day", 1), days)
    asked = new.select("profile_id", "edition_day", "title_key", "own_letters").distinct()
    told = old.select("profile_id", "sent_day", "forever", "old_key", "letters").distinct()
    offered = told.filter(~c("forever")).withColumn("period", F.explode(F.array(first, first + 1)))
    pairs = asked.withColumn("period", period).join(offered, ["profile_id", "period"]).drop("period").unionByName(
        asked.join(told.filter("forever"), "profile_id")
    ).filter(remembered)
    a, b = F.length("title_key"), F.length("old_key")
    floor = (a + b) * F.lit(fixed.PRIOR_SIMILARITY)
    possible = pairs.filter((2 * F.least(a, b) >= floor) & (2 * similarity.in_common(c("own_letters"), c("letters")) >= floor))
    # few bytes, much work: a stated number of partitions, by other columns than the distinct rows' own, is not merged for its size
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    titles = possible.select("profile_id", "title_key", "old_key").distinct().repartition(tasks, "title_key", "old_key")
    ratio = similarity.ratio_at_least(fixed.PRIOR_SIMILARITY)
    alike = titles.withColumn("ratio", ratio(c("title_key"), c("old_key"))).filter(c("ratio") >= fixed.PRIOR_SIMILARITY).drop("ratio")
    by_likeness = new.join(alike, ["profile_id", "title_key"]).join(old, ["profile_id", "old_key"]).filter(remembered).select(*key)

    kept = sure.unionByName(by_name).unionByName(by_likeness).distinct()
    w = Window.partitionBy("edition_day", "profile_id", "id").orderBy(F.desc("sent_day"), "sent_id")
    return kept.withColumn("n", F.row_number().over(w)).filter(c("n") <= limit).select(
        "edition_day", "profile_id", "id", "event_day", "sent_id", "sent_day",
        ((c("document") != "") & (c("document") == c("old_document"))).alias("same_document"), c("n").alias("prior_rank"),
    )


def _name_matches(names: DataFrame, old_names: DataFrame) -> DataFrame:
    """(profile_id, name, old_name) where one contains the other: joins by equality on the longer one's pieces."""
    c = F.col
    inside = names.withColumn("old_name", F.explode(text.pieces_of(c("name")))).join(old_names, ["profile_id", "old_name"], "left_semi")
    around = old_names.withColumn("name", F.explode(text.pieces_of(c("old_name")))).join(names, ["profile_id", "name"], "left_semi")
    return inside.select("profile_id", "name", "old_name").unionByName(around.select("profile_id", "name", "old_name")).distinct()


def coverage_verdicts(priors: DataFrame, decisions: DataFrame) -> DataFrame:
    """Covered when a policy document repeats, else as decided; an undecided candidate counts as covered.

    A decision (id, event_day, prior_key, duplicate) holds for one event day of the candidate, which may be unknown.
    """
    keyed = priors.groupBy("edition_day", "profile_id", "id", "event_day").agg(
        F.max("same_document").alias("same_document"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prior_rank", "sent_id"))), lambda r: r["sent_id"]), ":").alias("prior_key"),
    )
    decided = decisions.select(F.col("id").alias("d_id"), F.col("event_day").alias("d_day"), F.col("prior_key").alias("d_key"), "duplicate")
    same = (F.col("id") == F.col("d_id")) & (F.col("prior_key") == F.col("d_key")) & F.col("event_day").eqNullSafe(F.col("d_day"))
    joined = keyed.join(decided, same, "left")
    return joined.select(
        "edition_day", "profile_id", "id",
        (F.col("same_document") | F.coalesce("duplicate", F.lit(True))).alias("covered"),
    )


def verified_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """First readable page of each item in the order primary address, then other sources.

    items: id, url, source, source_urls, published, date_evidence, summary_kind, summary. pages: url, name,
    body, summary, published, date_evidence. The page replaces body and summary; its date counts only when
    the page states it; without any readable page the item is rejected (verified false).
    """
    own = F.col("date_evidence").isin("arxiv_version")
    wanted = items.filter(~own).select(
        "id", F.posexplode(F.array_distinct(F.concat(F.array("url"), "source_urls"))).alias("place", "page_url")
    )
    readable = pages.filter("body != ''").select(
        F.col("url").alias("page_url"), F.col("name").alias("p_source"), F.col("body").alias("p_body"),
        F.col("summary").alias("p_summary"), F.col("published").alias("p_published"), F.col("date_evidence").alias("p_evidence"),
    )
    first = wanted.join(readable, "page_url").groupBy("id").agg(
        F.min_by(F.struct("page_url", "p_source", "p_body", "p_summary", "p_published", "p_evidence"), "place").alias("p")
    )
    joined = items.join(first, "id", "left")
    stated = F.col("p.p_published").isNotNull() & F.col("p.p_evidence").isin("article_meta", "article_visible")
    found = F.col("p").isNotNull()
    return joined.select(
        "id",
        (own | found).alias("verified"),
        F.when(found, F.col("p.page_url")).otherwise(F.col("url")).alias("url"),
        F.when(found & (F.col("p.page_url") != F.col("url")), F.col("p.p_source")).otherwise(F.col("source")).alias("source"),
        F.when(found, F.col("p.p_body")).otherwise(F.lit("")).alias("body"),
        F.when(found, F.col("p.p_summary")).when(F.col("summary_kind") != "search", F.col("summary")).otherwise(F.lit("")).alias("summary"),
        F.when(stated, F.col("p.p_published")).otherwise(F.col("published")).alias("published"),
        F.when(stated, F.col("p.p_evidence")).otherwise(F.col("date_evidence")).alias("date_evidence"),
    )


def enrich_thin(items: DataFrame, search: DataFrame, pages: DataFrame, short_body: int = 300) -> DataFrame:
    """Items without a usable summary and with little text borrow from same-address results, then alternates.

    items: id, url, title, summary, body, source_urls. search: url, summary. pages: url, body, summary. Only
    the second and third source addresses are opened.
    """
    usable = text.usable_summary(F.col("summary"), F.col("title"))
    thin = items.filter(~usable & (F.length("body") < short_body))
    rich = items.filter(usable | (F.length("body") >= short_body))
    best = search.groupBy("url").agg(F.max_by("summary", F.length("summary")).alias("found"))
    helped = thin.join(best, "url", "left").withColumn(
        "summary", F.when(F.length(F.coalesce("found", F.lit(""))) > F.length("summary"), F.col("found")).otherwise(F.col("summary"))
    ).drop("found")
    still = helped.filter(~text.usable_summary(F.col("summary"), F.col("title")))
    opened = still.select("id", F.posexplode(F.slice("source_urls", 2, 2)).alias("place", "page_url")).join(
        pages.select(F.col("url").alias("page_url"), F.col("body").alias("p_body"), F.col("summary").alias("p_summary")), "page_url"
    )
    extra = opened.groupBy("id").agg(
        F.max_by("p_body", F.struct(F.length("p_body"), -F.col("place"))).alias("p_body"),
        F.min_by("p_summary", F.when(F.col("p_summary") != "", F.col("place"))).alias("p_summary"),
    )
    filled = helped.join(extra, "id", "left")
    unusable = ~text.usable_summary(F.col("summary"), F.col("title"))
    return rich.select("id", "summary", "body").unionByName(
        filled.select(
            "id",
            F.when(unusable & (F.col("summary") == ""), F.coalesce("p_summary", F.lit(""))).otherwise(F.col("summary")).alias("summary"),
            F.when(unusable & (F.length(F.coalesce("p_body", F.lit(""))) > F.length("body")), F.col("p_body")).otherwise(F.col("body")).alias("body"),
        )
    )
