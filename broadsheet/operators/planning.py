"""What to analyse, search and open next: queues, budgets, query calendars."""

from __future__ import annotations

from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import dates
from broadsheet.operators.quotas import EDITION

SOURCE_LIMIT = max(2, ceil(fixed.ANALYSIS_BUDGET * fixed.SOURCE_SHARE))


def queue_head(queue: DataFrame, allowance: DataFrame, size: int = fixed.REFILL_LIMIT) -> DataFrame:
    """First ``size`` queued candidates per edition; a due exploration item moves to the front.

    queue: edition, id, exploration, tier, estimate, category. allowance: edition, allowance.
    """
    keys = [
        "exploration", F.desc("tier"), F.desc("estimate"), F.col("category") == fixed.ACADEMIC,
        F.col("category") != fixed.POLICY, "id",
    ]
    w = Window.partitionBy(*EDITION, "exploration").orderBy(*keys)
    # Regular and exploratory rows are limited separately so the ranking never sorts a whole edition.
    heads = queue.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= size)
    due = F.coalesce(F.col("allowance") > 0, F.lit(False)) & F.col("exploration") & (F.col("n") == 1)
    placed = heads.join(allowance, EDITION, "left").withColumn("_first", due)
    whole = Window.partitionBy(*EDITION).orderBy(F.desc("_first"), *keys)
    out = placed.withColumn("queue_position", F.row_number().over(whole)).filter(F.col("queue_position") <= size)
    return out.drop("n", "_first", "allowance")


_RANK = ["tier", "trusted", "date_priority", "estimate", "source_priority"]


def _static(row) -> tuple:
    return (
        -row.tier, not row.trusted, -row.date_priority, -row.estimate, -row.source_priority, row.evidence_level, row.identity
    )


def _allocate(rows: pd.DataFrame, size: int, source_limit: int) -> list[tuple]:
    """Next best candidate again and again, cycling over categories, each source within its share.

    A category that already has all its places gets at most REPLACEMENT_LIMIT challengers, after all others.
    """
    waiting = sorted(rows.itertuples(index=False), key=_static)
    categories, sources, challengers = {}, {}, {}
    order, overflow = [], False
    while waiting and len(order) < size:
        best, best_key = None, None
        for row in waiting:
            over = sources.get(row.source_key, 0) >= source_limit
            if over and row.tier < 3 and not overflow:
                continue
            if row.full and challengers.get(row.category, 0) >= fixed.REPLACEMENT_LIMIT:
                continue
            key = (
                row.full, over, not row.explore_due, row.relevance < fixed.ACCEPT_THRESHOLD, categories.get(row.category, 0),
                fixed.CATEGORY_ORDER.get(row.category, 5),
            )
            if best is None or key < best_key:
                best, best_key = row, key
        if best is None and overflow:
            break
        if best is None:
            # Only sources over their share are left: from here on the share is relaxed.
            overflow = True
            continue
        waiting.remove(best)
        categories[best.category] = categories.get(best.category, 0) + 1
        sources[best.source_key] = sources.get(best.source_key, 0) + 1
        challengers[best.category] = challengers.get(best.category, 0) + int(best.full)
        order.append((best, overflow))
    return order


def analysis_plan(queue: DataFrame, budget: int = fixed.ANALYSIS_BUDGET, refill: int = fixed.REFILL_LIMIT,
                  source_limit: int = SOURCE_LIMIT, picks: DataFrame | None = None) -> DataFrame:
    """Label every candidate base, refill, overflow or deferred and number those to be analysed.

    queue: edition, id, identity, category, source_key, tier, relevance, estimate, source_priority,
    date_priority, needs_read, trusted_undated, undated, exploration, exploration_due. picks: edition,
    category, estimate of what is already chosen; a category without free places admits only dated
    candidates clearly above its weakest pick.

    At most ``refill`` rows are taken and at most refill / source_limit sources can fill their share, so of a
    class (category, due, likely) no row beyond the first refill + (refill / source_limit) * refill of the
    per-source leaders can be reached; that bounds what one edition hands to the allocation.
    """
    admitted = queue.withColumn("full", F.lit(False)) if picks is None else _challengers(queue, picks)
    rows = admitted.select(
        *EDITION, "id", "identity", "full", "category", "source_key", "tier", "relevance", "estimate", "source_priority", "date_priority",
        (F.col("needs_read") & F.col("trusted_undated")).alias("trusted"),
        F.when(F.col("undated"), 2).when(F.col("needs_read"), 1).otherwise(0).alias("evidence_level"),
        (F.col("exploration") & F.col("exploration_due")).alias("explore_due"),
        (F.col("relevance") < fixed.ACCEPT_THRESHOLD).alias("unlikely"),
    )
    order = [
        F.desc("tier"), F.desc("trusted"), F.desc("date_priority"), F.desc("estimate"), F.desc("source_priority"), "evidence_level", "identity"
    ]
    group = [*EDITION, "category", "explore_due", "unlikely"]
    per_source = Window.partitionBy(*group, "source_key").orderBy(*order)
    leaders = rows.withColumn("n", F.row_number().over(per_source)).filter(F.col("n") <= refill).drop("n")
    reach = refill + ceil(refill / source_limit) * refill
    per_class = Window.partitionBy(*group).orderBy(*order)
    reachable = leaders.withColumn("n", F.row_number().over(per_class)).filter(F.col("n") <= reach).drop("n")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        taken = _allocate(frame, refill, source_limit)
        return pd.DataFrame(
            {
                "edition_day": [r.edition_day for r, _ in taken],
                "profile_id": [r.profile_id for r, _ in taken],
                "id": [r.id for r, _ in taken],
                "analysis_order": range(1, len(taken) + 1),
                "stage": ["overflow" if o else "base" if i < budget else "refill" for i, (_, o) in enumerate(taken)],
            }
        )

    plan = reachable.groupBy(*EDITION).applyInPandas(
        fold, "edition_day date, profile_id string, id string, analysis_order int, stage string"
    )
    return queue.select(*EDITION, "id", "category").join(plan, [*EDITION, "id"], "left").fillna("deferred", ["stage"])


def _challengers(queue: DataFrame, picks: DataFrame) -> DataFrame:
    held = picks.groupBy(*EDITION, "category").agg(F.count(F.lit(1)).alias("held"), F.min("estimate").alias("weakest"))
    cap = F.when(F.col("category") == fixed.ACADEMIC, min(fixed.CATEGORY_CAP, fixed.ACADEMIC_CAP)).otherwise(fixed.CATEGORY_CAP)
    joined = queue.join(held, [*EDITION, "category"], "left").withColumn("full", F.coalesce(F.col("held") >= cap, F.lit(False)))
    stronger = ~F.col("undated") & (F.col("estimate") > F.col("weakest") * fixed.REPLACEMENT_MARGIN)
    return joined.filter(~F.col("full") | stronger).drop("held", "weakest")


def round_robin(queue: DataFrame, order: list, size: int) -> DataFrame:
    """Allocation without source limits: categories take turns in fixed direction order."""
    w = Window.partitionBy(*EDITION, "category").orderBy(*order)
    turned = queue.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= size)
    direction = F.lit(5)
    for name, place in fixed.CATEGORY_ORDER.items():
        direction = F.when(F.col("category") == name, F.lit(place)).otherwise(direction)
    every = Window.partitionBy(*EDITION).orderBy("turn", direction)
    return turned.withColumn("analysis_order", F.row_number().over(every)).filter(F.col("analysis_order") <= size)


def scarce_topics(rules: DataFrame, topics: dict[str, str], fixed_count: int = fixed.FIXED_QUERIES_PER_TOPIC) -> list[str]:
    """Searched topics with too few searchable rules for the fixed queries and a rotating one; topics are few."""
    counted = rules.filter("search_enabled").select(F.explode("topics").alias("topic")).groupBy("topic").count().filter(F.col("count") > fixed_count)
    enough = {r["topic"] for r in counted.filter(F.col("topic").isin(*topics)).collect()}
    return [t for t in topics if t != fixed.ACADEMIC and t not in enough]


def query_text(query: Column, n_groups: Column, topic: Column, topics: dict[str, str]) -> Column:
    """What is typed: one-group rules of some topics are narrowed by the topic's first intent word, policies by the country."""
    intents = F.create_map(*[F.lit(x) for name, intent in topics.items() for x in (name, intent.split()[0])])
    words = F.trim(query)
    narrowed = F.when((n_groups == 1) & topic.isin(*fixed.NARROWED_TOPICS), F.concat(words, F.lit(" "), F.try_element_at(intents, topic))).otherwise(words)
    return F.when(topic == fixed.POLICY, F.concat(narrowed, F.lit(fixed.POLICY_QUERY_SUFFIX))).otherwise(narrowed)


def query_calendar(days: DataFrame, rules: DataFrame, topics: dict[str, str], fixed_count: int = fixed.FIXED_QUERIES_PER_TOPIC,
                   exploration_ratio: float = fixed.EXPLORATION_RATIO) -> DataFrame:
    """Search queries of every day and topic: the heaviest rules plus one that rotates with the calendar.

    rules: id, position, weight, topics, query, exploration, search_enabled, groups; those not enabled and the academic
    topic are left out, and a topic with too few rules is an error. Every tenth day rotates through the exploratory
    rules. Days meet rules by equality on topic, pool and turn.
    """
    scarce = scarce_topics(rules, topics, fixed_count)
    if scarce:
        raise ValueError(f"too few searchable rules for {', '.join(scarce)}")
    searched = [t for t in topics if t != fixed.ACADEMIC]
    by_topic = rules.filter("search_enabled").select("id", "position", "weight", "query", "exploration", F.size("groups").alias("n_groups"), F.explode("topics").alias("topic"))
    by_topic = by_topic.withColumn("query", query_text(F.col("query"), F.col("n_groups"), F.col("topic"), topics))
    heaviest = Window.partitionBy("topic").orderBy(F.desc("weight"), "position")
    ranked = by_topic.withColumn("n", F.row_number().over(heaviest))
    anchors = ranked.filter(F.col("n") <= fixed_count)
    in_pool = Window.partitionBy("topic", "exploration").orderBy("n")
    pool = ranked.filter(F.col("n") > fixed_count).withColumn("turn", F.row_number().over(in_pool) - 1)
    sizes = pool.groupBy("topic").agg(
        F.count_if(~F.col("exploration")).alias("regular"), F.count_if("exploration").alias("exploratory")
    )
    calendar = days.select("day", F.explode(F.array(*[F.lit(t) for t in searched])).alias("topic")).join(sizes, "topic")
    number = dates.ordinal(F.col("day"))
    explore = (F.col("exploratory") > 0) & F.lit(exploration_ratio > 0) & (number % 10 == 0)
    kind = explore | (F.col("regular") == 0)
    turn = F.when(explore, F.floor(number / 10) % F.col("exploratory")).when(
        F.col("regular") == 0, number % F.col("exploratory")
    ).otherwise(number % F.col("regular"))
    rotating = calendar.withColumn("exploration", kind).withColumn("turn", turn.cast("int")).join(pool, ["topic", "exploration", "turn"])
    columns = ["day", "topic", "id", "query", "n_groups", "rotating"]
    planned = calendar.join(anchors, "topic").withColumn("rotating", F.lit(False)).select(*columns).unionByName(
        rotating.withColumn("rotating", F.lit(True)).select(*columns)
    )
    return planned.withColumn("too_long", F.length("query") > fixed.MAX_QUERY_LENGTH)


def site_calendar(days: DataFrame, sites: DataFrame, limit: int = 4) -> DataFrame:
    """Sites to search on a day: the rotation group of the day's number, official sources first.

    Only a group's first ``limit`` sites are ranked, once for all days; all others of the group are deferred.
    """
    turn = days.select("day", (dates.ordinal(F.col("day")) % 2).cast("int").alias("rotation_group"))
    w = Window.partitionBy("rotation_group").orderBy(F.desc("official"), "position")
    leading = sites.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).select("rotation_group", "position", F.lit(True).alias("_due"))
    # a handful of rows for each of the two groups
    marked = sites.join(F.broadcast(leading), ["rotation_group", "position"], "left")
    status = F.when(F.col("_due"), F.lit("scheduled")).otherwise(F.lit("deferred"))
    return marked.withColumn("status", status).drop("_due").join(turn, "rotation_group")


def widened_search(rows: DataFrame, group: list[str], enough: int = 2, widen: int = 2) -> DataFrame:
    """One-day rows of all queries, plus one-week rows of the first queries while dated hits are scarce.

    rows: group, query_no, recency, id, published. Distinct dated hits are counted, never collected.
    """
    dated = F.when(F.col("published").isNotNull(), F.col("id"))
    day = F.col("recency") == "oneDay"
    seen = [
        F.count_distinct(F.when(day | (F.col("query_no") < k), dated)).alias(f"hits_{k}") for k in range(widen)
    ]
    counts = rows.groupBy(*group).agg(*seen)
    wanted = F.lit(False)
    for k in range(widen):
        scarce = F.lit(True)
        for j in range(k + 1):
            scarce = scarce & (F.col(f"hits_{j}") < enough)
        wanted = wanted | ((F.col("query_no") == k) & scarce)
    return rows.join(counts, group).filter((F.col("recency") == "oneDay") | wanted).drop(*[f"hits_{k}" for k in range(widen)])


def finalists(items: DataFrame, size: int = fixed.SHORTLIST_ITEMS) -> DataFrame:
    """Leading accepted items of an edition whose pages are to be checked in full."""
    w = Window.partitionBy(*EDITION).orderBy(F.desc("shortlist"), F.desc("relevance"), F.desc("identity"))
    return items.withColumn("check_order", F.row_number().over(w)).filter(F.col("check_order") <= size)


def needs_read(published: Column, usable: Column, body: Column) -> Column:
    return published.isNull() | (~usable & (body == ""))


def listing_candidates(items: DataFrame, source: list[str], extra: int = 6, size: int = 40) -> DataFrame:
    """Rule matches of a listing plus a few trusted extras, heaviest first, per source.

    items: source, position, weight (0 without a match), trusted (specialist, company or thin summary).
    """
    matched = F.col("weight") > 0
    w = Window.partitionBy(*source).orderBy("position")
    extras = items.filter(~matched & F.col("trusted")).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= extra).drop("n")
    both = items.filter(matched).unionByName(extras)
    ranked = Window.partitionBy(*source).orderBy(F.desc("weight"), F.desc(F.col("weight") > 0), "position")
    return both.withColumn("listing_rank", F.row_number().over(ranked)).filter(F.col("listing_rank") <= size)
