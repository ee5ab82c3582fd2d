"""Selection under category and company quotas, for all editions at once.

An edition may hold any share of the candidates, so no edition is ever collected whole. Two facts keep the
work bounded without dropping anything that could be chosen:

* caps only tighten while an edition fills, so a row that fails once never fits later;
* rows with the same category and the same companies are interchangeable for the caps, so of each such
  class only the first ``cap`` rows in order can be taken.

Each round therefore hands at most CHUNK leading rows of an edition to a small fold and carries the
choice forward; an edition with rows left and places free goes into the next round.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.session import cut

EDITION = ["edition_day", "profile_id"]
CHUNK = 256
CARRY = "edition_day date, profile_id string, id string, category string, companies array<string>"


def _cap(category: str, relaxed: int, caps: dict) -> int:
    base = min(caps["category"], caps["academic"]) if category == fixed.ACADEMIC else caps["category"]
    return base + relaxed


class _Tally:
    """Category and company counts of what an edition holds so far."""

    def __init__(self, rows, relaxed: int, caps: dict):
        self.relaxed, self.caps = relaxed, caps
        self.categories, self.companies = Counter(), Counter()
        self.size = 0
        for category, companies in rows:
            self.add(category, companies)

    def add(self, category, companies) -> None:
        self.categories[category] += 1
        self.companies.update(set(companies))
        self.size += 1

    def fits(self, category, companies) -> bool:
        return self.categories[category] < _cap(category, self.relaxed, self.caps) and all(
            self.companies[c] < self.caps["company"] + self.relaxed for c in companies
        )


DEFAULT_CAPS = {
    "items": fixed.MAX_ITEMS, "shortlist": fixed.SHORTLIST_ITEMS, "category": fixed.CATEGORY_CAP,
    "academic": fixed.ACADEMIC_CAP, "company": fixed.COMPANY_CAP,
}


def _order(keys: list[str]) -> list:
    return [F.desc(k) for k in keys]


def _distinct_classes(rows: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """First ``keep`` rows of every (edition, category, companies) class; pruned before the shuffle."""
    w = Window.partitionBy(*EDITION, "category", "_class").orderBy(*_order(keys))
    classed = rows.withColumn("_class", F.array_join(F.array_sort("companies"), "\u0001"))
    return classed.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n", "_class")


def greedy_in_order(rows: DataFrame, keys: list[str], limit: int, relaxed: int, caps: dict,
                    held: DataFrame | None = None) -> DataFrame:
    """Take rows in descending key order while they fit; (edition, id, position) of what was taken."""
    spark = rows.sparkSession
    carried = held if held is not None else spark.createDataFrame([], CARRY)
    taken = carried.select(*EDITION, "id", "category", "companies")
    pending = _distinct_classes(rows, keys, caps["category"] + relaxed).select(
        *EDITION, "id", "category", "companies", *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    )
    names = [f"k{i}" for i in range(len(keys))]
    out_schema = CARRY + ", fresh boolean, place int, more boolean"

    def fold(head: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        tally = _Tally(zip(have["category"], have["companies"]), relaxed, caps)
        head = head.sort_values("n")
        picked = []
        for row in head.itertuples(index=False):
            if tally.size >= limit:
                break
            if tally.fits(row.category, row.companies):
                tally.add(row.category, row.companies)
                picked.append((row.edition_day, row.profile_id, row.id, row.category, row.companies, True, tally.size))
        more = tally.size < limit and len(head) > CHUNK
        frame = pd.DataFrame(picked, columns=["edition_day", "profile_id", "id", "category", "companies", "fresh", "place"])
        if more and frame.empty:
            first = head.iloc[0]
            frame = pd.DataFrame(
                [(first.edition_day, first.profile_id, None, None, None, False, 0)], columns=frame.columns
            )
        return frame.assign(more=more)

    found = None
    while True:
        w = Window.partitionBy(*EDITION).orderBy(*_order([*names, "id"]))
        # One row beyond the chunk only tells that more are waiting. Only these leading rows are ever ranked.
        leading = pending.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= CHUNK + 1)
        head = leading.select(*EDITION, "id", "category", "companies", "n")
        step = cut(
            head.groupBy(*EDITION)
            .cogroup(taken.groupBy(*EDITION))
            .applyInPandas(lambda h, t: fold(h[h["n"] <= CHUNK + 1], t), out_schema)
        )
        fresh = step.filter("fresh").select(*EDITION, "id", "category", "companies", "place")
        found = fresh if found is None else found.unionByName(fresh)
        open_editions = step.filter("more").select(*EDITION).distinct()
        if open_editions.isEmpty():
            return found
        taken = taken.unionByName(fresh.drop("place"))
        # the key of the last row handed over is the threshold for the next round: one row for each open edition
        place = F.struct(*names, "id")
        last = leading.filter(F.col("n") == CHUNK + 1).select(*EDITION, place.alias("_last")).join(open_editions, EDITION, "left_semi")
        pending = cut(pending.join(cut(last), EDITION).filter(place < F.col("_last")).drop("_last"))


def shortlist(rows: DataFrame, keys: list[str], caps: dict = DEFAULT_CAPS) -> DataFrame:
    """First stage: relaxed caps in order, then backfill in order up to the shortlist size."""
    limit = caps["shortlist"]
    first = greedy_in_order(rows, keys, limit, 1, caps).select(*EDITION, "id", "place")
    counts = first.groupBy(*EDITION).agg(F.count(F.lit(1)).alias("have"))
    short = counts.filter(F.col("have") < limit)
    # At most `limit` rows are already chosen, so the first 2 * limit rows hold every backfill.
    w = Window.partitionBy(*EDITION).orderBy(*_order(keys))
    head = (
        rows.join(short, EDITION)
        .withColumn("n", F.row_number().over(w))
        .filter(F.col("n") <= 2 * limit)
        .select(*EDITION, "id", "n", "have")
    )
    rest = head.join(first, [*EDITION, "id"], "left_anti")
    fill = (
        rest.withColumn("m", F.row_number().over(Window.partitionBy(*EDITION).orderBy("n")))
        .filter(F.col("m") <= limit - F.col("have"))
        .select(*EDITION, "id", (F.col("have") + F.col("m")).cast("int").alias("place"))
    )
    return first.unionByName(fill)


def _fill(candidates: pd.DataFrame, have: pd.DataFrame, caps: dict) -> tuple[list, bool]:
    """Rounds of nominations for one edition; stops early when a category's loaded rows run out."""
    tally = _Tally(zip(have["category"], have["companies"]), 0, caps)
    queues = {c: g.sort_values("n").to_dict("records") for c, g in candidates.groupby("category", sort=False)}
    truncated = {c: len(q) > CHUNK for c, q in queues.items()}
    picked = []
    while tally.size < caps["items"]:
        heads = []
        for category, queue in queues.items():
            while queue and not tally.fits(category, queue[0]["companies"]):
                queue.pop(0)
            if queue:
                heads.append(queue[0])
            elif truncated[category] and tally.categories[category] < _cap(category, 0, caps):
                return picked, True
        if not heads:
            break
        best = max(heads, key=lambda r: (r["ranking"], r["shortlist"], r["identity"]))
        queues[best["category"]].pop(0)
        tally.add(best["category"], best["companies"])
        picked.append(best)
    return picked, False


def fill_quota(rows: DataFrame, caps: dict = DEFAULT_CAPS, held: DataFrame | None = None) -> DataFrame:
    """Second stage: each category nominates its best fitting row, the best nominee is taken, repeat.

    rows: edition, id, category, companies, freshness, ranking, shortlist, identity. Returns the rows taken.
    """
    spark = rows.sparkSession
    keys = ["freshness", "ranking", "shortlist", "identity"]
    taken = (held if held is not None else spark.createDataFrame([], CARRY)).select(
        *EDITION, "id", "category", "companies"
    )
    pending = _distinct_classes(rows, keys, caps["category"])
    schema = CARRY + ", ranking double, shortlist double, identity string, more boolean"
    columns = ["edition_day", "profile_id", "id", "category", "companies", "ranking", "shortlist", "identity"]

    def fold(head: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        picked, more = _fill(head, have, caps)
        frame = pd.DataFrame(picked, columns=columns) if picked else pd.DataFrame(columns=columns)
        if more and frame.empty:
            first = head.iloc[0]
            frame = pd.DataFrame([{"edition_day": first.edition_day, "profile_id": first.profile_id}], columns=columns)
        return frame.assign(more=more)

    found = None
    while True:
        w = Window.partitionBy(*EDITION, "category").orderBy(*_order(keys))
        head = pending.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= CHUNK + 1)
        step = cut(
            head.select(*columns, "n").groupBy(*EDITION).cogroup(taken.groupBy(*EDITION)).applyInPandas(fold, schema)
        )
        fresh = step.filter("id IS NOT NULL").drop("more")
        found = fresh if found is None else found.unionByName(fresh)
        open_editions = step.filter("more").select(*EDITION).distinct()
        if open_editions.isEmpty():
            return found
        taken = taken.unionByName(fresh.select(*EDITION, "id", "category", "companies"))
        pending = cut(_still_fitting(pending.join(open_editions, EDITION, "left_semi"), taken, caps))


def _still_fitting(rows: DataFrame, taken: DataFrame, caps: dict) -> DataFrame:
    """Rows not taken whose category and companies all have room."""
    full_category = (
        taken.groupBy(*EDITION, "category")
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn(
            "cap",
            F.when(F.col("category") == fixed.ACADEMIC, F.lit(_cap(fixed.ACADEMIC, 0, caps))).otherwise(
                F.lit(caps["category"])
            ),
        )
        .filter("c >= cap")
        .select(*EDITION, "category")
    )
    full_company = (
        taken.select(*EDITION, F.explode(F.array_distinct("companies")).alias("company"))
        .groupBy(*EDITION, "company")
        .agg(F.count(F.lit(1)).alias("c"))
        .filter(F.col("c") >= caps["company"])
        .groupBy(*EDITION)
        .agg(F.collect_list("company").alias("full"))
    )
    left = rows.join(taken.select(*EDITION, "id"), [*EDITION, "id"], "left_anti")
    left = left.join(full_category, [*EDITION, "category"], "left_anti").join(full_company, EDITION, "left")
    return left.filter(F.col("full").isNull() | ~F.arrays_overlap("companies", "full")).drop("full")


def select_edition(eligible: DataFrame, caps: dict = DEFAULT_CAPS) -> DataFrame:
    """Final items per edition with ``pick_rank``.

    eligible: edition, id, category, companies, day, published, freshness, shortlist, ranking, identity.
    """
    order = ["day", "shortlist", "published", "identity"]
    pool = cut(eligible)
    listed = cut(shortlist(pool, order, caps))
    needed = [*EDITION, "id", "category", "companies", "freshness", "ranking", "shortlist", "identity"]
    chosen = fill_quota(pool.join(listed.select(*EDITION, "id"), [*EDITION, "id"], "left_semi").select(*needed), caps)
    counts = chosen.groupBy(*EDITION).agg(F.count(F.lit(1)).alias("have"))
    # Editions with free places look beyond the shortlist; what is chosen stays.
    vacant = pool.join(counts.filter(F.col("have") >= caps["items"]), EDITION, "left_anti")
    outside = vacant.join(listed.select(*EDITION, "id"), [*EDITION, "id"], "left_anti").select(*needed)
    refill = fill_quota(outside, caps, held=chosen.join(vacant.select(*EDITION).distinct(), EDITION, "left_semi"))
    picks = chosen.unionByName(refill)
    w = Window.partitionBy(*EDITION).orderBy(F.desc("ranking"), F.desc("shortlist"), F.desc("identity"))
    return picks.withColumn("pick_rank", F.row_number().over(w))


def link_only_backfill(picks: DataFrame, failed: DataFrame, caps: dict = DEFAULT_CAPS) -> DataFrame:
    """Items whose summary failed fill free places in rank order under the same caps."""
    return greedy_in_order(
        failed, ["ranking", "shortlist", "identity"], caps["items"], 0, caps,
        held=picks.select(*EDITION, "id", "category", "companies"),
    )


def keyword_coverage(items: DataFrame, group: list[str], interests: DataFrame, limit: int, order: list) -> DataFrame:
    """Top items of a group that together touch as many interests as possible.

    items: group columns, id, matched_keywords and whatever ``order`` needs. interests: profile_id and the
    ordered array ``interests``. For one interest only the first ``limit`` items naming it can be taken, and
    only the first ``limit`` items overall can fill, so that is all a group ever collects.
    """
    everything = Window.partitionBy(*group).orderBy(*order)
    top = items.withColumn("n", F.row_number().over(everything)).filter(F.col("n") <= limit).drop("n")
    named = items.withColumn("interest", F.explode("matched_keywords"))
    per = Window.partitionBy(*group, "interest").orderBy(*order)
    best = named.withColumn("n", F.row_number().over(per)).filter(F.col("n") <= limit).drop("n", "interest")
    kept = top.unionByName(best).dropDuplicates([*group, "id"])
    placed = kept.withColumn("n", F.row_number().over(everything))
    row = F.struct("n", "id", "matched_keywords")
    bags = placed.groupBy(*group).agg(F.array_sort(F.collect_list(row)).alias("rows")).join(
        interests.select("profile_id", "interests"), "profile_id"
    )
    start = F.struct(
        F.array().cast("array<int>").alias("sel"), F.array().cast("array<string>").alias("cov")
    )

    def step(acc, interest):
        free = F.filter(
            "rows",
            lambda r: F.array_contains(r["matched_keywords"], interest) & ~F.array_contains(acc["sel"], r["n"]),
        )
        skip = F.array_contains(acc["cov"], interest) | (F.size(acc["sel"]) >= limit) | (F.size(free) == 0)
        return F.when(skip, acc).otherwise(
            F.struct(
                F.concat(acc["sel"], F.array(free[0]["n"])).alias("sel"),
                F.array_union(acc["cov"], free[0]["matched_keywords"]).alias("cov"),
            )
        )

    covered = bags.withColumn("sel", F.aggregate("interests", start, step)["sel"])
    rest = F.filter(F.transform("rows", lambda r: r["n"]), lambda n: ~F.array_contains("sel", n))
    picked = covered.withColumn("sel", F.slice(F.concat("sel", rest), 1, limit))
    return picked.select(*group, "rows", F.posexplode("sel").alias("p", "n")).select(
        *group,
        F.filter("rows", lambda r: r["n"] == F.col("n"))[0]["id"].alias("id"),
        (F.col("p") + 1).alias("pick_rank"),
    )


def top_per_source(items: DataFrame, source: list[str], limit: int, order: list) -> DataFrame:
    """Best ``limit`` items of each source; ranks are limited before the shuffle."""
    w = Window.partitionBy(*source).orderBy(*order)
    return items.withColumn("source_rank", F.row_number().over(w)).filter(F.col("source_rank") <= limit)
