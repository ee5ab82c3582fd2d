"""Merging reports of the same event in arrival order, without ever collecting a group.

The rule is greedy: items arrive by position; each joins the earliest representative it matches and
otherwise founds a new one. A representative answers to

* every source address its members have brought so far,
* its title key (replaced when a later official policy page takes the entry over),
* on its publication day, any title at least TITLE_SIMILARITY alike with the same numbers in it.

Whom item i joins depends only on items before i, so "representative of i" is the unique fixed point of a
plain recomputation over all items at once. Each round is a handful of equality joins against small
aggregates (one row per key and representative); the rounds needed are the depth of the dependency chains,
not the size of the groups. A title or address shared by a third of all rows is one row on the aggregate
side, and the probing side of the join is split by adaptive skew handling.

Similar titles are found by bounds that lose none: titles of one day and the same numbers meet in cells of like length,
split into blocks of bounded text, and a task compares counts. Of a pair as alike as required nearly all characters lie
in common stretches, of which there are at most one more than the characters left over, and at most twice as many as
the later title has rare characters and one more (SequenceMatcher starts only from rare ones in titles of 200 or more). So
many characters, and pairs of neighbouring ones, must be common to both; few pairs are left whose similarity is computed.
Titles that many others may resemble wait: only those that are still representatives look for partners, and of those
that share their rarest pieces a growing number per round, so a family of near copies costs about one comparison per
member rather than one per pair.

Step tables grow with the input, but their files are far smaller than their rows in memory (hashes repeat, letters are
mostly zero), so Spark would take them for small and collect them in the driver to broadcast them. Joins of two such
tables therefore ask for a sorted merge.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import similarity, text, urls
from broadsheet.session import cut

PIECE = 4
#: Titles that one may resemble before it waits, also the number of a block that look for partners first, and how that grows.
LEADERS, LEADER_GROWTH = 32, 2
#: Lengths in a cell differ by this factor at most, a little more than similar titles do; characters and titles in a block.
STEP, BLOCK_CHARACTERS, BLOCK_TITLES = 1.18, 1 << 22, 1 << 13
# Unmatched characters of a pair are at most (1 - s) * (a + b), and the longer is at most (2 - s) / s times the shorter.
_LOOSE = 1 - fixed.TITLE_SIMILARITY
DIFFERING = _LOOSE * (1 + (2 - fixed.TITLE_SIMILARITY) / fixed.TITLE_SIMILARITY)


def prepare(items: DataFrame) -> DataFrame:
    """Key columns of the merge. items: pos, title, url, category, published, source_urls."""
    return items.select(
        "pos",
        text.title_key(F.col("title")).alias("title_key"),
        F.array_join(text.numbers(F.col("title")), "|").alias("numbers"),
        F.col("published").alias("day"),
        F.array_distinct(F.concat(F.array("url"), "source_urls")).alias("addresses"),
        urls.host(F.col("url")).endswith(".gov.cn").alias("official"),
        (F.col("category") == fixed.POLICY).alias("policy"),
    ).withColumn("key", F.sha2("title_key", 256))


def _budget(title_key: Column) -> Column:
    """Pieces of which one at least survives in any similar title."""
    return (F.floor(F.length(title_key) * DIFFERING) + 1).cast("int")


def _rarest(leaders: DataFrame, frequencies: DataFrame) -> DataFrame:
    """The rarest disjoint pieces of each title with their offset, one more than can be spoilt.

    leaders: kind, title_key, day, numbers. A title has few pieces, so ranking them is a small window."""
    pieces = F.regexp_extract_all("title_key", F.lit("(.{%d})" % PIECE), F.lit(1))
    rows = leaders.select("kind", "title_key", "day", "numbers", F.posexplode(pieces).alias("i", "piece"))
    counted = rows.join(frequencies.hint("merge"), ["piece", "day", "numbers"], "left")
    w = Window.partitionBy("kind").orderBy(F.coalesce("titles", F.lit(0)), "i")
    return counted.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= _budget(F.col("title_key"))).select(
        "kind", "title_key", "day", "numbers", "piece", (F.col("i") * PIECE).alias("at")
    )


def piece_frequencies(titles: DataFrame) -> DataFrame:
    """How many places of a day's titles hold each piece."""
    return _windows(titles.select("title_key", "day", "numbers")).groupBy("piece", "day", "numbers").agg(F.count(F.lit(1)).alias("titles"))


def _windows(titles: DataFrame) -> DataFrame:
    """Every four-character window of each title with its offset; one pass over the text."""
    every = F.regexp_extract_all("title_key", F.lit("(?=(.{%d}))" % PIECE), F.lit(1))
    return titles.select("*", F.posexplode(every).alias("found_at", "piece"))


def _kind(key: Column, day: Column, numbers: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", key, day.cast("string"), numbers), 256)


def _cells(titles: DataFrame) -> DataFrame:
    length = F.length("title_key")
    cell = F.floor(F.log(length) / math.log(STEP)).cast("int").alias("cell")
    # aliases, as leaders may be the titles themselves
    return titles.filter(length > 0).select(*[F.col(c).alias(c) for c in ("kind", "title_key", "day", "numbers")], cell)


def _candidates(leaders: DataFrame, titles: DataFrame, most: int | None = None) -> DataFrame:
    """leader, n, kinds: how many titles of a block may be similar by their counts, and which; null if more than `most`."""
    cell = ["day", "numbers", "cell"]
    asking = _cells(leaders)
    offered = _cells(titles).withColumn("cell", F.explode(F.array(*[F.col("cell") + i for i in (-1, 0, 1)])))

    def sizes(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*cell).agg(F.count(F.lit(1)).alias(name), F.min("kind").alias(f"{name}_first"), F.max("kind").alias(f"{name}_last"))

    one_alone = (F.col("n_asking_first") == F.col("n_offered_last")) & (F.col("n_asking_last") == F.col("n_offered_first"))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_TITLES), F.lit(BLOCK_CHARACTERS) / F.pow(F.lit(STEP), F.col("cell") + 1)))
    both = sizes(asking, "n_asking").join(sizes(offered, "n_offered").hint("merge"), cell).filter(~one_alone)
    both = both.select(*cell, F.ceil(F.col("n_asking") / block).alias("parts"), F.ceil(F.col("n_offered") / block).alias("other_parts"))

    def own(parts: str) -> Column:
        return F.pmod(F.xxhash64("kind"), F.col(parts))

    def every(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))

    left = asking.join(both.hint("merge"), cell).select(*cell, own("parts").alias("part"), every("other_parts").alias("other"), "kind", "title_key")
    right = offered.join(both.hint("merge"), cell).select(*cell, every("parts").alias("part"), own("other_parts").alias("other"), "kind", "title_key")
    floor = fixed.TITLE_SIMILARITY

    def compare(asking: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(asking) and len(offered):
            kinds, found = offered["kind"].to_numpy(), similarity.possible(list(asking["title_key"]), list(offered["title_key"]), floor)
            for leader, at in zip(asking["kind"], found, strict=True):
                other = [k for k in kinds[at] if k != leader]
                if other:
                    out.append((leader, len(other), other if most is None or len(other) <= most else None))
        return pd.DataFrame(out, columns=["leader", "n", "kinds"])

    keys = [*cell, "part", "other"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "leader string, n long, kinds array<string>")


def candidate_pairs(leaders: DataFrame, titles: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """(leader, kind) pairs of titles that could be similar by their counts; the frequencies are not needed for it any more."""
    return _candidates(leaders, titles).select("leader", F.explode("kinds").alias("kind"))


def similar_titles(pairs: DataFrame, leaders: DataFrame, titles: DataFrame) -> DataFrame:
    """(leader kind, kind) of the pairs whose later title is similar enough to the leader's.

    Both sides: kind, title_key. The order of comparison is leader first.
    """
    asked = leaders.select(F.col("kind").alias("leader"), F.col("title_key").alias("a"))
    named = pairs.join(asked.hint("merge"), "leader").join(titles.select("kind", F.col("title_key").alias("b")).hint("merge"), "kind")
    ratio = similarity.ratio_at_least(fixed.TITLE_SIMILARITY)
    return named.withColumn("r", ratio(F.col("a"), F.col("b"))).filter(F.col("r") >= fixed.TITLE_SIMILARITY).select("leader", "kind")


def _segments(keys: DataFrame, assigned: DataFrame) -> DataFrame:
    """What each representative is called over time: rep, key, numbers, day, since, until.

    A representative changes at most twice: when its first dated member fills a missing day, and when an
    official policy member takes over title and day.
    """
    rows = keys.select("pos", "key", "title_key", "numbers", "day", "official", "policy").join(assigned.hint("merge"), "pos")
    me = F.col("pos") == F.col("rep")
    name = F.struct("pos", "key", "numbers", "day")
    grouped = rows.groupBy("rep").agg(
        F.min_by(name, "pos").alias("own"),
        F.max(F.when(me, F.col("official"))).alias("was_official"),
        F.min_by(F.struct("pos", "day"), F.when(F.col("day").isNotNull(), F.col("pos"))).alias("dated"),
        F.min_by(name, F.when(~me & F.col("policy") & F.col("official"), F.col("pos"))).alias("takeover"),
    )
    taken = F.when(~F.col("was_official"), F.col("takeover"))
    g = grouped.withColumn("taken", taken)
    own, until = F.col("own"), F.col("taken.pos")
    # A day filled in before any takeover belongs to the first title, later ones to the second.
    filled_first = own["day"].isNull() & F.col("dated").isNotNull() & (until.isNull() | (F.col("dated.pos") < until))
    second_day = F.coalesce(
        F.col("taken.day"),
        own["day"],
        F.when(F.col("dated.pos") <= until, F.col("dated.day")),
    )
    late = F.col("taken").isNotNull() & second_day.isNull() & F.col("dated").isNotNull()

    def segment(when: Column, key: Column, numbers: Column, day: Column, since: Column, end: Column, born: Column) -> Column:
        return F.when(
            when,
            F.struct(
                key.alias("key"), numbers.alias("numbers"), day.alias("day"), since.alias("since"), end.alias("until"), born.alias("titled_since")
            ),
        )

    none = F.lit(None).cast("long")
    parts = F.array(
        segment(F.lit(True), own["key"], own["numbers"], own["day"], own["pos"], F.when(filled_first, F.col("dated.pos")).otherwise(until), own["pos"]),
        segment(filled_first, own["key"], own["numbers"], F.col("dated.day"), F.col("dated.pos"), until, own["pos"]),
        segment(
            F.col("taken").isNotNull(), F.col("taken.key"), F.col("taken.numbers"), second_day, until,
            F.when(late, F.col("dated.pos")).otherwise(none), until,
        ),
        segment(late, F.col("taken.key"), F.col("taken.numbers"), F.col("dated.day"), F.col("dated.pos"), none, until),
    )
    return g.select("rep", F.explode(F.filter(parts, lambda s: s.isNotNull())).alias("s")).select("rep", "s.*")


def _valid(since: Column, until: Column) -> Column:
    return (since < F.col("pos")) & (until.isNull() | (F.col("pos") <= until))


def _answers(spans: DataFrame, by: list[str]) -> DataFrame:
    """Per key the spans that can be somebody's earliest match.

    Among open-ended spans sorted by start, one that begins later without an earlier representative never
    wins; what is left is a short staircase, usually one row.
    """
    open_ended = spans.filter("until IS NULL").groupBy(*by, "rep").agg(F.min("since").alias("since"))
    w = Window.partitionBy(*by).orderBy("since", "rep").rowsBetween(Window.unboundedPreceding, -1)
    stairs = open_ended.withColumn("best", F.min("rep").over(w)).filter("best IS NULL OR rep < best").drop("best")
    closed = spans.filter("until IS NOT NULL").select(*by, "rep", "since", "until")
    return stairs.withColumn("until", F.lit(None).cast("long")).select(*by, "rep", "since", "until").unionByName(closed)


def assign_representatives(items: DataFrame) -> DataFrame:
    """(pos, rep): the position of the representative every item ends up in."""
    keys = cut(prepare(items))
    spark = items.sparkSession
    # only the earlier title must have the full length; a later one may be as short as the ratio still allows
    shortest = math.ceil(fixed.MIN_TITLE_KEY * fixed.TITLE_SIMILARITY / (2 - fixed.TITLE_SIMILARITY) - 1e-9)
    eligible = keys.filter(F.col("day").isNotNull() & (F.length("title_key") >= shortest)).withColumn(
        "kind", _kind(F.col("key"), F.col("day"), F.col("numbers"))
    )
    titles = eligible.groupBy("kind").agg(*[F.first(c).alias(c) for c in ("key", "title_key", "day", "numbers")])
    titles = cut(titles)
    names = cut(keys.filter(F.length("title_key") >= fixed.MIN_TITLE_KEY).groupBy("key").agg(F.first("title_key").alias("title_key")))
    item_kinds = eligible.select("pos", "kind")
    addresses = keys.select("pos", F.explode("addresses").alias("address"))

    first = keys.groupBy("key").agg(F.min("pos").alias("rep"))
    assigned = cut(keys.select("pos", "key").join(first.hint("merge"), "key").select("pos", "rep"))
    edges = spark.createDataFrame([], "leader string, kind string")
    expanded = spark.createDataFrame([], "kind string")
    crowded, has_crowded = spark.createDataFrame([], "kind string"), False
    leaders_per_block, settled = LEADERS, False
    while True:
        near_spans = _named(_segments(keys, assigned))
        wanted = (
            near_spans.groupBy(F.col("leader").alias("kind"))
            .agg(F.min("since").alias("since"), *[F.first(c).alias(c) for c in ("key", "day", "numbers")])
            .join(names.hint("merge"), "key")
            .join(expanded.hint("merge"), "kind", "left_anti")
        )
        wanted = cut(wanted)
        waiting, alike = False, None
        if not wanted.isEmpty():
            fresh = wanted.join(crowded.hint("merge"), "kind", "left_anti")
            around = titles.join(wanted.select("day", "numbers").distinct(), ["day", "numbers"], "left_semi")
            found = cut(_candidates(fresh, around, LEADERS))
            done = fresh.select("kind")
            pairs = found.select("leader", F.explode("kinds").alias("kind"))
            full = found.groupBy(F.col("leader").alias("kind")).agg(F.sum("n").alias("n")).filter(F.col("n") > LEADERS).select("kind")
            if has_crowded or not full.isEmpty():
                has_crowded, full = True, cut(full)
                crowded = crowded.unionByName(full)
                left = cut(wanted.join(crowded.hint("merge"), "kind", "left_semi"))
                turn = cut(_turn(left, cut(piece_frequencies(left)), leaders_per_block))
                asked = turn.filter("ready")
                pairs = pairs.join(full.select(F.col("kind").alias("leader")).hint("merge"), "leader", "left_anti").unionByName(candidate_pairs(asked, around))
                done = cut(done.join(full.hint("merge"), "kind", "left_anti").unionByName(asked.select("kind")))
                waiting = not turn.filter("NOT ready").isEmpty()
                leaders_per_block *= LEADER_GROWTH
            expanded = expanded.unionByName(done)
            if has_crowded or not found.isEmpty():
                alike = cut(similar_titles(pairs, wanted, titles))
                alike = None if alike.isEmpty() else alike
        if alike is not None:
            edges = edges.unionByName(alike)
        if alike is not None or not settled:
            assigned, settled = _settled(keys, addresses, item_kinds, edges, assigned), True
        elif not waiting:
            return assigned


def _named(spans: DataFrame) -> DataFrame:
    """The spans in which a representative may be found by likeness, with the kind it goes by."""
    return spans.filter("day IS NOT NULL").withColumn("leader", _kind(F.col("key"), F.col("day"), F.col("numbers")))


def _settled(keys: DataFrame, addresses: DataFrame, item_kinds: DataFrame, edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """(pos, rep) when only the given edges count as similar: the assignment is recomputed until nothing moves."""
    while True:
        spans = _segments(keys, assigned)
        near_spans = _named(spans)
        # Titles: a change of day does not interrupt a title, so spans of one title are joined up again.
        titled = spans.groupBy("rep", "key", F.col("titled_since").alias("since")).agg(
            F.max(F.col("until").isNull()).alias("open"), F.max("until").alias("end")
        ).select("rep", "key", "since", F.when(~F.col("open"), F.col("end")).alias("until"))
        by_title = keys.select("pos", "key").join(_answers(titled, ["key"]).hint("merge"), "key").filter(_valid(F.col("since"), F.col("until")))
        brought = addresses.join(assigned.hint("merge"), "pos").groupBy("address", "rep").agg(F.min("pos").alias("since"))
        by_address = addresses.join(
            _answers(brought.withColumn("until", F.lit(None).cast("long")), ["address"]).hint("merge"), "address"
        ).filter(_valid(F.col("since"), F.col("until")))
        similar = near_spans.join(edges.hint("merge"), "leader").select("kind", "rep", "since", "until")
        by_likeness = item_kinds.join(_answers(similar, ["kind"]).hint("merge"), "kind").filter(_valid(F.col("since"), F.col("until")))
        best = (
            by_title.select("pos", "rep").unionByName(by_address.select("pos", "rep")).unionByName(by_likeness.select("pos", "rep"))
            .groupBy("pos").agg(F.min("rep").alias("found"))
        )
        updated = cut(
            assigned.join(best.hint("merge"), "pos", "left").select("pos", F.coalesce("found", "pos").alias("rep"), F.col("rep").alias("before"))
        )
        moved = not updated.filter("rep != before").limit(1).isEmpty()
        assigned = updated.select("pos", "rep")
        if not moved:
            return assigned


def _turn(wanted: DataFrame, frequencies: DataFrame, leaders_per_block: int) -> DataFrame:
    """Mark the representatives that may look for partners now: among the first few in all of their blocks."""
    pieces = _rarest(wanted, frequencies).select("kind", "day", "numbers", "piece").distinct()
    sizes = pieces.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    blocks = pieces.join(sizes.hint("merge"), "kind").join(wanted.select("kind", "since").hint("merge"), "kind")
    w = Window.partitionBy("day", "numbers", "piece").orderBy("since", "kind")
    early = blocks.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= leaders_per_block)
    ready = early.groupBy("kind", "total").agg(F.count(F.lit(1)).alias("within")).filter("within = total").select(
        "kind", F.lit(True).alias("ready")
    )
    return wanted.join(ready.hint("merge"), "kind", "left").withColumn("ready", F.coalesce("ready", F.lit(False)))


def merge(items: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row per representative. items: pos, id, title, url, source, category, published, first_reported, summary, body.

    Every column is an associative aggregate over the members, so hot groups combine before the shuffle.
    Source addresses, which may be many, stay in a table of their own (merged_sources).
    """
    rows = items.join(assigned.hint("merge"), "pos").withColumn("official", urls.host(F.col("url")).endswith(".gov.cn"))
    me = F.col("pos") == F.col("rep")
    head = F.struct("id", "title", "url", "source", "category", "published", "first_reported", "official")
    longest = lambda c: F.max_by(c, F.struct(F.length(c), -F.col("pos")))
    out = rows.groupBy("rep").agg(
        F.max_by(head, F.when(me, F.lit(1))).alias("own"),
        F.min_by(head, F.when(~me & F.col("official") & (F.col("category") == fixed.POLICY), F.col("pos"))).alias("takeover"),
        F.min_by("published", F.when(F.col("published").isNotNull(), F.col("pos"))).alias("dated"),
        F.least(F.min("first_reported"), F.min("published")).alias("earliest"),
        longest("summary").alias("summary"),
        longest("body").alias("body"),
        F.count(F.lit(1)).alias("members"),
    )
    taken = F.when(~F.col("own.official"), F.col("takeover"))
    g = out.withColumn("taken", taken)
    pick = lambda c: F.when(F.col("taken").isNotNull(), F.col(f"taken.{c}")).otherwise(F.col(f"own.{c}")).alias(c)
    return g.select(
        "rep", F.col("own.id").alias("id"), pick("title"), pick("url"), pick("source"), pick("category"),
        F.coalesce("taken.published", "dated").alias("published"),
        F.when(F.col("members") > 1, F.col("earliest")).otherwise(F.col("own.first_reported")).alias("first_reported"),
        "summary", "body", "members",
    )


def merged_sources(items: DataFrame, assigned: DataFrame) -> DataFrame:
    """(rep, address, place): the distinct source addresses of each representative in order of arrival."""
    listed = items.select("pos", F.posexplode(F.array_distinct(F.concat(F.array("url"), "source_urls"))).alias("i", "address"))
    return listed.join(assigned.hint("merge"), "pos").groupBy("rep", "address").agg(F.min(F.struct("pos", "i")).alias("place"))
