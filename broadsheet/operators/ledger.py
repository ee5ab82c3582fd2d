"""Day-over-day state: sightings, candidates, deliveries, tombstones, retention.

Every update is a union of the stored table and the day's rows followed by one aggregation whose functions are
associative (min, max, max_by), so partial aggregation runs before the shuffle and an id that makes up a
third of the input is reduced to one row per task first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import dates, text
from broadsheet.session import cut


def exploded_aliases(items: DataFrame, key: str, source_urls: str = "source_urls") -> DataFrame:
    keys = text.aliases(F.col("title"), F.col("summary"), F.col("category"), F.col(source_urls))
    return items.select(key, "category", F.explode(keys).alias("alias"))


def keys_with_alias(aliases: DataFrame, key: str, ledger: DataFrame) -> DataFrame:
    """Distinct item keys with at least one alias in the ledger."""
    return aliases.join(ledger.select("alias").distinct(), "alias", "left_semi").select(key).distinct()


def sent_aliases(delivered: DataFrame, policy_delivered: DataFrame) -> DataFrame:
    """Aliases held as sent or pending in either delivery ledger."""
    both = delivered.select("alias", "status").unionByName(policy_delivered.select("alias", "status"))
    return both.filter(F.col("status").isin("sent", "pending")).select("alias").distinct()


def undelivered(items: DataFrame, key: str, delivered: DataFrame, policy_delivered: DataFrame) -> DataFrame:
    seen = keys_with_alias(exploded_aliases(items, key), key, sent_aliases(delivered, policy_delivered))
    return items.join(seen, key, "left_anti")


def not_tombstoned(items: DataFrame, key: str, tombstones: DataFrame) -> DataFrame:
    return items.join(keys_with_alias(exploded_aliases(items, key), key, tombstones), key, "left_anti")


def ever_seen(items: DataFrame, key: str, tombstones: DataFrame, sent: DataFrame, *id_tables: DataFrame) -> DataFrame:
    """Keys known to any table: removed, sent, observed, retained or stored."""
    aliases = exploded_aliases(items, key)
    ledger = tombstones.select("alias").unionByName(sent.select("alias"))
    known = keys_with_alias(aliases, key, ledger)
    ids = None
    for table in id_tables:
        one = table.select(F.col("id").alias(key))
        ids = one if ids is None else ids.unionByName(one)
    if ids is not None:
        known = known.unionByName(items.join(ids.distinct(), key, "left_semi").select(key))
    return known.distinct()


def first_seen(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """First sighting per id; a later sighting or a candidate's expiry never moves it."""
    both = stored.select("id", "first_seen").unionByName(observed.select("id", F.col("day").alias("first_seen")))
    return both.groupBy("id").agg(F.min("first_seen").alias("first_seen"))


def _last(value: str, where: Column) -> Column:
    return F.max_by(value, F.when(where, F.col("seq")))


def upsert_candidates(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """Merge the day's evidence into the candidate table.

    Both sides: id, seq, first_seen, last_seen, published, date_evidence, first_reported, summary, excerpt, released. ``seq``
    orders sightings and stored rows come before new ones. Longest source summary wins (latest on a tie); a
    known date is never lost to an undated sighting; first and last sighting days are kept.
    """
    rows = stored.unionByName(observed)
    dated = F.col("published").isNotNull()
    out = rows.groupBy("id").agg(
        F.max("seq").alias("seq"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max_by("summary", F.struct(F.length("summary"), F.col("seq"))).alias("summary"),
        _last("excerpt", F.col("excerpt") != "").alias("excerpt"),
        _last("published", dated).alias("published"),
        _last("date_evidence", dated).alias("_dated_evidence"),
        F.max_by("date_evidence", "seq").alias("_last_evidence"),
        _last("first_reported", F.col("first_reported").isNotNull()).alias("first_reported"),
        F.min("released").alias("released"),
    )
    return out.withColumn(
        "date_evidence", F.when(dated, F.col("_dated_evidence")).otherwise(F.col("_last_evidence"))
    ).withColumn("excerpt", F.coalesce("excerpt", F.lit(""))).drop("_dated_evidence", "_last_evidence")


def sightings(observed: DataFrame) -> DataFrame:
    """Rows seen on one day, in the shape of the candidate table."""
    return observed.withColumn("first_seen", F.col("day")).withColumnRenamed("day", "last_seen")


def release(candidates: DataFrame, today: Column) -> DataFrame:
    return candidates.withColumn("released", F.coalesce("released", today))


def retention(candidates: DataFrame, today: Column, days: int, use_first_reported: bool) -> DataFrame:
    """Add ``fate``: keep, tombstone (dated and out of window) or drop (undated, may come back)."""
    undated = F.col("published").isNull() | (F.col("date_evidence") == "recent_first_seen")
    reported = F.col("first_reported") if use_first_reported else F.lit(None).cast("date")
    clock = F.when(undated, F.coalesce("first_seen", "first_reported")).otherwise(
        F.coalesce(reported, F.col("published"))
    )
    fresh = dates.in_window(today, clock, F.lit(days))
    return candidates.withColumn(
        "fate", F.when(fresh, F.lit("keep")).when(undated, F.lit("drop")).otherwise(F.lit("tombstone"))
    )


def expire(rows: DataFrame, today: Column, days: int, keep: Column | None = None) -> DataFrame:
    """Rows younger than ``days``, plus those a condition protects."""
    young = F.col("day") >= F.date_sub(today, days)
    return rows.filter(young if keep is None else young | keep)


def expire_deliveries(delivered: DataFrame, today: Column) -> DataFrame:
    return expire(delivered, today, fixed.LEDGER_DAYS, F.col("status") == "pending")


def expire_sent_events(events: DataFrame, today: Column, days: int = fixed.HISTORY_DAYS) -> DataFrame:
    return expire(events, today, days, F.col("category") == fixed.POLICY)


def mark(ledger: DataFrame, marks: DataFrame) -> DataFrame:
    """Latest status per alias. Both sides: alias, day, status, seq."""
    rows = ledger.unionByName(marks)
    latest = rows.groupBy("alias").agg(F.max_by(F.struct("day", "status", "seq"), "seq").alias("r"))
    return latest.select("alias", "r.day", "r.status", "r.seq")


def delivery_due(sent_days: DataFrame, group: list[str], today: Column, interval: int) -> DataFrame:
    last = sent_days.groupBy(*group).agg(F.max(F.when(F.col("status") == "sent", F.col("day"))).alias("last_sent"))
    return last.withColumn(
        "due", F.col("last_sent").isNull() | (F.datediff(today, "last_sent") >= interval)
    )


def insert_or_ignore(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows win; among new rows of one key the first by ``seq`` wins."""
    columns = [c for c in stored.columns if c not in (key, "seq")]
    old = stored.select(key, F.lit(0).alias("_side"), "seq", *columns)
    rows = old.unionByName(new.select(key, F.lit(1).alias("_side"), "seq", *columns))
    first = rows.groupBy(key).agg(F.min_by(F.struct("seq", *columns), F.struct("_side", "seq")).alias("r"))
    return first.select(key, "r.*")


def remove_candidates(removed: DataFrame, tables: dict[str, DataFrame], caches: dict[str, DataFrame],
                      tombstones: DataFrame) -> tuple[DataFrame, dict[str, DataFrame], dict[str, DataFrame]]:
    """Tombstone the aliases of removed items, then drop matching rows and their cached decisions."""
    added = exploded_aliases(removed, "id").select("alias")
    graves = tombstones.select("alias").unionByName(added).distinct()
    kept, gone = {}, None
    for name, table in tables.items():
        hit = keys_with_alias(exploded_aliases(table, "id"), "id", graves)
        kept[name] = table.join(hit, "id", "left_anti")
        gone = hit if gone is None else gone.unionByName(hit)
    gone = gone.distinct()
    return graves, kept, {n: c.join(gone, "id", "left_anti") for n, c in caches.items()}


def unsent_reviews(articles: DataFrame, candidates: DataFrame, sent_ids: DataFrame, day: Column) -> DataFrame:
    """Ids assessed on a day and never delivered: their assessment may be undone."""
    seen = candidates.filter(F.col("last_seen") == day).select("id")
    reviewed = articles.filter("relevance IS NOT NULL").join(seen, "id", "left_semi").select("id").distinct()
    return reviewed.join(sent_ids.select("id").distinct(), "id", "left_anti")


def clear_reviews(articles: DataFrame, caches: DataFrame, unsent: DataFrame, sent_ids: DataFrame, day: Column,
                  batch_kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Drop unsent assessed articles, their caches, the day's batch decisions and the day's orphaned scores.

    caches: kind, id, day. Decisions keyed by a batch carry no article id and go by day alone.
    """
    kept_articles = articles.join(unsent, "id", "left_anti")
    shielded = kept_articles.join(sent_ids, "id", "left_semi").select("id").distinct()
    batch = F.col("kind").isin(*batch_kinds)
    rest = caches.filter(~(batch & (F.col("day") == day)))
    per_item = rest.join(unsent.withColumn("u", F.lit(True)), "id", "left").join(
        shielded.withColumn("s", F.lit(True)), "id", "left"
    )
    orphan = (F.col("kind") == "score") & (F.col("day") == day) & F.col("s").isNull()
    drop = (~batch & F.coalesce("u", F.lit(False))) | orphan
    return kept_articles, per_item.filter(~F.coalesce(drop, F.lit(False))).drop("u", "s")


def added_since(current: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """Keys in the current version and not in the earlier one."""
    return current.select(key).distinct().join(prior.select(key).distinct(), key, "left_anti")


def roll_back(current: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """The current table without anything added after the earlier version."""
    return current.join(prior.select(key).distinct(), key, "left_semi")


#: Delivery tables of a roll-back and their keys.
DELIVERY_KEYS = {"delivered": "alias", "policy_delivered": "alias", "reports": "key", "sent_events": "id"}


def delivery_changes(current: dict[str, DataFrame], prior: dict[str, DataFrame]) -> DataFrame:
    """The change set between two versions of the delivery tables: (table, key) of all that was added since."""
    added = [
        added_since(current[name], prior[name], key).select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"))
        for name, key in DELIVERY_KEYS.items()
    ]
    return reduce(DataFrame.unionByName, added)


def roll_back_deliveries(current: dict[str, DataFrame], prior: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The delivery tables without what was added after an earlier version, and how much of each went.

    Rows known to the earlier version stay as they are now; the one-row table ``counts`` is taken from it. Unconfirmed
    deliveries forbid a roll-back. The change set is computed once and drives both results.
    """
    refuse_while_pending(current["delivered"], current["policy_delivered"])
    changes = cut(delivery_changes(current, prior))
    tables = dict(current)
    for name, key in DELIVERY_KEYS.items():
        gone = changes.filter(F.col("table") == name).select(F.col("key").alias(key))
        tables[name] = current[name].join(gone, current[name][key].cast("string") == gone[key], "left_anti")
    tables["counts"] = prior["counts"]
    named = F.explode(F.array(*[F.lit(n) for n in DELIVERY_KEYS])).alias("table")
    names = changes.sparkSession.range(1).select(named)
    removed = changes.groupBy("table").agg(F.count(F.lit(1)).alias("removed"))
    return tables, names.join(removed, "table", "left").fillna(0, ["removed"])


def refuse_while_pending(*ledgers: DataFrame) -> None:
    """Resets and rollbacks stop while any delivery is unconfirmed."""
    for ledger in ledgers:
        if not ledger.filter("status = 'pending'").limit(1).isEmpty():
            raise RuntimeError("unconfirmed deliveries exist; settle them first")


def without_delivery_history(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The same state with empty delivery tables: a preview reads nothing that was sent."""
    empty = {"delivered", "policy_delivered", "sent_events"}
    return {name: table.limit(0) if name in empty else table for name, table in state.items()}


def reset_deliveries(state: dict[str, DataFrame], markers: DataFrame, marker: str) -> dict[str, DataFrame]:
    """One-time reset: a set marker makes it a no-op, a pending delivery makes it an error."""
    if not markers.filter(F.col("marker") == marker).limit(1).isEmpty():
        return state
    refuse_while_pending(state["delivered"], state["policy_delivered"])
    return without_delivery_history(state)


def new_editions(editions: DataFrame, delivered_editions: DataFrame) -> DataFrame:
    """Editions whose day and text have not been handed over before."""
    keyed = editions.withColumn("delivery_key", F.concat(F.col("edition_day").cast("string"), F.lit(":"), text.digest(F.col("body"))))
    held = delivered_editions.filter(F.col("status").isin("pending", "sent")).select("delivery_key")
    return keyed.join(held, "delivery_key", "left_anti")


def sent_history_backfill(articles: DataFrame, delivered: DataFrame, history: DataFrame) -> DataFrame:
    """Stored articles that were delivered but miss a history row, with their delivery day."""
    first_alias = text.digest(F.concat(F.lit("url:"), F.element_at("source_urls", 1)))
    sent = delivered.filter(F.col("status").isin("sent", "pending")).select("alias", "day")
    hit = articles.withColumn("alias", first_alias).join(sent, "alias")
    return hit.join(history.select("id"), "id", "left_anti").select("id", "day", "category")


def recent_articles(articles: DataFrame, today: Column, days: int) -> DataFrame:
    return articles.filter((F.col("published") >= F.date_sub(today, days)) | (F.col("category") == fixed.POLICY))


def recent_history(events: DataFrame, today: Column, days: int = fixed.HISTORY_DAYS) -> DataFrame:
    return events.filter((F.col("day") >= F.date_sub(today, days)) | (F.col("category") == fixed.POLICY))


def cached_and_pending(items: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split on the decision cache: same id, same signature, same evidence."""
    keys = ["id", "signature", "evidence"]
    return items.join(cache, keys, "inner"), items.join(cache.select(*keys), keys, "left_anti")


def trusted_first_seen(items: DataFrame, ledger: DataFrame, known: DataFrame, today: Column, days: int) -> DataFrame:
    """Undated rows of curated listings that may stand on their discovery day.

    items: id, source_kind, category, published, date_evidence.
    """
    eligible = items.filter(
        (F.col("list_kind") == "html")
        & F.col("category").isin(*fixed.UNDATED_CATEGORIES)
        & F.col("published").isNull()
        & (F.col("date_evidence") == "no_date_hint")
    )
    joined = eligible.join(ledger, "id", "left").join(known.select("id").distinct().withColumn("k", F.lit(True)), "id", "left")
    fresh = joined.filter(F.col("first_seen").isNotNull() | F.col("k").isNull()).withColumn(
        "first_seen", F.coalesce("first_seen", today)
    )
    return fresh.filter(dates.in_window(today, F.col("first_seen"), F.lit(days))).select("id", "first_seen")


def exploration_allowance(deliveries: DataFrame, group: list[str], cap: int, ratio: float) -> DataFrame:
    """Exploration places still due: floor((total + cap) * ratio) minus those already used."""
    counts = deliveries.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("exploration").alias("explored")
    )
    return counts.withColumn(
        "allowance", (F.floor((F.col("total") + cap) * ratio) - F.col("explored")).cast("int")
    )


def save_articles(stored: DataFrame, new: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Latest row per id; rows under a tombstone are not stored. Both sides: id, seq and the article columns."""
    allowed = not_tombstoned(new, "id", tombstones)
    columns = [c for c in stored.columns if c != "id"]
    rows = stored.select("id", F.lit(0).alias("_side"), *columns).unionByName(allowed.select("id", F.lit(1).alias("_side"), *columns))
    latest = rows.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("_side", "seq")).alias("r"))
    return latest.select("id", "r.*")


def first_by_order(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in the given order; an aggregation, so hot keys shrink before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")
