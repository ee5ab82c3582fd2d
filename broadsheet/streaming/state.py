"""The state jobs as Structured Streaming: first sightings and the candidate table."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from broadsheet.operators import ledger
from broadsheet.sources import tables

CANDIDATES = (
    "id string, seq long, first_seen date, last_seen date, summary string, excerpt string, published date, "
    "first_reported date, released date, date_evidence string"
)


def drop_late(observed: DataFrame, days: int) -> DataFrame:
    """Dated rows already outside the window when seen are dropped before any state; undated rows pass."""
    return observed.filter(F.col("published").isNull() | (F.datediff("day", "published").between(0, days - 1)))


def first_seen_stream(observed: DataFrame, log: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Running minimum per id in the state store; each micro-batch logs only the ids that changed.

    A batch that is run again after a failure rewrites its own folder, so the log stays exact.
    """
    changed = observed.groupBy("id").agg(F.min("day").alias("first_seen"))

    def log_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return (
        changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(log_batch).trigger(**(trigger or {"availableNow": True})).start()
    )


def first_seen_table(spark: SparkSession, log: str) -> DataFrame:
    rows = spark.read.schema("id string, first_seen date").parquet(log)
    return rows.groupBy("id").agg(F.min("first_seen").alias("first_seen"))


def candidate_stream(observed: DataFrame, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Upsert every micro-batch into the versioned candidate table.

    Batch n reads version n and writes version n + 1, so repeating a batch repeats the same write.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = tables.read_version(spark, root, CANDIDATES, number) if number else spark.createDataFrame([], CANDIDATES)
        merged = ledger.upsert_candidates(stored, ledger.sightings(batch).select(*stored.columns))
        tables.write_version(merged.select(*stored.columns), root, number + 1)

    return (
        observed.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(apply).trigger(**(trigger or {"availableNow": True})).start()
    )


def retained_stream(observed: DataFrame, root: str, checkpoint: str, days: int) -> StreamingQuery:
    """Candidate table fed with rows still inside the window."""
    return candidate_stream(drop_late(observed, days), root, checkpoint)


#: What is kept of a candidate between batches; a grave keeps nothing but its id.
HELD = (
    "seq long, first_seen date, last_seen date, summary string, excerpt string, published date, first_reported date, released date, "
    "date_evidence string, grave boolean"
)
_FIELDS = [c.split()[0] for c in HELD.split(", ")]
KEPT, DROPPED, BURIED = "keep", "drop", "tombstone"


def _merge(held: dict | None, row) -> dict:
    """One more sighting of a candidate, in order of arrival: see ledger.upsert_candidates."""
    if held is None:
        held = dict.fromkeys(_FIELDS) | {"first_seen": row.day, "last_seen": row.day, "summary": "", "excerpt": "", "grave": False}
    held["seq"] = int(row.seq)
    held["first_seen"], held["last_seen"] = min(held["first_seen"], row.day), max(held["last_seen"], row.day)
    if len(row.summary) >= len(held["summary"]):
        held["summary"] = row.summary
    held["excerpt"] = row.excerpt or held["excerpt"]
    if row.published is not None or held["published"] is None:
        held["published"], held["date_evidence"] = row.published, row.date_evidence
    held["first_reported"] = row.first_reported or held["first_reported"]
    held["released"] = min(x for x in (held["released"], row.released, dt.date.max) if x is not None)
    held["released"] = None if held["released"] == dt.date.max else held["released"]
    return held


class _Sighting(NamedTuple):
    id: str
    seq: int | None
    day: dt.date
    published: dt.date | None
    date_evidence: str | None
    first_reported: dt.date | None
    summary: str | None
    excerpt: str | None
    released: dt.date | None
    grave: bool


def _arrived(frames: Iterable[pd.DataFrame]) -> list[_Sighting]:
    """Sightings in order of arrival, graves last. A candidate has few, so they are handled as plain values."""
    rows = []
    for frame in frames:
        rows += zip(*[[None if x is None or x != x else x for x in frame[c].tolist()] for c in _Sighting._fields], strict=True)
    return sorted(map(_Sighting._make, rows), key=lambda r: (r.grave, r.seq is None, r.seq or 0))


def _ends(held: dict, days: int) -> dt.date:
    """First day on which a candidate is too old: dated ones count from publication, others from their first sighting."""
    undated = held["published"] is None or held["date_evidence"] == "recent_first_seen"
    return (held["first_seen"] if undated else held["published"]) + dt.timedelta(days=days)


def _packed(held: dict[str, dict]) -> str:
    values = {key: None if h["grave"] else [x.isoformat() if isinstance(x, dt.date) else x for x in (h[c] for c in _FIELDS[:-1])] for key, h in held.items()}
    return json.dumps(values, ensure_ascii=False)


def _unpacked(text: str) -> dict[str, dict]:
    bury = dict.fromkeys(_FIELDS) | {"grave": True}
    days = {c.split()[0] for c in HELD.split(", ") if c.endswith(" date")}
    day = dt.date.fromisoformat

    def fields(values: list) -> dict:
        return {c: day(x) if c in days and x is not None else x for c, x in zip(_FIELDS, values, strict=False)} | {"grave": False}

    return {key: bury if values is None else fields(values) for key, values in json.loads(text).items()}


def expiring_candidates(observed: DataFrame, graves: DataFrame, days: int, late_days: int = 1, buckets: int = 1024) -> DataFrame:
    """Changes of the candidate table: id, the candidate's fields and its fate, for changed candidates only.

    observed: the columns of a sighting; graves: id, day of removed candidates. A removed candidate and one that grew too
    old by its publication day leave a grave, and later sightings are refused; an undated one that grew too old is
    forgotten and may come back. Time is the day of the sightings, less `late_days`.

    State is kept for buckets of ids, with a timer at the first day on which one of them ends: a group of rows costs
    far more to hand to Python than a candidate costs there, so groups do not grow in number with the candidates.
    """
    columns = ["id", "seq", "day", "published", "date_evidence", "first_reported", "summary", "excerpt", "released"]
    rows = observed.select(*columns, F.lit(False).alias("grave")).unionByName(graves.select("id", "day", F.lit(True).alias("grave")), allowMissingColumns=True)
    rows = rows.filter("id is not null").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    rows = rows.withColumn("seen_at", F.to_timestamp("day")).withWatermark("seen_at", f"{late_days} days")

    def settled(held: dict | None, arrived: list[_Sighting], today: dt.date) -> tuple[dict | None, str | None, dict | None]:
        """A candidate after its sightings, its fate and the fields to tell; a fate of None is not told."""
        bury = dict.fromkeys(_FIELDS) | {"grave": True}
        changed = held if held is not None and not held["grave"] else None
        fate = None
        if changed is not None and _ends(held, days) <= today:
            fate = DROPPED if held["published"] is None or held["date_evidence"] == "recent_first_seen" else BURIED
            held = None if fate == DROPPED else bury
        for row in arrived:
            if row.grave:
                fate, held = BURIED, bury
            elif held is None or not held["grave"]:
                held = _merge(held, row)
                changed, fate = held, KEPT
        return held, fate if changed is not None or fate == BURIED else None, changed or bury

    def step(key, frames, state: GroupState):
        held = _unpacked(state.get[0]) if state.exists else {}
        today = dt.date(1970, 1, 1) + dt.timedelta(milliseconds=max(state.getCurrentWatermarkMs(), 0))
        arrived: dict[str, list[_Sighting]] = {}
        if not state.hasTimedOut:
            for row in _arrived(frames):
                arrived.setdefault(row.id, []).append(row)
        ended = [k for k, h in held.items() if k not in arrived and not h["grave"] and _ends(h, days) <= today]
        told = []
        for k in [*arrived, *ended]:
            now, fate, fields = settled(held.get(k), arrived.get(k, []), today)
            if now is None:
                held.pop(k, None)
            else:
                held[k] = now
            if fate is not None:
                told.append([k, *(fields[c] for c in _FIELDS[:-1]), fate])
        if not held:
            state.remove()
        else:
            state.update((_packed(held),))
            ends = [_ends(h, days) for h in held.values() if not h["grave"]]
            if ends:
                end = dt.datetime.combine(min(ends), dt.time(), dt.timezone.utc)
                # a timer goes off once the watermark has passed it
                state.setTimeoutTimestamp(max(int(end.timestamp() * 1000) - 1, state.getCurrentWatermarkMs() + 1))
        if told:
            yield pd.DataFrame(told, columns=["id", *_FIELDS[:-1], "fate"])

    schema = "id string, " + HELD.removesuffix(", grave boolean") + ", fate string"
    return rows.groupBy("bucket").applyInPandasWithState(step, schema, "held string", "update", GroupStateTimeout.EventTimeTimeout)


def logged(changes: DataFrame, log: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes each batch's changes to its own folder; a batch that is run again rewrites its folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def candidate_table(spark: SparkSession, log: str) -> DataFrame:
    """The candidates as the logged changes leave them: the latest change of each id, if it keeps it."""
    rows = spark.read.schema("id string, " + HELD.removesuffix(", grave boolean") + ", fate string, batch long").parquet(log)
    fields = [c for c in rows.columns if c not in ("id", "batch")]
    latest = rows.groupBy("id").agg(F.max_by(F.struct(*fields), "batch").alias("r")).select("id", "r.*")
    return latest.filter(F.col("fate") == KEPT).drop("fate")
