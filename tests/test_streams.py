"""Keyed candidate state over several deliveries with a restart after each, against a plain fold; roll-backs."""

import datetime as dt
import random

import pytest

from broadsheet.operators import ledger
from broadsheet.streaming import state

D0 = dt.date(2024, 1, 1)
SEEN = (
    "id string, seq long, day date, published date, date_evidence string, first_reported date, summary string, excerpt string, released date"
)
GRAVES = "id string, day date"


def deliveries(seed):
    rnd, seq, out = random.Random(seed), 0, []
    for part in range(3):
        days = [D0 + dt.timedelta(days=8 * part + k) for k in range(8)]
        seen = []
        for day in days:
            for _ in range(6):
                seq += 1
                published = rnd.choice([None, None, day - dt.timedelta(days=rnd.randrange(12))])
                seen.append((f"c{rnd.randrange(14)}", seq, day, published, "listing" if published else rnd.choice(["no_date_hint", "hint_unparsed"]),
                             rnd.choice([None, day]), "x" * rnd.randrange(6), rnd.choice(["", f"e{seq}"]), rnd.choice([None, None, day])))
        graves = [(f"c{rnd.randrange(14)}", days[3])] if part else []
        out.append((seen, graves))
    return out


def fold(parts, days, late=1):
    """The same rules over plain dicts: candidates, graves, and a clock that moves after each delivery."""
    held, graves, clock = {}, set(), dt.date(1970, 1, 1)

    def age():
        for key, c in list(held.items()):
            start = c["published"] or c["first_seen"]
            if start + dt.timedelta(days=days) <= clock:
                if c["published"]:
                    graves.add(key)
                del held[key]

    for seen, removed in parts:
        for key, seq, day, published, evidence, reported, summary, excerpt, released in sorted(seen, key=lambda r: r[1]):
            if key in graves:
                continue
            c = held.setdefault(key, dict(seq=0, first_seen=day, last_seen=day, summary="", excerpt="", published=None, first_reported=None, released=None, date_evidence=None))
            c["seq"], c["last_seen"], c["first_seen"] = seq, max(c["last_seen"], day), min(c["first_seen"], day)
            c["summary"] = summary if len(summary) >= len(c["summary"]) else c["summary"]
            c["excerpt"] = excerpt or c["excerpt"]
            if published or not c["published"]:
                c["published"], c["date_evidence"] = published, evidence
            c["first_reported"] = reported or c["first_reported"]
            c["released"] = min(x for x in (c["released"], released) if x) if c["released"] or released else None
        for key, _ in removed:
            graves.add(key)
            held.pop(key, None)
        clock = max(r[2] for r in seen) - dt.timedelta(days=late)
        age()
    return held


@pytest.mark.parametrize("seed", [1, 2])
def test_state_over_restarts(spark, tmp_path, seed):
    parts = deliveries(seed)
    names = [c.split()[0] for c in SEEN.split(", ")]
    spark.createDataFrame([], GRAVES).write.parquet(str(tmp_path / "graves" / "none"))
    for i, (seen, graves) in enumerate(parts):
        spark.createDataFrame(seen, SEEN).repartition(3).write.parquet(str(tmp_path / "seen" / str(i)))
        spark.createDataFrame(graves, GRAVES).write.parquet(str(tmp_path / "graves" / str(i)))
        # a new query each time: only its checkpoint and log carry over
        observed = spark.readStream.schema(SEEN).option("recursiveFileLookup", True).parquet(str(tmp_path / "seen"))
        removed = spark.readStream.schema(GRAVES).option("recursiveFileLookup", True).parquet(str(tmp_path / "graves"))
        state.logged(state.expiring_candidates(observed, removed, 9), str(tmp_path / "log"), str(tmp_path / "checkpoint")).awaitTermination()
    got = {r["id"]: r.asDict() for r in state.candidate_table(spark, str(tmp_path / "log")).collect()}
    want = fold(parts, 9)
    assert set(got) == set(want) and want
    fields = [c for c in names if c not in ("id", "day")] + ["first_seen", "last_seen"]
    assert {k: {f: got[k][f] for f in fields} for k in got} == {k: {f: c[f] for f in fields} for k, c in want.items()}
    log = spark.read.parquet(str(tmp_path / "log"))
    assert {r[0] for r in log.select("fate").distinct().collect()} == {"keep", "drop", "tombstone"}


def test_candidates_that_share_a_bucket(spark, tmp_path):
    """Two buckets hold all ids: state, timers and graves stay each candidate's own."""
    parts = deliveries(3)
    spark.createDataFrame([], GRAVES).write.parquet(str(tmp_path / "graves" / "none"))
    for i, (seen, graves) in enumerate(parts):
        spark.createDataFrame(seen, SEEN).write.parquet(str(tmp_path / "seen" / str(i)))
        spark.createDataFrame(graves, GRAVES).write.parquet(str(tmp_path / "graves" / str(i)))
        observed = spark.readStream.schema(SEEN).option("recursiveFileLookup", True).parquet(str(tmp_path / "seen"))
        removed = spark.readStream.schema(GRAVES).option("recursiveFileLookup", True).parquet(str(tmp_path / "graves"))
        changes = state.expiring_candidates(observed, removed, 9, buckets=2)
        state.logged(changes, str(tmp_path / "log"), str(tmp_path / "checkpoint")).awaitTermination()
    got = {r["id"]: (r["seq"], r["first_seen"], r["last_seen"], r["published"]) for r in state.candidate_table(spark, str(tmp_path / "log")).collect()}
    assert got == {k: (c["seq"], c["first_seen"], c["last_seen"], c["published"]) for k, c in fold(parts, 9).items()}


def test_roll_back_of_four_tables(spark):
    def version(names, count, status="sent"):
        rows = {t: spark.createDataFrame([(n, status) for n in names], f"{k} string, status string") for t, k in ledger.DELIVERY_KEYS.items()}
        return rows | {"counts": spark.createDataFrame([(count,)], "n int")}

    now, before = version(["a", "b", "c"], 3), version(["a"], 1)
    tables, removed = ledger.roll_back_deliveries(now, before)
    assert {t: [r[0] for r in tables[t].collect()] for t in ledger.DELIVERY_KEYS} == dict.fromkeys(ledger.DELIVERY_KEYS, ["a"])
    assert tables["counts"].first()[0] == 1 and {r.table: r.removed for r in removed.collect()} == dict.fromkeys(ledger.DELIVERY_KEYS, 2)
    same, nothing = ledger.roll_back_deliveries(now, now)
    assert {r.removed for r in nothing.collect()} == {0} and same["delivered"].count() == 3
    with pytest.raises(RuntimeError):
        ledger.roll_back_deliveries(version(["a"], 1, "pending"), before)
