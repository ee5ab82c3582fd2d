"""Small cases for answers that were wrong once."""

import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import scores
from broadsheet.operators import coverage, duplicates, events, gates, matching, reputation


def test_rounding_is_that_of_exact_binary_values(spark):
    rng = random.Random(1)
    values = [6.25, 18.75, 0.21375, 2.5, 0.125, 0.375, 1.005, 0.0] + [round(rng.random() * 100, 5) for _ in range(3000)] + [k / 16 for k in range(200)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = frame.select(*[scores.rounded(F.col("v"), d).alias(f"r{d}") for d in (1, 2, 4)], "v").collect()
    for r in got:
        assert (r["r1"], r["r2"], r["r4"]) == (round(r["v"], 1), round(r["v"], 2), round(r["v"], 4)), r
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?) AS v", [values])
    for d in (1, 2, 4):
        assert all(r == round(v, d) for v, r in con.execute(f"SELECT v, {scores.sql_rounded('v', d)} FROM t").fetchall())


def test_date_rate_of_one_in_sixteen(spark):
    rows = [("s", dt.date(2024, 1, 1) if i == 0 else None, "listing", True) for i in range(16)]
    frame = spark.createDataFrame(rows, "source string, published date, date_evidence string, kept boolean")
    assert coverage.date_coverage(frame, "source").first()["date_rate_pct"] == 6.2


def test_short_later_title_merges(spark):
    day, schema = dt.date(2024, 1, 1), "pos long, id string, title string, url string, source string, category string, published date, first_reported date, summary string, body string, source_urls array<string>"
    rows = [(i, str(i), t, f"https://e.org/{i}", "s", "行业", day, None, "", "", []) for i, t in enumerate(["abcdefghijklmn", "abcdefghijklm", "abcdefghijklmnop"])]
    reps = {r.pos: r.rep for r in duplicates.assign_representatives(spark.createDataFrame(rows, schema)).collect()}
    assert reps == {0: 0, 1: 0, 2: 0}
    reps = {r.pos: r.rep for r in duplicates.assign_representatives(spark.createDataFrame([(1 - r[0], *r[1:]) for r in rows[:2]], schema)).collect()}
    assert reps == {0: 0, 1: 1}  # the earlier title is the short one


def test_rule_table_takes_terms_of_any_length(spark):
    rules = spark.createDataFrame([("long", [["one two three four"]]), ("cjk", [["脑机接口"], ["EEG", "脑电"]]), ("no", [["two one"]])], "id string, groups array<array<string>>")
    items = spark.createDataFrame([(1, "", "", "so One, two three-four!"), (2, "脑机接口 eeg", "", ""), (3, "脑机接口", "", "one two")], "id long, title string, summary string, body string")
    assert {tuple(r) for r in matching.match_rule_table(items, "id", rules).collect()} == {(1, "long"), (2, "cjk")}


def test_province_alone_is_evidence(spark):
    row = spark.createDataFrame([("https://e.org/1", "北京 发布", "", "", "s"), ("https://e.org/2", "澳门 发布", "", "", "s"), ("https://e.org/3", "澳门政府", "", "", "s")], "url string, title string, summary string, body string, source string")
    seen = row.select(gates.jurisdiction_evidence(*[F.col(c) for c in row.columns]).alias("e")).collect()
    assert [r["e"] for r in seen] == [True, False, True]


def grouped(spark, rows, members=("a", "b")):
    """Primaries of one declared group; rows are (id, category, accepted, published)."""
    schema = "batch int, id string, title string, url string, category string, accepted boolean, published date, first_reported date, ranking double, sources array<struct<url:string,name:string>>"
    items = [(1, i, f"title {i}", f"https://e.org/{i}", c, ok, day, None, float(k), [(f"https://e.org/{i}", "s")]) for k, (i, c, ok, day) in enumerate(rows)]
    groups = spark.createDataFrame([(1, 0, list(members))], "batch int, group_no int, members array<string>")
    primaries, removed = events.merge_declared_groups(spark.createDataFrame(items, schema), groups, ["batch"])
    return [r.id for r in primaries.collect()], [r.id for r in removed.collect()]


def test_groups_hold_accepted_dated_items_outside_research(spark):
    day, kind = dt.date(2024, 1, 1), fixed.INDUSTRY
    assert grouped(spark, [("a", kind, True, day), ("b", kind, True, day)]) == (["b"], ["a"])
    assert grouped(spark, [("a", kind, True, day), ("b", kind, False, day)]) == ([], [])
    assert grouped(spark, [("a", kind, True, day), ("b", kind, True, None)]) == ([], [])
    assert grouped(spark, [("a", fixed.ACADEMIC, True, day), ("b", fixed.ACADEMIC, True, day)]) == ([], [])


def test_official_domains_meet_in_both_directions(spark):
    companies = spark.createDataFrame([("Acme Labs",), ("ac",), ("Other",), ("",), (None,)], "company string")
    sources = spark.createDataFrame([("ACME", "https://www.acme.com/"), ("Beacon", "https://beacon.org/"), ("", "https://none.org/"), (None, "https://none.org/")], "company string, url string")
    assert {tuple(r) for r in reputation.official_domains(companies, sources).collect()} == {("Acme Labs", "acme.com"), ("ac", "acme.com"), ("ac", "beacon.org")}
