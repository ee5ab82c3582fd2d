"""Selection and planning against plain sequential versions written for the test, with tiny chunks."""

import datetime as dt
import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.operators import events, planning, quotas

DAY = dt.date(2026, 1, 5)
ELIGIBLE = (
    "edition_day date, profile_id string, id string, category string, companies array<string>, day date, published date, "
    "freshness double, shortlist double, ranking double, identity string"
)


def rows_for(seed, n=90):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        fresh = rnd.choice([1.0, 0.8, 0.45])
        companies = sorted(set(rnd.choices(["a", "b", "c", "d", "hot", "hot", "hot"], k=rnd.randint(0, 2))))
        out.append((DAY, rnd.choice(["p", "q"]), str(i), rnd.choice(fixed.CATEGORIES[:2] + fixed.CATEGORIES), companies, DAY, DAY,
                    fresh, float(rnd.randint(1, 30)), float(rnd.randint(1, 30)), f"{i:04d}"))
    return out


def fits(row, held, relaxed):
    cap = (2 if row[3] == fixed.ACADEMIC else 3) + relaxed
    return sum(h[3] == row[3] for h in held) < cap and all(sum(c in h[4] for h in held) < 2 + relaxed for c in row[4])


def sequential(rows):
    order = sorted(rows, key=lambda r: (r[5], r[8], r[6], r[10]), reverse=True)
    short = []
    for r in order:
        if len(short) < 10 and fits(r, short, 1):
            short.append(r)
    short += [r for r in order if r not in short][: 10 - len(short)]
    held = []
    for pool in (short, [r for r in order if r not in short]):
        while len(held) < 7:
            heads = []
            for c in fixed.CATEGORIES:
                free = [r for r in pool if r[3] == c and r not in held and fits(r, held, 0)]
                heads += [max(free, key=lambda r: (r[7], r[9], r[8], r[10]))] if free else []
            if not heads:
                break
            held.append(max(heads, key=lambda r: (r[9], r[8], r[10])))
    return {r[2] for r in short}, {r[2] for r in held}


@pytest.mark.parametrize("chunk", [2, 256])
def test_editions_match_sequential_selection(spark, monkeypatch, chunk):
    monkeypatch.setattr(quotas, "CHUNK", chunk)
    rows = rows_for(7)
    frame = spark.createDataFrame(rows, ELIGIBLE)
    short = {r.id for r in quotas.shortlist(frame, ["day", "shortlist", "published", "identity"]).collect()}
    picks = {r.id for r in quotas.select_edition(frame).collect()}
    expected = [sequential([r for r in rows if r[1] == p]) for p in ("p", "q")]
    assert short == expected[0][0] | expected[1][0]
    assert picks == expected[0][1] | expected[1][1]


def test_analysis_plan_matches_sequential_allocation(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(260):
        rows.append((DAY, "p", str(i), f"{i:05d}", rnd.choice(fixed.CATEGORIES), "hot" if rnd.random() < 0.5 else f"s{i % 9}", rnd.randint(0, 3),
                     rnd.choice([30, 70, 90]), float(rnd.randint(0, 50)), 0.5, rnd.randint(1, 4), rnd.random() < 0.3, rnd.random() < 0.5,
                     rnd.random() < 0.1, rnd.random() < 0.1, True))
    schema = ("edition_day date, profile_id string, id string, identity string, category string, source_key string, tier int, relevance int, estimate double, "
              "source_priority double, date_priority int, needs_read boolean, trusted_undated boolean, undated boolean, exploration boolean, exploration_due boolean")
    waiting, order, cats, srcs, over = list(rows), [], {}, {}, False
    while waiting and len(order) < 96:
        open_rows = [r for r in waiting if over or srcs.get(r[5], 0) < 12 or r[6] >= 3]
        if not open_rows:
            over = True
            continue
        best = min(open_rows, key=lambda r: (
            srcs.get(r[5], 0) >= 12, not (r[14] and r[15]), r[7] < 60, cats.get(r[4], 0), fixed.CATEGORY_ORDER[r[4]], -r[6], not (r[11] and r[12]),
            -r[10], -r[8], -r[9], 2 if r[13] else 1 if r[11] else 0, r[3]))
        waiting.remove(best)
        cats[best[4]] = cats.get(best[4], 0) + 1
        srcs[best[5]] = srcs.get(best[5], 0) + 1
        order.append(best[2])
    plan = planning.analysis_plan(spark.createDataFrame(rows, schema)).filter("analysis_order IS NOT NULL").orderBy("analysis_order").collect()
    assert [r.id for r in plan] == order


def test_full_direction_admits_one_clear_challenger(spark):
    schema = ("edition_day date, profile_id string, id string, identity string, category string, source_key string, tier int, relevance int, estimate double, "
              "source_priority double, date_priority int, needs_read boolean, trusted_undated boolean, undated boolean, exploration boolean, exploration_due boolean")
    row = lambda i, est: (DAY, "p", i, i, fixed.INDUSTRY, i, 2, 80, est, 0.5, 1, False, False, False, False, False)
    picks = spark.createDataFrame([(DAY, "p", fixed.INDUSTRY, 40.0)] * 3, "edition_day date, profile_id string, category string, estimate double")
    queue = spark.createDataFrame([row("weak", 45.0), row("strong", 60.0), row("second", 55.0)], schema)
    plan = {r.id: r.stage for r in planning.analysis_plan(queue, picks=picks).collect()}
    assert plan == {"weak": "deferred", "strong": "base", "second": "deferred"}


def test_priors_keep_the_newest_five(spark):
    schema = "edition_day date, profile_id string, id string, event_day date, category string, title_key string, document string, names array<string>"
    candidates = spark.createDataFrame([(DAY, "p", "new", None, fixed.INDUSTRY, "acmelaunchesneuralband", "", ["acme"])], schema)
    old = [(DAY - dt.timedelta(days=d), "p", f"o{d}", fixed.INDUSTRY, "unrelatedwords" if d % 2 else "acmelaunchesneuralbands", "", []) for d in range(1, 14)]
    old += [(DAY - dt.timedelta(days=90), "p", "late", fixed.INDUSTRY, "acmelaunchesneuralband", "", []), (DAY, "q", "other", fixed.INDUSTRY, "acmelaunchesneuralband", "", [])]
    history = spark.createDataFrame(old, "day date, profile_id string, sent_id string, category string, title_key string, document string, names array<string>")
    got = events.possible_priors(candidates, history).orderBy("prior_rank").collect()
    assert [r.sent_id for r in got] == ["o2", "o4", "o6", "o8", "o10"]
    priors = events.possible_priors(candidates, history)
    decided = "id string, event_day date, prior_key string, duplicate boolean"
    for day, covered in ((None, False), (DAY, True)):  # a decision about another event day does not count
        verdict = events.coverage_verdicts(priors, spark.createDataFrame([("new", day, "o2:o4:o6:o8:o10", False)], decided))
        assert verdict.first().covered is covered


def test_priors_against_all_pairs(spark):
    """Identity, document, names and similarity, over several editions and profiles, against a plain double loop."""
    rnd = random.Random(4)
    words = ["neural", "band", "sleep", "study", "funding", "round", "headset", "launch", "脑机", "接口"]
    names = ["acme", "acmelabs", "nova", "novabrain", "脑虎科技", "abc"]
    kinds = [fixed.INDUSTRY, fixed.POLICY]

    def facts(i, day):
        return (day, rnd.choice("pq"), f"i{rnd.randrange(30)}", None, rnd.choice(kinds), "".join(rnd.choices(words, k=rnd.randint(1, 5))), rnd.choice(["", "", "", "doc1", "doc2"]),
                rnd.sample(names, rnd.choice([0, 0, 0, 1, 2])))

    new = [facts(i, DAY + dt.timedelta(days=rnd.choice([0, 1, 40]))) for i in range(40)]
    old = [(d, p, i, c, t, doc, n) for d, p, i, _, c, t, doc, n in (facts(i, DAY - dt.timedelta(days=rnd.randrange(-20, 130))) for i in range(120))]
    got = events.possible_priors(
        spark.createDataFrame(new, "edition_day date, profile_id string, id string, event_day date, category string, title_key string, document string, names array<string>"),
        spark.createDataFrame(old, "day date, profile_id string, sent_id string, category string, title_key string, document string, names array<string>"), limit=10_000,
    ).collect()
    want = set()
    for day, p, i, _, _, title, doc, own in new:
        for sent, q, j, category, other, old_doc, theirs in old:
            if p != q or sent >= day or not (category == fixed.POLICY or sent >= day - dt.timedelta(days=fixed.HISTORY_DAYS)):
                continue
            overlap = any(a in b or b in a for a in own for b in theirs)
            if i == j or (doc and doc == old_doc) or overlap or SequenceMatcher(None, title, other).ratio() >= 0.58:
                want.add((day, p, i, j, sent))
    assert {(r.edition_day, r.profile_id, r.id, r.sent_id, r.sent_day) for r in got} == want and len(want) > 100


def test_priors_compare_two_titles_once_in_many_tasks(spark, monkeypatch):
    compared = spark.sparkContext.accumulator(0)

    def counted(floor):
        @F.pandas_udf("double")
        def ratio(earlier: pd.Series, later: pd.Series) -> pd.Series:
            compared.add(len(earlier))
            return pd.Series([float(a == b) for a, b in zip(earlier, later)], dtype="float64")

        return ratio.asNondeterministic()

    schema = "edition_day date, profile_id string, id string, event_day date, category string, title_key string, document string, names array<string>"
    days = [DAY + dt.timedelta(days=i) for i in range(6)]
    facts = spark.createDataFrame([(d, "p", f"i{n}", None, fixed.INDUSTRY, "acmelaunchesneuralband", "", []) for d in days for n in range(3)], schema)
    history = facts.withColumnRenamed("edition_day", "day").withColumnRenamed("id", "sent_id")
    monkeypatch.setattr(events.similarity, "ratio_at_least", counted)
    priors = events.possible_priors(facts, history, limit=10_000)
    assert priors.count() == 15 * 9 and compared.value == 1  # 135 pairs of items, one pair of titles
    plan = priors._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [title_key" in plan and "ascii" not in plan  # dealt by titles; letters are read, not counted again


def test_scores_of_an_article_are_computed_once(spark):
    from broadsheet.plans import selection_queries

    plan = selection_queries.scored_items(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # the host of an address was taken out of it more than a thousand times
    assert plan.count("regexp_extract") < 60
