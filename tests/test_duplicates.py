"""The distributed merge against a plain sequential one written for the test."""

import datetime as dt
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import similarity
from broadsheet.operators import duplicates
from broadsheet.plans import catalog, duplicate_queries

SF = "/root/testdata/sf0.001"

SCHEMA = (
    "pos long, id string, title string, url string, source string, category string, published date, "
    "first_reported date, summary string, body string, source_urls array<string>"
)


def key(title):
    return re.sub(r"[^\w]", "", title.casefold())


def nums(title):
    return re.findall(r"\d+(?:\.\d+)?", title)


def official(url):
    return re.sub(r"^https?://([^/]*).*", r"\1", url).endswith(".gov.cn")


def sequential(rows):
    reps, out = [], {}
    for r in rows:
        urls = {r["url"], *r["source_urls"]}
        for g in reps:
            same_day = g["published"] and g["published"] == r["published"]
            alike = (
                same_day and len(key(g["title"])) >= 14 and nums(g["title"]) == nums(r["title"])
                and SequenceMatcher(None, key(g["title"]), key(r["title"])).ratio() >= 0.92
            )
            if urls & g["urls"] or key(g["title"]) == key(r["title"]) or alike:
                g["urls"] |= urls
                g["dates"] += [r["published"]]
                g["published"] = g["published"] or r["published"]
                g["n"] += 1
                if r["category"] == "政策" and official(r["url"]) and not official(g["url"]):
                    g.update(url=r["url"], title=r["title"], published=r["published"] or g["published"])
                out[r["pos"]] = g["pos"]
                break
        else:
            reps.append(dict(pos=r["pos"], title=r["title"], url=r["url"], published=r["published"], urls=urls, n=1, dates=[r["published"]]))
            out[r["pos"]] = r["pos"]
    return out, reps


def fixture(seed, n=140):
    rnd = random.Random(seed)
    stems = ["Neural headset maker ships first consumer model today", "Regulator publishes draft data standard for wearables",
             "University team opens large signal dataset to public", "短标题", "Startup closes round 12 for sleep earbuds", "!!!"]
    rows = []
    for i in range(n):
        title = rnd.choice(stems)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(title))
            title = title[:at] + rnd.choice("abcxyz 7") + title[at + rnd.randint(0, 1):]
        day = rnd.choice([None, dt.date(2024, 1, 1), dt.date(2024, 1, 1), dt.date(2024, 1, 2)])
        host = rnd.choice(["a.example.org", "b.example.org", "c.gov.cn", "www.d.gov.cn"])
        url = f"https://{host}/{rnd.randint(0, 90)}"
        extra = [f"https://x.example.org/{rnd.randint(0, 120)}"] if rnd.random() < 0.3 else []
        rows.append(dict(pos=i, id=str(i), title=title, url=url, source=host, category=rnd.choice(["政策", "行业"]), published=day,
                         first_reported=None, summary="s" * rnd.randint(0, 5), body="b", source_urls=extra))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_sequential_merge(spark, seed):
    rows = fixture(seed)
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    expected, reps = sequential(rows)
    assigned = duplicates.assign_representatives(frame)
    assert {r.pos: r.rep for r in assigned.collect()} == expected
    merged = {r.rep: r for r in duplicates.merge(frame, assigned).collect()}
    for g in reps:
        m = merged[g["pos"]]
        assert (m.title, m.url, m.published, m.members) == (g["title"], g["url"], g["published"], g["n"])
        if g["n"] > 1:
            assert m.first_reported == min((d for d in g["dates"] if d), default=None)


def test_hot_family_of_near_copies(spark, monkeypatch):
    """Far more near copies than leaders per block still settle to one representative."""
    monkeypatch.setattr(duplicates, "LEADERS", 2)
    rows = []
    for i in range(120):
        title = "Quarterly consumer neural device shipment overview report " + "abcdefghij"[i % 10] + "klmnopqrst"[i // 12]
        rows.append((i, str(i), title, f"https://e.org/{i}", "s", "行业", dt.date(2024, 1, 1), None, "", "", []))
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {r.rep for r in duplicates.assign_representatives(frame).collect()} == {0}


def test_shared_phrase_makes_no_pairs(spark):
    """Titles that share a long phrase and nothing else are hardly ever candidates, however many there are."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    titles = [f"the market today {' '.join(word() for _ in range(6))}" for _ in range(2000)]
    keys = spark.createDataFrame([(str(i), key(t), dt.date(2024, 1, 1), "") for i, t in enumerate(titles)], "kind string, title_key string, day date, numbers string")
    # fewer than one pair a title, and those by chance; by the phrase there would be four millions
    assert duplicates.candidate_pairs(keys, keys, duplicates.piece_frequencies(keys)).count() < 2000


def test_bound_on_characters_is_safe(spark):
    rnd = random.Random(8)
    pairs = [("".join(rnd.choices("abcé数", k=rnd.randint(0, 30))), "".join(rnd.choices("abcé数", k=rnd.randint(0, 30)))) for _ in range(200)]
    rows = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
    got = rows.select("a", "b", similarity.in_common(similarity.letters(F.col("a")), similarity.letters(F.col("b"))).alias("n")).collect()
    for r in got:
        exact = sum((Counter(r.a) & Counter(r.b)).values())
        assert exact <= r.n and (r.n == exact or len(set(r.a + r.b)) < 5 or r.n >= exact)
        assert 2 * r.n >= (len(r.a) + len(r.b)) * SequenceMatcher(None, r.a, r.b).ratio() - 1e-9


def test_registered_queries_against_sequential_merge(spark):
    rows = [r.asDict() for r in duplicate_queries.reports(spark, SF).orderBy("pos").collect()]
    expected, reps = sequential(rows)
    assert {r.pos: r.rep for r in catalog.PLANS["report_assignments"](spark, SF).collect()} == expected
    merged = {r.rep: r for r in catalog.PLANS["merged_articles"](spark, SF).collect()}
    assert {g["pos"]: (g["title"], g["url"], g["published"], g["n"], len(g["urls"])) for g in reps} == {
        k: (m.title, m.url, m.published, m.members, m.n_sources) for k, m in merged.items()
    }


def test_growing_tables_are_not_collected_for_broadcast(spark):
    """The files of these tables are small enough to be taken for small tables, their rows in memory are not."""
    rows = [(f"k{i}", f"title of report {i} " * 3, "2024-01-01", "") for i in range(200)]
    titles = spark.createDataFrame(rows, "kind string, title_key string, day string, numbers string")
    titles = duplicates.cut(titles.withColumn("letters", duplicates.similarity.letters(F.col("title_key"))))
    frequencies = duplicates.cut(duplicates.piece_frequencies(titles))
    wanted = titles.withColumn("since", F.length("kind"))
    for made in (duplicates._turn(wanted, frequencies, 32), duplicates.candidate_pairs(titles, titles, frequencies)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_bounds_on_counts_are_safe_and_leave_few_pairs():
    """No similar pair is lost, short and long (where frequent characters start no stretch); unlike titles hardly ever pass."""
    rnd = random.Random(9)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyzé数", "aaaaaaaaabcdefgh"):
        for length in (14, 60, 199, 203, 420):
            base, titles = rnd.choices(alphabet, k=length), []
            for _ in range(10):
                t = base.copy()
                for _ in range(rnd.randint(0, length // 8 + 1)):
                    at = rnd.randrange(len(t))
                    t[at:at + rnd.randint(0, 1)] = rnd.choices(alphabet, k=rnd.randint(0, 1))
                titles.append("".join(t))
            found = [set(at.tolist()) for at in similarity.possible(titles, titles, 0.92)]
            assert all(j in found[i] or SequenceMatcher(None, a, b).ratio() < 0.92 for i, a in enumerate(titles) for j, b in enumerate(titles))
    syllables = ["".join(rnd.choices("abcdefghijklmnoprstu", k=2)) for _ in range(60)]
    titles = ["".join(rnd.choices(syllables, k=rnd.randint(20, 300))) for _ in range(400)]
    assert sum(map(len, similarity.possible(titles, titles, 0.92))) < 440


def test_titles_of_few_syllables_make_few_pairs(spark):
    """Titles made of the same syllables share pieces everywhere, yet hardly any two may be similar."""
    rnd = random.Random(10)
    syllables = ["".join(rnd.choices("abcdefghijklmnoprstu", k=2)) for _ in range(60)]
    titles = ["".join(rnd.choices(syllables, k=rnd.randint(20, 150))) for _ in range(600)]
    keys = spark.createDataFrame([(str(i), t, dt.date(2024, 1, 1), "") for i, t in enumerate(titles)], "kind string, title_key string, day date, numbers string")
    assert duplicates.candidate_pairs(keys, keys, duplicates.piece_frequencies(keys)).count() < 100


def test_small_blocks_and_crowded_titles(spark, monkeypatch):
    """Cells split into many blocks, and titles that more than one other may resemble, give the same merge."""
    monkeypatch.setattr(duplicates, "LEADERS", 1)
    monkeypatch.setattr(duplicates, "BLOCK_TITLES", 3)
    rows = fixture(4)
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    assert {r.pos: r.rep for r in duplicates.assign_representatives(frame).collect()} == sequential(rows)[0]
