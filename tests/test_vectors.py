"""Known inputs and results of the column functions and small jobs."""

import datetime as dt

from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import dates, scores, text, urls
from broadsheet.operators import gates, matching, repositories
from broadsheet.sources import feeds
from broadsheet.sources import repositories as repo_source
from broadsheet.sources import tables

D = dt.date


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_freshness_tiers(spark):
    ages = [-1, 0, 1, 2, 3, 6, 7, 13, 14, 29, 30]
    today = D(2026, 9, 22)
    got = column(spark, [today - dt.timedelta(days=a) for a in ages], lambda v: scores.freshness(F.lit(today), v), "date")
    assert got == [0, 1, 0.8, 0.8, 0.45, 0.45, 0.2, 0.2, 0.05, 0.05, 0]


def test_stars(spark):
    got = column(spark, [100.0, 90.0, 80.0, 70.0, 75.0, 0.0, 65.0], text.stars, "double")
    assert got == ["★★★★★", "★★★★☆", "★★★★", "★★★☆", "★★★★", "", "★★★☆"]


def test_canonical_urls(spark):
    got = column(
        spark,
        ["HTTPS://Example.org/A?utm_source=x&b=1&fbclid=2#top", "http://e.org", "ftp://e.org/", "https://u:p@e.org/", "https://e.org/?a=&q=a+b~c*"],
        urls.canonical,
    )
    assert got == ["https://example.org/A?b=1", "http://e.org/", "", "", "https://e.org/?a=&q=a+b~c%2A"]


def test_dates(spark):
    got = column(spark, ["2026年9月3日", "on 2026/13/40", "May 5, 2026 x", "3 Sep 2026", "none"], dates.date_text)
    assert got == [D(2026, 9, 3), None, D(2026, 5, 5), D(2026, 9, 3), None]
    link = lambda v: dates.url_date(urls.host(v), urls.path(v))
    assert column(spark, ["https://finance.eastmoney.com/a/202609223888.html", "https://e.org/a/202609223888.html"], link) == [D(2026, 9, 22), None]
    stamp = lambda v: F.unix_timestamp(dates.feed_timestamp(v))
    got = column(spark, ["Tue, 22 Sep 2026 08:00:00 +0800", "2026-09-22T00:00:00Z", "2026-09-22T00:00:00", "soon"], stamp)
    assert got[0] == got[1] == got[2] and got[3] is None


def test_grouped_card_date(spark):
    rows = spark.createDataFrame([("2026 年 9 月", "09-22"), ("2026年9月", "10-02"), ("no", "09-22")], "g string, c string")
    assert [r[0] for r in rows.select(dates.grouped_card_date(F.col("g"), F.col("c"))).collect()] == [D(2026, 9, 22), None, None]


def test_date_quotes(spark):
    rows = spark.createDataFrame(
        [(D(2026, 9, 21), "9月21日", D(2026, 10, 12)), (D(2026, 10, 11), "昨天", D(2026, 10, 12)), (D(2026, 9, 21), "近日", D(2026, 10, 12))],
        "e date, q string, p date",
    )
    assert [r[0] for r in rows.select(dates.quote_supports(F.col("e"), F.col("q"), F.col("p"))).collect()] == [True, True, False]


def test_scores(spark):
    rows = spark.createDataFrame([("https://unknown.example/", "original", 90, fixed.INDUSTRY)], "url string, kind string, rel int, cat string")
    none = F.lit(None).cast("double")
    effective = scores.effective_relevance(F.col("rel"), F.col("cat"), F.lit(""), {})
    rank = scores.ranking_score(effective, scores.source_factor(F.col("url"), F.col("kind"), none, none))
    assert rows.select(rank, scores.shortlist_score(effective, F.lit(0.2))).first()[:] == (69.75, 18.0)
    boosted = scores.effective_relevance(F.lit(50), F.lit(fixed.CAPITAL), F.lit(""))
    assert rows.select(boosted).first()[0] == 60
    assert rows.select(scores.business_score(F.lit(100), F.lit(80))).first()[0] == 92


def test_terms_and_interests(spark):
    texts = ["AI芯片", "daily build", "large language model", "使用mcp协议", "agents"]
    got = column(spark, texts, lambda v: text.contains_term(text.normalize(v), F.lit("ai")))
    assert got == [True, False, False, False, False]
    assert text.interest_terms("agent")[:2] == ["agent", "agents"]
    assert column(spark, ["agent"], lambda v: text.interest_terms_column(text.normalize(v)))[0] == text.interest_terms("agent")


def test_rules_need_one_place(spark):
    rule = [{"id": "r", "weight": 95, "groups": [["耳机", "headphones"], ["教育", "classroom"]]}]
    rows = spark.createDataFrame(
        [("a", "耳机进入教育", "", ""), ("b", "耳机", "", "教育。"), ("c", "", "", "headphones in the classroom"), ("d", "x", "", "headphones.\nclassroom")],
        "id string, title string, summary string, body string",
    )
    hit = {r.id: len(r.matches) for r in matching.match_rules(rows, rule).collect()}
    assert hit == {"a": 1, "b": 0, "c": 1, "d": 0}


def test_shortening(spark):
    long = "第一句完整。" + "后" * 120
    assert column(spark, [long, "x" * 120], text.shorten) == ["第一句完整。", "x" * 99 + "…"]
    head = "句" * 45 + "。"
    assert column(spark, [head + "尾" * 80, "短"], text.fit) == [head, "短"]


def test_clean_interests(spark):
    assert column(spark, [["  AI ", "ai", "", "Open  Source"]], text.clean_interests, "array<string>") == [["AI", "Open Source"]]


def test_standard_numbers_and_rounds(spark):
    assert column(spark, ["依据 YY/T 1234—2024 与 GB/T 5678-2023"], text.standard_numbers) == [["YYT1234:2024", "GBT5678:2023"]]
    assert column(spark, ["完成C轮与D+轮融资"], text.funding_rounds) == [["C", "D+"]]


def test_paper_entry(spark):
    xml = (
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2609.12345v2</id><published>2026-09-15T00:00:00Z</published>'
        "<updated>2026-09-17T00:00:00Z</updated><title>A title</title><summary>Abstract</summary></entry></feed>"
    )
    rows = spark.createDataFrame([("p", xml)], "feed string, xml string")
    got = feeds.paper_entries(rows, F.lit(D(2026, 9, 18)), 3, ["feed"]).first()
    assert (got.url, got.first_submitted, got.last_revised, got.version) == ("https://arxiv.org/abs/2609.12345", D(2026, 9, 15), D(2026, 9, 17), "v2")


def test_trending_page(spark):
    card = (
        '<article class="Box-row"><h2><a href="/{n}">x</a></h2><p>Text here.</p><span itemprop="programmingLanguage">Python</span>'
        '<a href="/{n}/stargazers">{s}</a><a href="/{n}/forks">678</a><span class="d-inline-block float-sm-right">1,234 stars today</span></article>'
    )
    html = card.format(n="acme/rocket", s="12,345") + card.format(n="octo/agent-kit", s="9.8k")
    got = repo_source.trending_rows(spark.createDataFrame([(1, html)], "page int, html string"), ["page"]).orderBy("rank").collect()
    assert [(r.owner, r.name, r.stars, r.forks, r.stars_today) for r in got] == [("acme", "rocket", 12345, 678, 1234), ("octo", "agent-kit", 9800, 678, 1234)]


def test_rank_change(spark):
    rows = spark.createDataFrame([(4, 1), (1, 4), (2, 2), (None, 3)], "p int, r int")
    assert [r[0] for r in rows.select(repositories.rank_change(F.col("p"), F.col("r"))).collect()] == ["↑3", "↓3", "—", "NEW"]


def test_launch_rules(spark):
    rows = spark.createDataFrame([("Nova Band 2", "Acme Nova Band 2 launched"), ("产品", "产品发布"), ("Ghost", "nothing")], "n string, e string")
    got = rows.select(gates.confirmed_launch(F.lit(True), F.col("n"), F.lit("Acme"), F.lit("Acme"), F.col("e"))).collect()
    assert [r[0] for r in got] == [True, False, False]


def test_undated_text_may_not_name_the_day(spark):
    got = column(spark, ["9月21日发布", "今日发布", "近期发布"], lambda v: dates.claims_known_day(v, F.lit(D(2026, 9, 21)), F.lit("recent_first_seen")))
    assert got == [True, True, False]


def test_versions_and_snapshots(spark, tmp_path):
    root = str(tmp_path / "state")
    assert tables.current_version(spark, root) is None
    tables.write_version(spark.range(3), root, 1)
    tables.write_version(spark.range(5), root, 2)
    assert tables.read_version(spark, root, "id long").count() == 5
    assert tables.read_version(spark, root, "id long", 1).count() == 3
    days = spark.createDataFrame([(D(2026, 1, d), d) for d in (1, 2, 3)], "snapshot_day date, rank int")
    assert tables.previous_snapshot(days, F.lit(D(2026, 1, 3))).first().rank == 2
    tables.write_snapshot(days, str(tmp_path / "snap"))
    assert spark.read.json(str(tmp_path / "snap")).count() == 3
    ratings = spark.createDataFrame([("a", 1.0, 2.0), ("b", 9.0, 1.0)], "publisher_key string, authority double, recognition double")
    tables.write_reputation(ratings, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().publisher_key == "b"


def test_cards_are_read_once_in_any_case(spark):
    card = '<ARTICLE class="x Box-row"><h2><a HREF="/Own&amp;er/{0}/"></a></h2><P>İ <b>two</b>&nbsp; words</P><a href="/o/{0}/stargazers"> 1.5K</a></article>'
    pages = [(1, card.format("a") + '<article class="Box-row">no name</article>' + card.format("b") + card.format("c")), (2, None), (3, '<article class="Box-row">')]
    got = repo_source.trending_rows(spark.createDataFrame(pages, "page int, html string"), ["page"], limit=2)
    rows = [(r["page"], r["rank"], r["owner"], r["name"], r["description"], r["language"], r["stars"], r["forks"]) for r in got.orderBy("rank").collect()]
    assert rows == [(1, 1, "Own&er", "a", "İ two words", "Unknown", 1500, 0), (1, 3, "Own&er", "b", "İ two words", "Unknown", 1500, 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "regexp_extract_all" not in plan
