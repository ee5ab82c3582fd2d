"""Rule lists and interest profiles over odd texts."""

from pyspark.sql import functions as F

from broadsheet.operators import matching
from broadsheet.plans import dimensions as dim

ODD = [
    (1, None, "the attion", "the attion"), (2, "the", "attion", ""), (3, "x", "y", None), (4, "THE. Attion", "", "a" * 795 + " the retion. password!"),
    (5, "眼镜of the新", "s", "that\tthe 的of the"), (6, None, None, "the attion"), (7, "İn with for", "K", "tokenK"), (8, "of", "the", ""),
    (9, "of", "the" + " " * 600 + "x", "of. the\nof  - the"),
]


def test_rules_of_a_long_list_on_odd_texts(spark):
    more = [{"id": "c", "weight": 1, "groups": [["眼镜", "新 的"], ["of the"]]}, {"id": "e", "weight": 2, "groups": [["!"]]}, {"id": "n", "weight": 2, "groups": []}, {"id": "k", "weight": 2, "groups": [["tokenk", "in"]]}]
    many = [{"id": f"x{i}", "weight": 1, "groups": [[f"word{i}", f"two words{i}"], ["other"]]} for i in range(2000)]
    items = spark.createDataFrame(ODD, "doc_id long, title string, summary string, body string")
    found = matching.match_rules(items, [*dim.RULES, *more, *many]).orderBy("doc_id").select("doc_id", F.col("matches.id").alias("ids"))
    assert [tuple(r) for r in found.collect()] == [
        (1, ["r02"]), (2, ["r02"]), (3, []), (4, ["r02"]), (5, ["r07", "c"]), (6, ["r02"]), (7, ["k"]), (8, ["r07"]), (9, ["r07"]),
    ]
    assert [r["matches"] for r in matching.match_rules(items.limit(1), []).collect()] == [[]]


def test_a_rule_table_offers_only_pieces_that_may_be_terms(spark):
    more = [{"id": "c", "groups": [["眼镜", "新 的"], ["of the"]]}, {"id": "m", "groups": [["的of"]]}, {"id": "k", "groups": [["tokenk", "in"]]}]
    rules = [(r["id"], r["groups"]) for r in [*dim.RULES, *more]]
    items = spark.createDataFrame(ODD, "doc_id long, title string, summary string, body string")
    found = matching.match_rule_table(items, "doc_id", spark.createDataFrame(rules, "id string, groups array<array<string>>"))
    listed = matching.match_rules(items, [{"weight": 1, **r} for r in [*dim.RULES, *more]]).select("doc_id", F.explode("matches.id").alias("rule_id"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, listed.collect()))
    marks = matching._Marked({matching.crc32(b"of the") % matching.MARKS}), matching._Marked({matching.crc32(b"of") % matching.MARKS})
    assert matching._offered("one of the many", [1, 2], [], marks[1], marks[0]) == {"of the"}


def test_interests_and_lines_on_odd_texts(spark):
    rows = [(1, "that  THE x", ["s"], "", "", "one\nthe attion\n\n眼镜 of the\n"), (2, None, ["of"], "pass", "word of", None), (3, "a", ["lic"], "ense", "İN", "x"), (4, "spam", ["mail"], None, "in", "眼镜")]
    items = spark.createDataFrame(rows, "doc_id long, title string, tags array<string>, summary string, content string, body string")
    profiles = [{"profile_id": "p", "interests": ["that the", "of", "眼镜", "of"], "exclude": []}, {"profile_id": "q", "interests": ["in"], "exclude": ["spam mail", "pass word", ""]}]
    scored = matching.score_interests(items, profiles)
    got = {(r["profile_id"], r["doc_id"]): (r["rule_score"], r["matched_keywords"]) for r in scored.collect()}
    assert got == {("p", 1): (30, ["that the"]), ("p", 2): (20, ["of"]), ("p", 3): (0, []), ("p", 4): (0, []), ("q", 1): (0, []), ("q", 3): (0, [])}
    # each text is walked once, however many interests there are
    assert "regexp_replace" not in scored._jdf.queryExecution().optimizedPlan().toString()
    lines = items.withColumn("own", F.expr("IF(doc_id = 4, null, array('a'))")).select("doc_id", matching.paragraph_matches(F.col("body"), [{"id": "a", "groups": [["眼镜"], ["of the"]]}, {"id": "b", "groups": [["attion"]]}], 1, F.col("own")).alias("x"))
    assert "regexp_replace" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: r["x"] for r in lines.collect()} == {1: ["one", "眼镜 of the"], 2: None, 3: ["x"], 4: ["眼镜"]}


def test_single_words_are_found_without_normalising(monkeypatch):
    rules = [{"groups": [["with"], ["for", "two words"], ["in"]]}, {"groups": [["für"]]}, {"groups": [["of the"]]}, {"groups": [["眼镜"]]}]
    asked = matching._asked(rules)
    for place, held in (("inside with for, in", [0]), ("with-for_in", [0]), ("within for win", []), ("éwith中for 9in", []), ("two. words with in中", [0]), ("f r", [1]), ("für", [1]), ("of - the", [2]), ("a眼镜", [3])):
        assert matching._held(place, asked) == held, place
    monkeypatch.setattr(matching, "_normal", None)
    assert matching._held("inside with for, in 9", asked[:1]) == [0]
