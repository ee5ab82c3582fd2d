"""Weighted keyword rules and interest profiles over items."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions import text

Scorer = Callable[[DataFrame], Column]
SUMMARY_WINDOW, PARAGRAPH_WINDOW = 500, 800
#: Marks that the hashes of a rule table's terms are told apart by; strings that a worker remembers the marks of.
MARKS, REMEMBERED = 1 << 16, 200_000


def windows(title: Column, summary: Column, body: Column) -> Column:
    """Places in which one rule must be satisfied as a whole: title, summary, both, each paragraph."""
    joined = F.concat(title, F.lit(" "), F.substring(summary, 1, SUMMARY_WINDOW))
    paragraphs = F.filter(F.split(body, r"[\n。！？!?]+"), lambda p: F.trim(p) != "")
    cut = F.transform(paragraphs, lambda p: F.substring(p, 1, PARAGRAPH_WINDOW))
    return F.concat(F.array(title, summary, joined), cut)


def _terms(group: list[str]) -> list[str]:
    return [t for t in dict.fromkeys(text.py_normalize(alias) for alias in group) if t]


_KEPT = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_GAPS, _IDEOGRAPH, _TOKENS = re.compile(r"[^a-z0-9一-鿿]+"), re.compile(r"[一-鿿]"), re.compile(r"[a-z0-9]+|[一-鿿]")


def _term(t: str) -> tuple[list[str], str, bool]:
    """Words of a normalised term, what is looked for, and whether that is a plain part of the text or padded words."""
    return t.split(), t if _IDEOGRAPH.search(t) else f" {t} ", bool(_IDEOGRAPH.search(t))


def _asked(rules: list[dict]) -> list[tuple[int, list]]:
    groups = [(i, [[_term(t) for t in _terms(g)] for g in rule["groups"]]) for i, rule in enumerate(rules)]
    return [(i, g) for i, g in groups if g and all(g)]


def _possible(raw: str, terms: list) -> bool:
    # words of a term have no gaps, so they stand in the lower-cased text as it is
    for words, _, _ in terms:
        for w in words:
            if w not in raw:
                break
        else:
            return True
    return False


def _normal(raw: str) -> tuple[str, str]:
    normal = _GAPS.sub(" ", raw).strip()
    return normal, f" {_IDEOGRAPH.sub(lambda m: f' {m[0]} ', normal)} "


def _named(normal: str, padded: str, terms: list) -> bool:
    return any(t in (normal if cjk else padded) for _, t, cjk in terms)


def _stands(raw: str, word: str) -> bool:
    """Whether a Latin word stands alone in a lower-cased place: no letter or digit that a normal text keeps is beside it."""
    at = raw.find(word)
    while at >= 0:
        end = at + len(word)
        if (at == 0 or raw[at - 1] not in _KEPT) and (end == len(raw) or raw[end] not in _KEPT):
            return True
        at = raw.find(word, at + 1)
    return False


def _near(raw: str, asked: list[tuple[int, list]]) -> list[tuple[int, list]]:
    out = []
    for rule in asked:
        for terms in rule[1]:
            if not _possible(raw, terms):
                break
        else:
            out.append(rule)
    return out


def _held(raw: str, asked: list[tuple[int, list]]) -> list[int]:
    """Numbers of the rules that hold in one lower-cased place, which is normalised only for terms of several words or ideographs."""
    held, normals = [], None
    for i, groups in _near(raw, asked):
        for terms in groups:
            if any(not cjk and len(words) == 1 and _stands(raw, words[0]) for words, _, cjk in terms):
                continue
            longer = [x for x in terms if x[2] or len(x[0]) > 1]
            if longer and normals is None:
                normals = _normal(raw)
            if not longer or not _named(*normals, longer):
                break
        else:
            held.append(i)
    return held


def _places(title: str | None, summary: str | None, body: str | None, parts: re.Pattern) -> list[str | None]:
    """The places of windows(); none without a body."""
    joined = None if title is None or summary is None else f"{title} {summary[:SUMMARY_WINDOW]}"
    return [] if body is None else [title, summary, joined, *(p[:PARAGRAPH_WINDOW] for p in parts.split(body))]


def _finder(rules: list[dict]) -> Callable[[str | None, str | None, str | None], list[int]]:
    """Numbers of the rules that hold within one of the places (see windows) of a title, summary and body."""
    asked, parts = _asked(rules), re.compile(r"[\n。！？!?]+")

    def found(title: str | None, summary: str | None, body: str | None) -> list[int]:
        if body is None:
            return []
        left = _near(" ".join(x for x in (title, summary, body) if x is not None).lower(), asked)
        out = []
        for place in _places(title, summary, body, parts) if left else ():
            held = _held(place.lower(), left) if place else []
            if held:
                out += held
                left = [x for x in left if x[0] not in held]
        return sorted(out)

    return found


def _strings(column: pd.Series) -> list[str | None]:
    return [x if isinstance(x, str) else None for x in column]


def match_rules(items: DataFrame, rules: list[dict]) -> DataFrame:
    """Add ``matches``: the rules an item satisfies, in rule order, as structs.

    Rules written by editors travel with the plan, so nothing is shuffled; each text is walked once in Arrow batches, and
    only places that hold the words of a rule are normalised. Rules that are a table are joined by match_rule_table.
    """
    found = _finder(rules)

    @F.arrow_udf("array<int>")
    def numbers(title: pa.Array, summary: pa.Array, body: pa.Array) -> pa.Array:
        return pa.array([found(*row) for row in zip(*(c.to_pylist() for c in (title, summary, body)), strict=True)], pa.list_(pa.int32()))

    told = [
        F.struct(
            F.lit(rule["id"]).alias("id"),
            F.lit(rule["weight"]).alias("weight"),
            F.lit(bool(rule.get("exploration", False))).alias("exploration"),
            F.lit(rule["groups"][0][0] if rule["groups"] and rule["groups"][0] else "").alias("tag"),
        )
        for rule in rules
    ]
    if not told:
        return items.withColumn("matches", F.array().cast("array<struct<id:string,weight:int,exploration:boolean,tag:string>>"))
    matches = F.transform(F.col("_numbers"), lambda i: F.get(F.array(*told), i))
    # A generated column: later filters on the matches are not copied below and evaluated a second time.
    return items.withColumn("_numbers", numbers("title", "summary", "body")).withColumn("matches", F.explode(F.array(matches))).drop("_numbers")


class _Marked(dict):
    """Whether the hash of a string is that of one of some strings; a lookup, once the string has been met."""

    def __init__(self, marks: set[int]):
        super().__init__()
        self.marks = marks

    def __missing__(self, value: str) -> bool:
        if len(self) > REMEMBERED:
            self.clear()
        self[value] = out = crc32(value.encode()) % MARKS in self.marks
        return out


def _offered(raw: str, words: list[int], characters: list[int], starts: _Marked, known: _Marked) -> set[str]:
    """Word n-grams without and substrings with ideographs of a lower-cased place, of the lengths asked for, that may be terms."""
    tokens = _TOKENS.findall(raw)
    out = set()
    for i in [i for i, t in enumerate(tokens) if starts[t]] if words else ():
        grams = (" ".join(tokens[i : i + n]) for n in words if i + n <= len(tokens))
        out.update(g for g in grams if known[g] and not _IDEOGRAPH.search(g))
    if characters and _IDEOGRAPH.search(raw):
        normal, _ = _normal(raw)
        pieces = (normal[i : i + n] for n in characters for i in range(len(normal) - n + 1))
        out.update(g for g in pieces if known[g] and _IDEOGRAPH.search(g))
    return out


def paragraph_matches(body: Column, rules: list[dict], always: int, own: Column | None = None) -> Column:
    """Lines of a body: the first ``always`` ones, later ones only when a rule, of the ``own`` ids if given, holds within the line."""

    asked = _asked(rules)
    ids, every = [rule["id"] for rule in rules], own is None

    @F.pandas_udf("array<string>")
    def kept(bodies: pd.Series, owned: pd.Series) -> pd.Series:
        out = []
        for body, own_ids in zip(_strings(bodies), owned, strict=True):
            mine = set(() if own_ids is None else own_ids)
            left = [x for x in asked if every or ids[x[0]] in mine]
            lines = None if body is None else body.split("\n")
            out.append(lines and [x for i, x in enumerate(lines) if i < always or left and _held(x[:PARAGRAPH_WINDOW].lower(), left)])
        return pd.Series(out, dtype="object")

    return kept(body, F.array().cast("array<string>") if own is None else own)


def with_channel_scores(items: DataFrame, scorers: dict[str, "Scorer"], default: "Scorer") -> DataFrame:
    """Add ``channel_score`` from the scorer registered for each item's channel (a function of the columns)."""
    score = default(items)
    for channel, scorer in scorers.items():
        score = F.when(F.col("channel_id") == channel, scorer(items)).otherwise(score)
    return items.withColumn("channel_score", score)


def match_rule_table(items: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, rule_id) pairs for a rule table of any size, by equality on terms.

    rules: id, groups array<array<string>>. Latin terms join on word n-grams, terms with ideographs on substrings, of
    the lengths that the table's terms have; a rule holds when one place covers all of its groups. Texts are walked once
    in Arrow batches, and only pieces that by their hash may be terms leave the walk.
    """
    groups = rules.select(F.col("id").alias("rule_id"), F.posexplode("groups").alias("group_no", "aliases"), F.size("groups").alias("n_groups"))
    terms = (
        groups.select("rule_id", "group_no", "n_groups", F.explode("aliases").alias("alias"))
        .select("rule_id", "group_no", "n_groups", text.normalize(F.col("alias")).alias("term"))
        .filter("term != ''")
        .distinct()
    )
    ideographs = text.has_ideograph(F.col("term"))
    sized = F.when(ideographs, F.length("term")).otherwise(F.size(F.split("term", " ")))
    # bounded for a table of any size: the lengths of terms, and the marks of terms and of their first words
    lengths = terms.select(ideographs.alias("cjk"), sized.alias("n")).distinct().collect()
    words, characters = (sorted(r["n"] for r in lengths if r["cjk"] == cjk) for cjk in (False, True))
    whole, first = ({r[0] for r in terms.select((F.crc32(x) % MARKS).cast("int")).distinct().collect()} for x in (F.col("term"), F.split("term", " ")[0]))
    parts = re.compile(r"[\n。！？!?]+")

    def offers(batches):
        starts, known = _Marked(first), _Marked(whole)
        for batch in batches:
            rows, numbers, pieces = [], [], []
            for row, (title, summary, body) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                for number, place in enumerate(_places(title, summary, body, parts)):
                    offered = _offered(place.lower(), words, characters, starts, known) if place else ()
                    rows += [row] * len(offered)
                    numbers += [number] * len(offered)
                    pieces += offered
            kept = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, pa.array(numbers, pa.int32()), pa.array(pieces, pa.string())], [key, "place", "term"])

    texts = items.select(key, "title", "summary", "body")
    schema = T.StructType([texts.schema[0], T.StructField("place", T.IntegerType()), T.StructField("term", T.StringType())])
    offered = texts.mapInArrow(offers, schema).filter("term != ''")
    hits = offered.join(terms, "term").select(key, "place", "rule_id", "group_no", "n_groups")
    whole = hits.groupBy(key, "place", "rule_id", "n_groups").agg(F.count_distinct("group_no").alias("covered"))
    return whole.filter("covered = n_groups").select(key, "rule_id").distinct()


def excluded_by(normal: Column, terms: list[str]) -> Column:
    spaced = text.padded(normal)
    return text.any_term(normal, spaced, _terms(terms))


def top_tags(matches: Column) -> Column:
    """Up to three lead terms, heaviest rule first, rule order within a weight."""
    ranked = F.array_sort(
        F.transform(matches, lambda m, i: F.struct((-m["weight"]).alias("w"), i.alias("i"), m["tag"].alias("tag")))
    )
    return F.slice(F.array_distinct(F.transform(ranked, lambda r: r["tag"])), 1, 3)


def top_weight(matches: Column) -> Column:
    return F.array_max(F.transform(matches, lambda m: m["weight"]))


def score_against(profiles: list[dict], places: list[tuple[Column, int]]) -> Column:
    """Array with one struct per profile: id, points before capping, matched and excluded terms.

    places: texts and the points of the first one that names an interest; excluded terms may stand anywhere in them.
    """
    points = [n for _, n in places]
    interests = {i: [_term(t) for t in text.interest_terms(i)] for p in profiles for i in p["interests"]}
    words = {w: [_term(t) for t in (text.py_normalize(w),) if t] for p in profiles for w in p["exclude"]}

    def value(row: tuple[str | None, ...]) -> list[int]:
        raws = [None if x is None else x.lower() for x in row]
        normals: dict[int, tuple[str, str]] = {}

        def names(k: int, terms: list) -> bool:
            if not raws[k] or not _possible(raws[k], terms):
                return False
            if k not in normals:
                normals[k] = _normal(raws[k])
            return _named(*normals[k], terms)

        out = [next((points[k] for k in range(len(raws)) if names(k, terms)), 0) for terms in interests.values()]
        whole = " ".join(x for x in raws if x is not None)
        barred = [_possible(whole, terms) for terms in words.values()]
        if any(barred):
            everything = " ".join(_normal(x)[0] for x in raws if x is not None)
            padded = f" {_IDEOGRAPH.sub(lambda m: f' {m[0]} ', everything)} "
            barred = [b and _named(everything, padded, terms) for b, terms in zip(barred, words.values(), strict=True)]
        return out + [int(b) for b in barred]

    @F.pandas_udf("array<int>")
    def values(*columns: pd.Series) -> pd.Series:
        return pd.Series([value(row) for row in zip(*map(_strings, columns), strict=True)], dtype="object")

    order = {key: k for k, key in enumerate([*(("i", i) for i in interests), *(("w", w) for w in words)])}

    def one(found: Column, profile: dict) -> Column:
        own = [(i, found[order["i", i]]) for i in dict.fromkeys(profile["interests"])]
        present = lambda pairs: F.filter(F.array(*[F.when(p > 0, F.lit(x)) for x, p in pairs]), lambda v: v.isNotNull()) if pairs else F.array().cast("array<string>")
        return F.struct(
            F.lit(profile["profile_id"]).alias("profile_id"),
            reduce(lambda a, b: a + b, [p for _, p in own], F.lit(0)).alias("points"),
            present(own).alias("matched"),
            present([(w, found[order["w", w]]) for w in profile["exclude"]]).alias("excluded"),
        )

    return text.given(values(*[c for c, _ in places]), lambda found: F.array(*[one(found, p) for p in profiles]))


def score_interests(items: DataFrame, profiles: list[dict]) -> DataFrame:
    """One row per item and profile that does not exclude it, with ``rule_score`` and ``matched_keywords``.

    Profiles are carried in the plan, so every item is read and normalised once, however many they are.
    """
    places = [(F.col("title"), 30), (F.array_join("tags", " "), 20), (F.concat_ws(" ", "summary", "content"), 10)]
    prepared = items.withColumn("_scores", score_against(profiles, places))
    scored = prepared.withColumn("p", F.explode("_scores"))
    return (
        scored.filter(F.size("p.excluded") == 0)
        .withColumn("profile_id", F.col("p.profile_id"))
        .withColumn("matched_keywords", F.col("p.matched"))
        .withColumn("rule_score", F.least(F.lit(100), F.col("p.points")))
        .drop("p", "_scores")
    )
