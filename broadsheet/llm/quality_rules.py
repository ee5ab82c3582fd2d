"""Quality rules with thresholds learnt from the corpus, in DataFrame functions only.

Each text is measured once. One rolled-up aggregation makes, per language and source, per language and over all rows, a
mergeable quantile sketch of every measure (percentile_approx, a Greenwald-Khanna summary that partial aggregates merge,
so a hot group is summarised before the shuffle). A level's limit is read from its sketch: of the quantiles above the
median, the cut that separates them best (largest variance between the two sides), if the sides' means lie more than
`reach` deviations of the near side apart, so that there are two kinds of texts and not one long tail; otherwise the upper
quartile and `reach` interquartile ranges; a measure that does not vary at all says nothing. No limit is a constant.

A group's limit is drawn towards its language's, and that towards the corpus's, by row count (`enough` rows weigh as much
as the wider level), so small groups borrow and large ones decide: a source with other habits gets other limits. A source
that is junk for the most part is judged by its own habits too, but for the fixed floor. `events` occurrences never fail a
text, however short it is. Limits are joined back by language and source. The fixed floor (too few words, too much
repetition) fails whatever the group.

Defined cases: a null or empty text has no words and fails; null language or source is a group of its own; a very long
text is measured whole inside its row; repeated rows are judged each; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.session import cut

SPACE = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"
WINDOW = 8


#: The sketch is read at i / GRID for i from 1 to GRID.
GRID = 200


@dataclass(frozen=True)
class Measure:
    """`count`: the occurrences behind the value, if it counts any; `low`: too little fails as well."""

    name: str
    value: Column
    count: str | None = None
    low: bool = False


def measures() -> list[Measure]:
    """Shares of counts are taken by their square roots, whose spread does not grow with the share."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        Measure("symbol_level", F.sqrt(F.col("n_symbols") / words), "n_symbols"),
        Measure("dup_line_level", F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), "n_dup_lines"),
        Measure("repeat_level", F.sqrt(F.col("n_repeat_words") / words), "n_repeat_words"),
        Measure("word_length", F.col("word_chars") / words, low=True),
    ]


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the counts of each text. Every step works inside the row; nothing is shuffled."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(NO_SPACE))
    rows = rows.withColumns({"words": F.filter(F.split("text", SPACE), lambda w: w != ""), "lines": lines})
    rows = rows.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            # code points without white space, by taking the words together
            "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "windows": F.when(
                F.size("words") >= WINDOW,
                F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    ).drop("text", "words", "lines")
    # only texts with a window that comes again pay for finding where
    numbered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = rows.withColumn("numbered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), numbered))
    last = F.size("numbered") - 1
    repeated = F.filter(
        "numbered",
        lambda x, k: ((k > 0) & (x["h"] == F.get("numbered", k - 1)["h"])) | ((k < last) & (x["h"] == F.get("numbered", k + 1)["h"])),
    )
    places = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    return again.withColumn("n_repeat_words", F.when(F.col("numbered").isNull(), F.lit(0)).otherwise(covered).cast("long")).drop("windows", "numbered")


def split(values: Column, reach: float) -> Column:
    """The cut of an ascending array that separates its two sides best; null if they are not `reach` deviations apart."""
    size = F.size(values)

    def moments(part: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
        return F.aggregate(part, zero, lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))

    def cut_at(k: Column) -> Column:
        near, far = moments(F.slice(values, 1, k)), moments(F.slice(values, k + 1, size - k))
        mean, apart = near["s"] / near["n"], far["s"] / far["n"] - near["s"] / near["n"]
        spread = F.sqrt(F.greatest(near["q"] / near["n"] - mean * mean, F.lit(0.0)))
        return F.struct(
            (near["n"] * far["n"] * apart * apart).alias("between"),
            ((F.get(values, k - 1) + F.get(values, k)) / 2).alias("at"),
            (apart > spread * reach).alias("clear"),
        )

    places = F.filter(F.sequence(F.lit(1), size - 1), lambda k: F.get(values, k - 1) < F.get(values, k))
    best = F.array_max(F.transform(places, cut_at))
    return F.when(best["clear"], best["at"])


def level_limits(measured: DataFrame, reach: float, accuracy: int) -> DataFrame:
    """lang, source, level (0 group, 1 language, 3 corpus), n, and each measure's own limits <measure>_high and <measure>_low."""
    points = F.array(*[F.lit(i / GRID) for i in range(1, GRID + 1)])
    sketches = measured.rollup("lang", "source").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), *[F.percentile_approx(m.value, points, F.lit(accuracy)).alias(m.name) for m in measures()]
    )
    half, quarter = GRID // 2, GRID // 4
    bounds = []
    for m in measures():
        q = F.col(m.name)
        q1, q3 = F.get(q, F.lit(quarter - 1)), F.get(q, F.lit(3 * quarter - 1))
        slack = F.when(q3 > q1, (q3 - q1) * reach)
        bounds.append(F.coalesce(split(F.slice(q, half, GRID - half + 1), reach), q3 + slack).alias(f"{m.name}_high"))
        if m.low:
            mirrored = F.transform(F.reverse(F.slice(q, 1, half)), lambda x: -x)
            bounds.append(F.coalesce(-split(mirrored, reach), q1 - slack).alias(f"{m.name}_low"))
    return sketches.select("lang", "source", "level", "n", *bounds)


def thresholds(measured: DataFrame, reach: float = 8.0, accuracy: int = 1000, enough: int = 20) -> DataFrame:
    """Per language and source: the highest and, where that counts, the lowest allowed value of each measure; null: none."""
    levels = cut(level_limits(measured, reach, accuracy))
    group, lang = levels.filter("level = 0").alias("g"), levels.filter("level = 1").alias("l")
    every = levels.filter("level = 3").first()  # one row
    joined = group.join(lang, F.col("g.lang").eqNullSafe(F.col("l.lang")))

    def drawn(level: str, name: str, wider: Column) -> Column:
        own, n = F.col(f"{level}.{name}"), F.col(f"{level}.n")
        return F.coalesce((own * n + wider * enough) / (n + enough), F.when(n >= enough, own), wider)

    bounds = []
    for m in measures():
        for name in (f"{m.name}_high", f"{m.name}_low") if m.low else (f"{m.name}_high",):
            corpus = F.lit(every[name] if every else None).cast("double")
            bounds.append(drawn("g", name, drawn("l", name, corpus)).alias(name))
    return joined.select(F.col("g.lang").alias("t_lang"), F.col("g.source").alias("t_source"), *bounds)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 20, max_repeat_pct: int = 30, reach: float = 8.0, events: int = 2) -> DataFrame:
    """The counts of every text, base_failed, the measures it failed, and kept."""
    measured = cut(text_measures(docs, id_col, text_col, lang_col, source_col))
    bounds = thresholds(measured, reach)
    joined = measured.join(bounds, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    failed = []
    for m in measures():
        beyond = m.value > F.col(f"{m.name}_high")
        if m.count:
            beyond = beyond & (F.col(m.count) > events)
        if m.low:
            beyond = beyond | (m.value < F.col(f"{m.name}_low"))
        failed.append(F.when(beyond, F.lit(m.name)))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    out = joined.withColumns({"base_failed": base, "failed_measures": F.array_compact(F.array(*failed))})
    return out.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "failed_measures", (~F.col("base_failed") & (F.size("failed_measures") == 0)).alias("kept"),
    )
