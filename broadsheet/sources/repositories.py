"""Trending pages, repository metadata and daily snapshots."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions import text


def compact_count(value: Column) -> Column:
    """'9.8k' and '12,345' as whole numbers."""
    clean = F.lower(F.replace(F.trim(value), F.lit(","), F.lit("")))
    number = F.regexp_extract(clean, r"([\d.]+)\s*([km]?)", 1).try_cast("decimal(20,6)")
    unit = F.regexp_extract(clean, r"([\d.]+)\s*([km]?)", 2)
    times = F.when(unit == "k", F.lit(1000)).when(unit == "m", F.lit(1000000)).otherwise(F.lit(1))
    return F.coalesce(F.floor(number * times), F.lit(0)).cast("long")


#: Patterns over markup in lower case: its own letters are taken from the places they find.
_CARD = re.compile(r"""(?sa)<article\b[^>]*class\s*=\s*["'][^"']*\bbox-row\b[^"']*["'][^>]*>""")
_ANCHOR = re.compile(r"(?sa)<h2\b[^>]*>.*?(<a\b[^>]*>)")
_HREF = re.compile(r"""(?sa)\bhref\s*=\s*["']([^"']*)["']""")
_OUTER_SLASHES = re.compile(r"^/+|/+(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)")
#: Texts that are read from a card, tags and all.
_PARTS = {
    "description": re.compile(r"(?sa)<p\b[^>]*>(.*?)</p>"),
    "language": re.compile(r"""(?sa)<[a-z]+[^>]*itemprop\s*=\s*["']programminglanguage["'][^>]*>(.*?)</"""),
    "stars": re.compile(r"""(?sa)<a\b[^>]*href\s*=\s*["'][^"']*/stargazers["'][^>]*>(.*?)</a>"""),
    "forks": re.compile(r"""(?sa)<a\b[^>]*href\s*=\s*["'][^"']*/forks["'][^>]*>(.*?)</a>"""),
    "stars_today": re.compile(r"(?sa)<span\b[^>]*float-sm-right[^>]*>(.*?)</span>"),
}
_LOWER = {a: a + 32 for a in range(65, 91)}


def _cards(html: str, limit: int) -> Iterator[tuple]:
    """Place, owner, name and texts of the first ``limit`` cards that name a repository."""
    low = html.lower() if html.isascii() else html.translate(_LOWER)
    left, at = limit, 0

    def between(pattern: re.Pattern) -> str:
        found = pattern.search(low, opening.start(), end)
        return html[found.start(1) : found.end(1)] if found else ""

    for place in count():
        opening = _CARD.search(low, at) if left else None
        end = low.find("</article>", opening.end()) + 10 if opening else 9
        if end == 9:
            return
        at, anchor = end, _ANCHOR.search(low, opening.start(), end)
        href = _HREF.search(low, *anchor.span(1)) if anchor else None
        path = text.py_decode_entities(html[href.start(1) : href.end(1)]) if href else ""
        owner, *names = _OUTER_SLASHES.sub("", path).split("/")
        if owner and names:
            left -= 1
            yield place, owner, names[0], *(text.py_strip_tags(between(p)) for p in _PARTS.values())


def trending_rows(pages: DataFrame, keep: list[str], limit: int = 10) -> DataFrame:
    """Ranked repositories of trending pages (column html); each card is read once, in Arrow batches.

    Only rows before the limit-th readable card count, and the rank is the card's own position.
    """
    read = ["position", "owner", "name", *_PARTS]

    def run(batches):
        for batch in batches:
            found = [(row, *card) for row, html in enumerate(batch.column(len(keep)).to_pylist()) if html for card in _cards(html, limit)]
            rows, *columns = zip(*found, strict=True) if found else [()] * (len(read) + 1)
            kinds = [pa.int32()] + [pa.string()] * (len(read) - 1)
            kept = batch.select(keep).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*keep, *read])

    asked = pages.select(*keep, "html")
    kinds = [T.StructField("position", T.IntegerType())] + [T.StructField(c, T.StringType()) for c in read[1:]]
    found = asked.mapInArrow(run, T.StructType([*asked.schema.fields[:-1], *kinds]))
    return found.select(
        *keep,
        (F.col("position") + 1).alias("rank"), "owner", "name",
        F.concat(F.lit("https://github.com/"), "owner", F.lit("/"), "name").alias("url"),
        "description",
        F.when(F.col("language") != "", F.col("language")).otherwise(F.lit("Unknown")).alias("language"),
        *[compact_count(F.col(c)).alias(c) for c in ("stars", "forks", "stars_today")],
    )


def enrich(repos: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata by full_name: text and counts keep the old value when the new one is empty."""
    c = F.col
    joined = repos.join(metadata.select(
        "full_name", *[c(x).alias(f"m_{x}") for x in metadata.columns if x != "full_name"]
    ), "full_name", "left")
    known = c("m_known").isNotNull()
    text_or = lambda x: F.coalesce(F.nullif(c(f"m_{x}"), F.lit("")), c(x))
    count_or = lambda x: F.coalesce(F.nullif(c(f"m_{x}"), F.lit(0)), c(x))
    replaced = lambda x, empty: F.when(known, F.coalesce(c(f"m_{x}"), empty)).otherwise(c(x))
    return joined.select(
        *[x for x in repos.columns if x not in {"description", "language", "stars", "forks", "topics", "license", "homepage", "open_issues", "updated_at"}],
        text_or("description").alias("description"), text_or("language").alias("language"),
        count_or("stars").alias("stars"), count_or("forks").alias("forks"),
        replaced("topics", F.array().cast("array<string>")).alias("topics"),
        replaced("license", F.lit("")).alias("license"),
        replaced("homepage", F.lit("")).alias("homepage"),
        replaced("open_issues", F.lit(0)).alias("open_issues"),
        replaced("updated_at", F.lit("")).alias("updated_at"),
    )
