"""How far the sources of a language differ in their words.

Terms are runs of ASCII letters and of bytes above 127, only A-Z lower-cased. Each task cuts its documents into shards of
about `shard_bytes` and works on the Arrow buffers themselves: a pointer to every word start, one language at a time, is
sorted by multikey quicksort, eight bytes (a slice) at a time, with a three-way partition around a pivot slice while a
part is large; members equal to the pivot go on with the next slice. The sort is stable, so inside an equal run the
pointers follow the documents, and a run gives the term's document frequency (changes of document) and its count in each
source. Only one row for each term, language and shard is shuffled, by (lang, term): no key has more rows than there are
shards.

A language keeps the terms found in at least `min_docs` of its rows. Each group (lang, source) and each language gives a
kept term the probability 1 + floor(scale * (count + smooth) / (N + smooth * V)), in whole numbers. Sources are compared
in blocks of terms (by hash, about `block_terms` each) and of sources (about 256): a task fills one dense matrix of bounded
size and returns sums for its pairs of sources, so the sum over all terms is exact, absent terms included.

Defined cases: null text, lang or source is the empty text; a group without terms is a group like others; with no kept
term all distances are 0; every row is a document, repeated rows and ids included; no rows give no rows; other columns are
ignored. A text longer than a shard is a shard of its own, and is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm._common import map_arrow
from broadsheet.session import cut

#: Parts up to this many pointers are sorted at once instead of being partitioned further.
SMALL = 1 << 15
SOURCE_BLOCK = 256

_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
LOWER = np.where(_UPPER, _CODES + 32, _CODES).astype(np.uint8)
IN_WORD = _UPPER | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)


def word_pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of every word in a buffer of texts; a text's border ends a word."""
    inside = IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    start = np.flatnonzero(first)
    length = np.flatnonzero(last) - start + 1
    return start, length, np.searchsorted(offsets, start, side="right") - 1


def _slices(words: np.ndarray, start: np.ndarray, length: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes of each word from `depth` on, as big-endian numbers; past the end of the word they are 0."""
    key = words[np.minimum(start + depth, len(words) - 1)].astype(np.uint64)
    left = np.clip(8 - (length - depth), 0, 8).astype(np.uint64) * np.uint64(8)
    return np.where(left >= 64, np.uint64(0), (key >> np.minimum(left, 63)) << np.minimum(left, 63))


def sorted_runs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by their words, stable, and where each run of equal words begins.

    `data` has at least 8 bytes after the last word."""
    words = np.ndarray((len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))
    order = np.arange(len(start))
    new_run = np.zeros(len(start), dtype=bool)
    parts = [(0, len(start), 0, _slices(words, start, length, 0))]
    while parts:
        lo, hi, depth, key = parts.pop()
        if lo == hi:
            continue
        new_run[lo] = True
        if hi - lo <= SMALL:
            _sort_small(words, start, length, order, new_run, lo, hi, depth, key)
            continue
        own = order[lo:hi]
        pivot = np.sort(key[:: max(1, (hi - lo) // 31)])[16 if hi - lo >= 31 else 0]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        n_less, n_same = int(less.sum()), int(same.sum())
        order[lo:hi] = np.concatenate([own[less], own[same], own[more]])
        a, b = lo + n_less, lo + n_less + n_same
        parts.append((lo, a, depth, key[less]))
        parts.append((b, hi, depth, key[more]))
        if int(pivot) & 0xFF:  # the words may go on
            middle = order[a:b]
            parts.append((a, b, depth + 8, _slices(words, start[middle], length[middle], depth + 8)))
        else:
            new_run[a] = True
    return order, np.flatnonzero(new_run)


def _sort_small(words, start, length, order, new_run, lo: int, hi: int, depth: int, key: np.ndarray) -> None:
    """Sorts a part slice by slice; only members of runs that may go on are looked at again."""
    at, run = np.arange(lo, hi), np.zeros(hi - lo, dtype=np.int64)
    while len(at):
        by = np.lexsort((key, run))
        order[at] = order[at][by]
        run, key = run[by], key[by]
        step = np.ones(len(at), dtype=bool)
        step[1:] = (run[1:] != run[:-1]) | (key[1:] != key[:-1])
        new_run[at[step]] = True
        run = np.cumsum(step)
        more = (np.bincount(run)[run] > 1) & ((key & np.uint64(0xFF)) != 0)
        at, run, depth = at[more], run[more], depth + 8
        key = _slices(words, start[order[at]], length[order[at]], depth)


def _pieces(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The words at the pointers as an Arrow text column."""
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    place = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[place]))])


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], dtype=np.int32, count=texts.offset + len(texts) + 1)[texts.offset :].astype(np.int64)


def shard_rows(texts: pa.Array, langs: list[str], sources: list[str]) -> Iterator[pa.RecordBatch]:
    """lang, term, df and (source, n) pairs of one shard."""
    offsets = _offsets(texts)
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = np.zeros(len(raw) + 16, dtype=np.uint8)
    data[: len(raw)] = LOWER[raw]
    start, length, doc = word_pointers(data[: len(raw)], offsets)
    lang_names, lang_of = np.unique(np.array(langs, dtype=object), return_inverse=True)
    source_names, source_of = np.unique(np.array(sources, dtype=object), return_inverse=True)
    for k, lang in enumerate(lang_names):
        own = np.flatnonzero(lang_of[doc] == k) if len(lang_names) > 1 else np.arange(len(doc))
        if not len(own):
            continue
        order, begins = sorted_runs(data, start[own], length[own])
        order = own[order]
        docs = doc[order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = docs[1:] != docs[:-1]
        fresh[begins] = True
        df = np.add.reduceat(fresh.astype(np.int64), begins)
        run = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
        cell, n = np.unique(run * len(source_names) + source_of[docs], return_counts=True)
        cell_run, cell_source = np.divmod(cell, len(source_names))
        first = order[begins]
        terms = _pieces(data, start[first], length[first])
        per_run = np.concatenate([[0], np.cumsum(np.bincount(cell_run, minlength=len(begins)))]).astype(np.int32)
        named = pa.array(source_names.tolist(), pa.string()).take(pa.array(cell_source, pa.int64()))
        counts = pa.StructArray.from_arrays([named, pa.array(n, pa.int64())], ["source", "n"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(begins), pa.string()), terms, pa.array(df, pa.int64()), pa.ListArray.from_arrays(pa.array(per_run), counts)],
            ["lang", "term", "df", "counts"],
        )


def term_counts(docs: DataFrame, min_docs: int = 30, shard_bytes: int = 32 << 20) -> DataFrame:
    """lang, source, term, n (occurrences, above 0) of the kept terms."""

    def run(batches):
        held, size = [], 0

        def flush():
            lang, source, text = (pa.concat_arrays([b.column(k) for b in held]) for k in range(3))
            for out in shard_rows(text, lang.to_pylist(), source.to_pylist()):
                for at in range(0, out.num_rows, 50_000):
                    yield out.slice(at, 50_000)

        for batch in batches:
            ends, at = _offsets(batch.column(2)), 0
            while at < len(batch):
                # as many rows as fill the shard, one at least
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + shard_bytes - size, side="right")) - 1)
                held.append(batch.slice(at, upto - at))
                size += int(ends[upto] - ends[at])
                at = upto
                if size >= shard_bytes or at < len(batch):
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    rows = map_arrow(docs.select("lang", "source", "text"), run, "lang string, term string, df long, counts array<struct<source:string,n:long>>")
    total = F.sum("df").over(Window.partitionBy("lang", "term"))
    kept = rows.withColumn("docs", total).filter(F.col("docs") >= min_docs).select("lang", "term", F.explode("counts").alias("c"))
    # still laid out by (lang, term), so this aggregate needs no further exchange
    return kept.groupBy("lang", "term", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))


def probability(count: Column, total: Column, terms: Column, smooth: int = 5, scale: int = 1_000_000_000) -> Column:
    """1 + floor(scale * (count + smooth) / (total + smooth * terms)) without rounding; 0 where there are no terms."""
    wide = "decimal(20,0)"
    above = F.lit(scale).cast("decimal(10,0)") * (count + smooth).cast(wide)
    below = (total + terms * smooth).cast(wide)
    exact = F.call_function("div", above, below)
    return F.when(terms > 0, exact + 1).otherwise(F.lit(0).cast("long"))


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of absolute differences for the pairs of sources of one block of terms."""
    base = rows[rows["term"].isna()].sort_values("source")
    names, blocks, first = base["source"].to_numpy(), base["block"].to_numpy(), int(rows["left_block"].iloc[0])
    cells = rows[rows["term"].notna()]
    code, terms = pd.factorize(cells["term"])
    p = np.repeat(base["p"].to_numpy(np.int64)[:, None], max(len(terms), 1), axis=1)
    # what the block's terms do not reach is no cell, so an empty block adds nothing
    p = p[:, : len(terms)]
    p[pd.Index(names).get_indexer(cells["source"]), code] = cells["p"].to_numpy(np.int64)
    within = first == int(rows["right_block"].iloc[0])
    out_a, out_b, value = [], [], []
    for i in np.flatnonzero(blocks == first):
        other = np.arange(i + 1, len(names)) if within else np.flatnonzero(blocks != first)
        if len(other):
            out_a += [names[i]] * len(other)
            out_b += names[other].tolist()
            value += np.abs(p[other] - p[i]).sum(1).tolist()
    texts = [np.array(x, dtype=object) for x in ([rows["lang"].iloc[0]] * len(value), out_a, out_b)]
    return pd.DataFrame(dict(zip("lang a b value".split(), [*texts, np.array(value, np.int64)], strict=True)))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, smooth: int = 5, block_terms: int = 256, shard_bytes: int = 32 << 20) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = cut(term_counts(given, min_docs, shard_bytes))
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    by_lang = by_term.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = given.select("lang", "source").distinct()
    many = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCE_BLOCK).alias("source_blocks")).join(by_lang, "lang", "left")
    totals = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(many, "lang")
    totals = cut(totals.fillna(0, ["total", "v", "lang_total"]))

    p = probability(F.col("n"), F.col("total"), F.col("v"), smooth)
    cells = counts.join(totals, ["lang", "source"])

    # pairs: every source's floor in every block of terms, and the cells that lie above it
    term_blocks = F.greatest(F.ceil(F.col("v") / block_terms), F.lit(1))
    floors = totals.withColumn("n", F.lit(0).cast("long")).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), term_blocks - 1))).withColumn("term", F.lit(None).cast("string"))
    columns = ["lang", "source", "term", "bucket", "source_blocks", p.alias("p")]
    both = floors.select(*columns).unionByName(cells.withColumn("bucket", F.pmod(F.xxhash64("term"), term_blocks)).select(*columns))
    both = both.withColumn("block", F.pmod(F.xxhash64("source"), F.col("source_blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("source_blocks") - 1)))
    both = both.select("lang", "source", "term", "bucket", "p", "block", F.least("block", "other").alias("left_block"), F.greatest("block", "other").alias("right_block"))
    sums = both.groupBy("lang", "bucket", "left_block", "right_block").applyInPandas(_compare, "lang string, a string, b string, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "x.source", "x.item", "value").withColumn("rank", place)

    q = probability(F.col("lang_n"), F.col("lang_total"), F.col("v"), smooth)
    terms = cells.join(by_term, ["lang", "term"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
    terms = terms.withColumn("rank", place).filter(F.col("rank") <= top)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
