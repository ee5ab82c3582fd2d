"""Near-duplicate documents from bottom-k sketches.

A document's set is its distinct word shingles, each hashed by one 64-bit function; its sketch is the k smallest hashes.
Documents with equal sets form a class first; only class heads go on. Inverted lists of retained values propose pairs:
values are ranked by how many sketches retain them, and a head is entered under its rarest ones only, so many that two
sketches with the required overlap must share one (pigeonhole), however common the other values are. Every set also has
a parity map of 512 bits, in which each value turns one bit over: two maps differ in at most as many bits as the sets in
values, so a pair whose maps differ in more bits than the threshold allows is ruled out for certain. Sets too large for
the maps are ruled out by the sketch of the union, which estimates the similarity. The full sets decide.

A list of near copies would propose all pairs in it, and components need far fewer. So in the first rounds each member of
a list meets only the list's leader (drawn by hash, so leaders differ from list to list), each head verifies its best
proposal, and confirmed links merge components. After that, members of different components that still share a list meet
directly, in a join that lets only pairs through whose parity maps allow the threshold, each once, in the list of the least
value they share; pairs inside one component are never formed. Only ids, sizes and maps travel to candidates; the two
texts of a surviving pair are fetched once and their full sets compared on the spot. Texts of no pair are not shuffled: a
bitmap of the pairs' ids, of bounded size, goes to the texts. No list, set of links or component is ever gathered in one place.

With more than k shingles the required overlap is a bound that a pair at the threshold misses with a probability below
one in a million; smaller sets are compared without loss.

Defined cases: a null or empty text, or one of white space, has the empty set and is linked with nothing; of rows with the
same id the one with most shingles stands for the document (ties: by the set's fingerprint); rows without an id are left
out; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm._common import among, map_arrow, type_of
from broadsheet.llm._graph import components
from broadsheet.session import cut

K = 32
PARITY_BITS = 512
REMEMBERED = 500_000


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text; words are lower-cased in A-Z and split at ASCII white space."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not tokens:
            return np.empty(0, dtype=np.int64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        hashes = []
        for w in tokens:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            hashes.append(h)
        h = np.array(hashes, dtype=np.uint64)
        size = min(self.words, len(h))
        mixed = np.full(len(h) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            mixed = (mixed ^ h[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed.view(np.int64))


def _mark(values: np.ndarray) -> bytes:
    """Fingerprint of a set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _parity(values: np.ndarray) -> np.ndarray:
    """Bits that an odd number of a set's values fall on, as longs."""
    odd = np.bincount(values & (PARITY_BITS - 1), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def apart(bits_a: Column, bits_b: Column) -> Column:
    """Bits in which two parity maps differ: never more than the sets differ in values."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(bits_a, F.lit(i)).bitwiseXOR(F.get(bits_b, F.lit(i)))) for i in range(PARITY_BITS // 64)])


def may_link(na: Column, nb: Column, bits_a: Column, bits_b: Column, threshold: int) -> Column:
    """False only for sets whose sizes or parity maps rule the threshold out: sets at it differ in (1 - t) / (1 + t) of all their values."""
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * threshold) & (apart(bits_a, bits_b) * (100 + threshold) <= (na + nb) * (100 - threshold))


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, k: int) -> DataFrame:
    """id, n, the set's fingerprint, its k smallest values and its parity map."""

    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler(t) for t in batch.column(1).to_pylist()]
            n = pa.array([len(s) for s in sets], pa.int64())
            marks = pa.array([_mark(s) for s in sets], pa.binary())
            least, bits = pa.array([s[:k] for s in sets], pa.list_(pa.int64())), pa.array([_parity(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), n, marks, least, bits], ["id", "n", "mark", "sketch", "bits"])

    source = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(source, run, f"id {type_of(docs, id_col)}, n long, mark binary, sketch array<bigint>, bits array<bigint>")


def standing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """Of rows with the same id the one that stands for the document, with all columns; of equal sets the greatest text."""
    k = docs.columns.index(text_col)
    added = [f"standing_{uuid.uuid4().hex}_{name}" for name in ("n", "mark", "id", "row")]
    fields = [T.StructField(added[0], T.LongType()), T.StructField(added[1], T.BinaryType())]

    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler(t) for t in batch.column(k).to_pylist()]
            marks = [_mark(s) for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary())], [*batch.schema.names, *added[:2]])

    marked = map_arrow(docs, run, T.StructType([*docs.schema.fields, *fields]))
    best = marked.groupBy(F.col(id_col).alias(added[2])).agg(F.max_by(F.struct(*docs.columns), F.struct(*added[:2], text_col)).alias(added[3]))
    return best.select(f"{added[3]}.*")


def least_overlap(k: int, threshold: float) -> int:
    """Overlap of two k-sketches that a pair at the threshold falls short of with a probability below one in a million."""
    below, chance = 0.0, 0
    while True:
        below += math.comb(k, chance) * threshold**chance * (1 - threshold) ** (k - chance)
        if below > 1e-6:
            return max(chance, 1)
        chance += 1


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 80, k: int = K, rounds: int = 2) -> DataFrame:
    """One row per id: doc_id, n_shingles, component_id, kept. `threshold` is a percentage of the union.

    `rounds` of meeting leaders only change how much work is left for the last one, which is complete.
    """
    overlap = least_overlap(k, threshold / 100)
    small = k * threshold // 100  # a partner of such a set fits into the sketch, so shared values are counted in full
    raw = cut(sketches(docs, id_col, text_col, words, k))
    hashed = cut(raw.groupBy("id").agg(F.max(F.struct("n", "mark")).alias("x"), F.count("*").alias("rows")).select("id", "x.*", "rows"))
    repeated = cut(hashed.filter("rows > 1").select("id", F.struct("n", "mark").alias("best")))
    stands = F.col("best").isNull() | (F.struct("n", "mark") == F.col("best"))
    standing_rows = raw.filter("n > 0").join(repeated, "id", "left").filter(stands)
    heads = cut(standing_rows.groupBy("mark").agg(F.min(F.struct("id", "n", "sketch", "bits")).alias("x")).select(F.col("x.id").alias("head"), "x.n", "mark", "x.sketch", "x.bits"))

    # one shuffle brings a value's rows together, and counts them; a value that one sketch alone retains proposes nothing
    values = heads.select("head", F.explode("sketch").alias("v"))
    counted = values.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("v"))).filter("df > 1")
    ranked = counted.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("own")).join(heads.select("head", "n"), "head")
    kept = F.least(F.col("n"), F.lit(k))
    need = F.when(F.col("n") <= small, F.ceil(F.col("n") * threshold / 100)).otherwise(F.lit(overlap))
    # values of one sketch alone come first in the order and take up the leading places
    places = F.greatest(kept - need + 1 - (kept - F.size("own")), F.lit(0)).cast("int")
    entries = cut(ranked.select("head", F.explode(F.slice("own", F.lit(1), places)).alias("x")).select("head", "x.v"))
    head_type = type_of(heads, "head")
    linked = heads.sparkSession.createDataFrame([], f"a {head_type}, b {head_type}")
    roots = None

    large = PARITY_BITS * (100 + threshold) // (8 * (100 - threshold))  # above this size the threshold allows maps to differ in more than a quarter of their bits

    def sides(*columns: str) -> list[DataFrame]:
        return [heads.select(F.col("head").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in "ab"]

    def sketched(pairs: DataFrame) -> DataFrame:
        """Pairs of large sets whose union sketch allows the threshold, and all others."""
        one, two = (side.filter(f"n_{x} > {large}") for x, side in zip("ab", sides("n", "sketch"), strict=True))
        rows = pairs.filter(f"n > {large}").join(one, "a").join(two, "b")
        union = F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, k)
        both = F.size(F.array_intersect(F.array_intersect(union, F.col("sketch_a")), F.col("sketch_b")))
        enough = F.least(F.lit(overlap), F.ceil(F.least("n_a", "n_b") * threshold / 100))
        return pairs.filter(f"n <= {large}").select("a", "b").unionByName(rows.filter(both >= enough).select("a", "b"))

    def estimated(pairs: DataFrame) -> DataFrame:
        """Pairs whose parity maps allow the threshold, with the smaller size and the share of values in which the maps differ."""
        one, two = sides("n", "bits")
        rows = pairs.join(one, "a").join(two, "b").filter(may_link(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"), threshold))
        return rows.select("a", "b", F.least("n_a", "n_b").alias("n"), (apart(F.col("bits_a"), F.col("bits_b")) / (F.col("n_a") + F.col("n_b"))).alias("differ"))

    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def compare(batches):
        """Pairs of texts whose full sets reach the threshold; a text that does not stand for its id fails by its mark."""
        shingler = Shingler(words)
        last = None  # rows come in the order of b
        for batch in batches:
            a, b, text_a, mark_a, text_b, mark_b = (c.to_pylist() for c in batch.columns)
            good = []
            for i in range(len(a)):
                if last is None or last[0] != (b[i], text_b[i]):
                    one = shingler(text_b[i])
                    last = (b[i], text_b[i]), one, _mark(one)
                other = shingler(text_a[i])
                both = len(np.intersect1d(other, last[1], assume_unique=True))
                enough = both * 100 >= (len(other) + len(last[1]) - both) * threshold
                good.append(enough and _mark(other) == mark_a[i] and last[2] == mark_b[i])
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs whose full sets reach the threshold."""
        mark_a, mark_b = sides("mark")
        pairs = cut(pairs.select("a", "b").distinct().join(mark_a, "a").join(mark_b, "b"))
        # texts that no pair names stay where they are
        one = among(texts, "id", pairs.select("a")).join(pairs, F.col("id") == F.col("a")).select("a", "b", F.col("text").alias("text_a"), "mark_a", "mark_b")
        two = among(texts, "id", pairs.select("b")).join(pairs.select(F.col("b").alias("id")).distinct(), "id").select("id", F.col("text").alias("text_b"))
        rows = one.join(two, F.col("b") == F.col("id")).select("a", "b", "text_a", "mark_a", "text_b", "mark_b")
        return cut(map_arrow(rows, compare, f"a {head_type}, b {head_type}").distinct())

    def rooted(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows.withColumn("root", F.col("head"))
        return rows.join(roots.select(F.col("node").alias("head"), "root"), "head", "left").withColumn("root", F.coalesce("root", "head"))

    def open_lists(rows: DataFrame) -> DataFrame:
        """Entries of lists that still hold more than one component."""
        lists = rows.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("v")
        return rows.join(lists, "v")

    for round_ in range(rounds):
        active = cut(open_lists(rooted(entries)))
        lead = active.groupBy("v").agg(F.min_by(F.struct("head", "root"), F.xxhash64("v", "head", F.lit(round_))).alias("lead"))
        proposals = active.join(lead, "v").filter("root != lead.root").select(F.col("head").alias("a"), F.col("lead.head").alias("b")).distinct()
        best = estimated(proposals).groupBy("a").agg(F.min_by(F.struct("b", "n"), F.struct("differ", "b")).alias("x")).select("a", "x.*")
        linked = linked.unionByName(verified(sketched(cut(best))))
        roots = cut(components(linked))
    # what is left meets directly, each pair in the list of its least shared value alone, and only ids and sizes leave the join
    active = cut(open_lists(rooted(entries)))
    own = active.groupBy("head").agg(F.collect_list("v").alias("own"))
    rich = cut(active.join(own, "head").join(heads.select("head", "n", "bits"), "head").select("v", "head", "root", "n", "bits", "own"))
    one, two = (rich.select("v", *[F.col(c).alias(f"{c}_{side}") for c in ("head", "root", "n", "bits", "own")]) for side in "ab")
    met = (one["v"] == two["v"]) & (F.col("head_a") < F.col("head_b")) & (F.col("root_a") != F.col("root_b"))
    met &= may_link(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"), threshold)
    met &= one["v"] == F.array_min(F.array_intersect("own_a", "own_b"))
    left = one.join(two, met).select(F.col("head_a").alias("a"), F.col("head_b").alias("b"), F.least("n_a", "n_b").alias("n"))
    linked = linked.unionByName(verified(sketched(cut(left))))
    roots = cut(components(linked))

    members = hashed.filter("n > 0").join(heads.select("head", "mark"), "mark").select("id", "head", "n")
    joined = members.join(roots, F.col("head") == F.col("node"), "left").select("id", "n", F.coalesce("root", "head").alias("component"))
    none = hashed.filter("n = 0").select("id", "n", F.col("id").alias("component"))
    out = joined.unionByName(none)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
