"""Hard negatives for anchors, with exact integer scores.

A vector's components become floor(scale * x), and a score is the integer inner product with the anchor. Scores are
computed as matrix products modulo several primes in single precision: residues lie between -p/2 and p/2 and the inner
dimension is cut so that no sum reaches 2^24, which keeps every product exact; mixed-radix Chinese remaindering gives the
signed score back. As many primes are taken as the longest vectors of a block ask for. Vectors whose integer components have
a squared length of 2^56 or more are multiplied modulo 2^64 instead; double precision with a bound on its error tells which
of those scores fit 64 bits, and the few it cannot tell are summed as Python integers.

All rows meet all anchors in blocks of bounded size, twice: the first pass keeps the best positives of an anchor, the
second, which knows their scores, the best negatives inside each positive's window. A task returns at most `positives`
(times `negatives`) rows for an anchor, and windows over those choose the final ones, so no anchor's candidates are ever
gathered. Blocks are dealt by a hash of the id, so neither labels nor equal vectors make one larger than others.

Defined cases: rows without id, label or vector or with a null or non-finite component (also after scaling) take no part;
a score that does not fit 64 bits is none, its two rows still meet all others; empty vectors score 0 with each other;
vectors of different lengths have no score and never meet; of rows with the same id the smallest (label, vector) counts; ties go to
the smaller id; an anchor with fewer partners gets fewer; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm._common import map_arrow, type_of
from broadsheet.session import cut

EXACT = 1 << 24
LONGEST = 1 << 56


@lru_cache(maxsize=None)
def primes(count: int, below: int = 1024) -> tuple[int, ...]:
    """The largest primes below a number."""
    found: list[int] = []
    n = below - 1
    while len(found) < count:
        if all(n % k for k in range(2, int(n**0.5) + 1)):
            found.append(n)
        n -= 1
    return tuple(found)


def needed(bound: int) -> tuple[int, ...]:
    """Primes whose product tells apart all scores from -bound to bound."""
    count, product = 1, primes(1)[0]
    while product <= 2 * bound + 1:
        count += 1
        product *= primes(count)[-1]
    return primes(count)


def product_modulo(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, every partial sum exact in single precision."""
    half = p // 2
    step = max(1, (EXACT - 1) // (half * half))
    ra, rb = (((x + half) % p - half).astype(np.float32) for x in (a, b))
    total = np.zeros((len(a), len(b)), dtype=np.float32)
    for at in range(0, a.shape[1], step):
        part = ra[:, at : at + step] @ rb[:, at : at + step].T
        total = np.mod(total + np.mod(part, np.float32(p)), np.float32(p))
    return total.astype(np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two int64 matrices."""
    lengths = [float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0))) for x in (a, b)]
    chosen = needed(int(lengths[0] * lengths[1] * (1 + 1e-9)) + 1)
    digits, value, weight = [], np.zeros((len(a), len(b)), dtype=np.int64), 1
    for k, p in enumerate(chosen):
        rest = product_modulo(a, b, p)
        # mixed radix: what the digits so far leave, over the product of the earlier primes
        known, w = np.zeros_like(rest), 1
        for digit, earlier in zip(digits, chosen, strict=False):
            known = (known + digit * w) % p
            w = w * earlier % p
        digit = (rest - known) * pow(w, -1, p) % p if k else rest
        digits.append(digit)
        value += digit * weight
        weight *= p
    return np.where(value > weight // 2, value - weight, value)


def _wrapped(x: np.ndarray) -> np.ndarray:
    """Whole numbers in doubles, modulo 2^64."""
    small = np.abs(x) < 2.0**62
    out = np.where(small, x, 0).astype(np.int64)
    out[~small] = [(int(v) + (1 << 63)) % (1 << 64) - (1 << 63) for v in x[~small]]
    return out


def long_scores(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of the rows of two matrices of whole doubles, exact where the second result, that they fit 64 bits, holds."""
    values = _wrapped(a) @ _wrapped(b).T
    with np.errstate(all="ignore"):
        near, slack = a @ b.T, (np.abs(a) @ np.abs(b).T) * ((a.shape[1] + 8) * 2.0**-51)
        fits = np.abs(near) + slack < 2.0**63
        unsure = ~fits & ~(np.abs(near) - slack > 2.0**63)
    for i, k in zip(*np.nonzero(unsure), strict=True):
        exact = sum(int(x) * int(y) for x, y in zip(a[i], b[k], strict=True))
        fits[i, k] = -(1 << 63) <= exact < 1 << 63
    return values, fits


def all_scores(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like long_scores; only what meets a long vector takes the slower way."""
    with np.errstate(over="ignore"):
        plain_a, plain_b = ((x**2).sum(1) < LONGEST for x in (a, b))
    values, fits = np.zeros((len(a), len(b)), dtype=np.int64), np.ones((len(a), len(b)), dtype=bool)
    values[np.ix_(plain_a, plain_b)] = scores(a[plain_a].astype(np.int64), b[plain_b].astype(np.int64))
    for of_a, of_b in ((~plain_a, np.ones_like(plain_b)), (plain_a, ~plain_b)):
        if of_a.any() and of_b.any():
            values[np.ix_(of_a, of_b)], fits[np.ix_(of_a, of_b)] = long_scores(a[of_a], b[of_b])
    return values, fits


def _components(vector: list | None, scale: float) -> bytes | None:
    """Whole components, four bytes each, or as doubles if one needs more."""
    if vector is None or None in vector:
        return None
    with np.errstate(over="ignore"):
        x = np.floor(scale * np.array(vector, dtype=np.float64))
    if not np.isfinite(x).all():
        return None
    return (x.astype(np.int32) if (np.abs(x) < 2.0**31).all() else x).tobytes()


def _matrix(column, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i] = np.frombuffer(v, dtype=np.int32 if len(v) == 4 * dim else np.float64) if dim else 0.0
    return out


def _best(values: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest allowed values, ties to the earlier place, best first."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        least = np.partition(values[at], len(at) - k)[len(at) - k]
        at = at[values[at] >= least]
    return at[np.argsort(~values[at], kind="stable")][:k]


def prepared(table: DataFrame, id_col: str, vec_col: str, label: Column, scale: float) -> DataFrame:
    """id, label, integer components and their number of the rows that take part."""
    kind = type_of(table, id_col)
    rows = table.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vec_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("dim", F.size("vector"))
    rows = rows.filter("id is not null and label is not null and vector is not null")

    def run(batches):
        for batch in batches:
            vectors = [_components(v, scale) for v in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(vectors, pa.binary()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "v", "dim"])

    whole = map_arrow(rows, run, f"id {kind}, label {rows.schema['label'].dataType.simpleString()}, v binary, dim int").filter("v is not null")
    return whole.groupBy("id").agg(F.min(F.struct("label", "v", "dim")).alias("x")).select("id", "x.label", "x.v", "x.dim")


def mine(
    table: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label: Column | None = None,
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 5,
    least_percent: int = 80,
    row_block: int = 8192,
    anchor_block: int = 1024,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchor` is a condition on the column `id`; negatives lie between least_percent of the positive's score and the score itself."""
    rows = cut(prepared(table, id_col, vec_col, F.col("label") if label is None else label, scale))
    kind, of = type_of(rows, "id"), type_of(rows, "label")
    anchors = rows.filter(anchor)
    row_blocks = max(1, -(-rows.count() // row_block))
    anchor_blocks = max(1, -(-anchors.count() // anchor_block))

    def block(seed: str, count: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)).cast("int")  # of the type of every(): sides of another type are dealt to other tasks

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    keys = ["dim", "row_block", "anchor_block"]
    dealt = rows.withColumn("row_block", block("row", row_blocks)).withColumn("anchor_block", every(anchor_blocks))

    def meet(asked: DataFrame, choose, schema: str) -> DataFrame:
        def run(members: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            if len(members) and len(anchors):
                members = members.sort_values("id", kind="stable")
                ids, labels, dim = members["id"].to_numpy(), members["label"].to_numpy(), int(members["dim"].iloc[0])
                m = _matrix(members["v"], dim)
                for at in range(0, len(anchors), 256):
                    part = anchors.iloc[at : at + 256]
                    for row, values, fits in zip(part.itertuples(index=False), *all_scores(_matrix(part["v"], dim), m), strict=True):
                        choose(row, ids, labels, values, fits, out)
            names = [c.split()[0] for c in schema.split(", ")]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            kinds = {c: members["id"].dtype if c in ("anchor_id", "id", "positive_id") else "int64" for c in names}
            return pd.DataFrame(dict(zip(names, columns, strict=True))).astype(kinds)

        sides = asked.withColumn("anchor_block", block("anchor", anchor_blocks)).withColumn("row_block", every(row_blocks))
        return dealt.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInPandas(run, schema)

    def choose_positives(row, ids, labels, values, fits, out):
        for k in _best(values, fits & (labels == row.label) & (ids != row.id), positives):
            out.append((row.id, ids[k], values[k]))

    def choose_negatives(row, ids, labels, values, fits, out):
        for positive, score in zip(row.positive_ids, row.positive_scores, strict=True):
            least = -(-least_percent * int(score) // 100)  # of whole numbers; 100 times a score may leave 64 bits
            window = fits & (labels != row.label) & (values <= score) & (values >= least)
            for k in _best(values, window, negatives):
                out.append((row.id, positive, ids[k], score, values[k]))

    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    found = meet(anchors, choose_positives, f"anchor_id {kind}, id {kind}, score long")
    found = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    # at most `positives` entries for an anchor
    lists = found.groupBy(F.col("anchor_id").alias("a_id")).agg(F.collect_list(F.struct("id", "score")).alias("found"))
    asked = anchors.join(lists, F.col("id") == F.col("a_id")).select("id", "label", "v", "dim", F.col("found.id").alias("positive_ids"), F.col("found.score").alias("positive_scores"))
    asked = cut(asked)
    near = meet(asked, choose_negatives, f"anchor_id {kind}, positive_id {kind}, id {kind}, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "id")
    near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return near.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", "negative_score")
