"""Near-duplicate embeddings by product quantisation.

A coarse k-means on a bounded sample gives lists, a k-means per subspace on the residuals gives the codes. Vectors are
written once, ordered by list, in blocks of a bounded number of rows to files in the shared folder; every task reads one
block and after it, one at a time, the blocks that it is to be compared with, so vectors are never copied for a comparison.
Every two blocks meet once. A block's stored codes are compared with the other's vectors asymmetrically: what the codes
stand for (centroid plus one book entry per subspace), times the vectors, in single precision. That misses the true
cosine by at most the stored vector's quantisation error and a rounding error, so adding both loses nothing; what remains
is decided by the exact cosine in doubles. A vector whose products with a block's centroids, plus the longest residuals
there, stay below the threshold is not compared with that block. No link is lost, whatever the vectors look like.

Disk is in proportion to the rows: ids and vectors once, vectors and codes once in a shuffle and once in the files. Comparisons
grow with the square of the rows unless the lists keep blocks apart; a task holds two blocks.

Vectors that are equal component by component are one class, and only its head is compared. A task returns a count for each
vector that is linked and a spanning link for each vector that it connects, never its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do those
of another dimension than the most frequent one; of rows with the same id the smallest vector counts; rows without an id
are left out; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm._common import map_arrow, marked, shared_folder, type_of
from broadsheet.llm._graph import components
from broadsheet.session import cut


def rounding(dim: int) -> float:
    """More than single precision can lose in the product of a unit vector and a decoded one."""
    return (dim + 8) * 2.0**-22


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from k distinct rows; a centre that loses all rows stays where it is."""
    start = np.unique(x, axis=0)
    centres = start[np.random.default_rng(seed).permutation(len(start))[:k]].copy()
    for _ in range(rounds):
        own = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
        own = own.argmin(1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Quantiser:
    """Coarse centroids and a codebook per subspace, fitted on unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codes: int):
        self.centres = kmeans(sample, lists)
        dim = sample.shape[1]
        self.cuts = [int(c) for c in np.linspace(0, dim, min(subspaces, dim) + 1)]
        rest = sample - self.centres[self.distances(sample).argmin(1)]
        self.books = [kmeans(rest[:, a:b], codes) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids, less the vectors' own squared lengths."""
        return (self.centres**2).sum(1)[None, :] - 2 * x @ self.centres.T

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the lengths of what they miss."""
        rest = x - self.centres[own]
        codes, miss = [], np.zeros(len(x))
        for book, a, b in zip(self.books, self.cuts, self.cuts[1:], strict=False):
            part = rest[:, a:b]
            code = ((book**2).sum(1)[None, :] - 2 * part @ book.T).argmin(1)
            codes.append(code.astype(np.uint8))
            miss += ((part - book[code]) ** 2).sum(1)
        return np.column_stack(codes), np.sqrt(miss)

    def decoded(self, list_: int | np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What codes stand for: the centroid of their list, or of each one's, and an entry of each book."""
        return self.centres[list_] + np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of finite vectors, none of them zero, at length one."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=dtype).reshape(len(column), -1)


def _fixed(column: pa.Array, dtype) -> np.ndarray:
    """A column of fixed-size binaries as a matrix, without a copy."""
    width = column.type.byte_width
    return np.frombuffer(column.buffers()[1], dtype=np.uint8)[column.offset * width : (column.offset + len(column)) * width].view(dtype).reshape(len(column), -1)


def _linked(hit: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node) within the connected parts of a two-sided hit matrix; nodes are numbers."""
    label_r, label_c, far = rows.copy(), columns.copy(), np.iinfo(np.int64).max
    while True:
        new_r = np.minimum(label_r, np.where(hit, label_c[None, :], far).min(1, initial=far))
        new_c = np.minimum(label_c, np.where(hit, new_r[:, None], far).min(0, initial=far))
        if (new_r == label_r).all() and (new_c == label_c).all():
            break
        label_r, label_c = new_r, new_c
    pairs = np.concatenate([np.column_stack([rows, label_r]), np.column_stack([columns, label_c])])
    return [tuple(p) for p in np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)]


def near_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    threshold: float = 0.9,
    sample_rows: int = 20_000,
    subspaces: int = 8,
    codes: int = 64,
    block: int = 2048,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. `sample_rows` bounds what the quantiser is fitted on."""
    spark, kind = table.sparkSession, type_of(table, id_col)
    width, dtype = ("float", "<f4") if table.schema[vec_col].dataType == T.ArrayType(T.FloatType()) else ("double", "<f8")
    rows = table.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast(f"array<{width}>").alias("v"))
    again = cut(rows.groupBy("id").count().filter("count > 1").select("id"))
    both = marked(rows, "id", again, "again")  # only rows of repeated ids are shuffled
    rows = both.filter("not again").select("id", "v").unionByName(both.filter("again").groupBy("id").agg(F.min("v").alias("v")))

    def unit(batches):
        for batch in batches:
            lists, raw, digest = batch.column(1), [None] * len(batch), [None] * len(batch)
            values = lists.flatten().to_numpy(zero_copy_only=False)  # a null component becomes not a number
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            for length in np.unique(n[n > 0]):
                at = np.flatnonzero(n == length)
                x = values[(np.cumsum(n) - n)[at][:, None] + np.arange(length)].astype(dtype)
                good = np.isfinite(x).all(1) & (x != 0).any(1)
                for i, v, u in zip(at[good], x[good], unit_rows(x[good]) if good.any() else [], strict=True):
                    raw[i], digest[i] = v.tobytes(), hashlib.sha256(u.tobytes()).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], ["id", "digest", "raw"])

    units = cut(map_arrow(rows, unit, f"id {kind}, digest binary, raw binary"))
    dims = units.filter("raw is not null").groupBy(F.octet_length("raw").alias("bytes")).count().orderBy(F.desc("count"), "bytes").first()
    alone = units.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    if dims is None:
        return alone.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.lit(True).alias("kept"))
    valid = F.coalesce(F.octet_length("raw") == dims["bytes"], F.lit(False))
    classes = cut(units.filter(valid).groupBy("digest").agg(F.min("id").alias("head"), F.count("*").alias("mult")))
    n = classes.count()
    # heads with their vectors; only rows of classes of several are joined
    several = cut(units.filter(valid).select("id", "digest").join(classes.filter("mult > 1"), "digest").select(F.col("id").alias("member"), "head", "mult"))
    both = marked(units.filter(valid).select("id", "raw"), "id", several.select("member"), "joined")
    one = F.lit(1).cast("long").alias("mult")
    joined = both.filter("joined").join(several, F.col("id") == F.col("member"), "left").filter("member is null or id = head")
    firsts = both.filter("not joined").select("id", one, "raw").unionByName(joined.select("id", F.coalesce("mult", F.lit(1)).alias("mult"), "raw"))
    share = F.lit(int(min(1.0, sample_rows / n) * (1 << 30)))
    drawn = firsts.filter(F.pmod(F.xxhash64("raw"), F.lit(1 << 30)) < share).select("raw").orderBy("raw").collect() or [firsts.first()]
    sample = unit_rows(_matrix([r["raw"] for r in drawn], dtype))
    lists = max(1, min(math.isqrt(n), 4096, len(sample) // 8))
    shipped = spark.sparkContext.broadcast(Quantiser(sample, lists, subspaces, codes))  # bounded by sample_rows

    def assign(batches):
        q = shipped.value
        for batch in batches:
            x = unit_rows(_matrix(batch.column(2).to_pylist(), dtype))
            own = q.distances(x).argmin(1)
            code, miss = q.encode(x, own)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(miss)], ["id", "mult", "raw", "list", "code", "miss"]
            )

    folder = shared_folder(spark, "vectors")

    def write(batches):
        q, held, path, out, count = shipped.value, [], f"{folder}/{uuid.uuid4().hex}", None, 0

        def put(part: pa.Table):
            nonlocal out, count
            for name in ("raw", "code"):
                at = part.schema.get_field_index(name)
                part = part.set_column(at, name, part.column(at).cast(pa.binary(len(part.column(at)[0].as_py()))))
            part = part.combine_chunks().to_batches()[0]
            if out is None:
                os.makedirs(folder, exist_ok=True)
                out = pa.ipc.new_file(path, part.schema)
            out.write_batch(part)
            count += 1
            own = part.column("list").to_numpy()
            long = np.linalg.norm(unit_rows(_fixed(part.column("raw"), dtype)) - q.centres[own], axis=1)
            here = np.unique(own)
            return pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([count - 1], pa.int32()), pa.array([here], pa.list_(pa.int32())), pa.array([[long[own == k].max() for k in here]], pa.list_(pa.float64()))],
                ["path", "place", "lists", "longest"],
            )

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= block:
                table = pa.Table.from_batches(held)
                while len(table) >= block:
                    yield put(table.slice(0, block))
                    table = table.slice(block)
                held = table.to_batches()
        if sum(map(len, held)):
            yield put(pa.Table.from_batches(held))
        if out is not None:
            out.close()

    # a list that holds a large share of all rows goes to eight partitions
    dealt = map_arrow(firsts, assign, f"id {kind}, mult long, raw binary, list int, code binary, miss double").repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("list")
    index = map_arrow(dealt, write, "path string, place int, lists array<int>, longest array<double>").collect()  # one row a block
    blocks = spark.sparkContext.broadcast([(r["path"], r["place"], np.array(r["lists"]), np.array(r["longest"])) for r in index])

    def compare(batches):
        q, all_blocks, opened = shipped.value, blocks.value, {}
        total = len(all_blocks)

        def read(k: int) -> pa.RecordBatch:
            path, place = all_blocks[k][:2]
            if path not in opened:
                opened.clear()  # blocks follow each other by file
                opened[path] = pa.ipc.open_file(pa.memory_map(path))
            return opened[path].get_batch(place)

        def links_of(i: int):
            one = read(i)
            x, mult, ids = unit_rows(_fixed(one.column("raw"), dtype)), one.column("mult").to_numpy(), one.column("id").to_numpy(zero_copy_only=False)
            small, counts = x.astype(np.float32), np.zeros(len(x), dtype=np.int64)
            for step in range(total // 2 + 1):
                j = (i + step) % total
                if 2 * step == total and i >= j:
                    continue  # the other block takes this pair
                centres, longest = q.centres[all_blocks[j][2]], all_blocks[j][3]
                near = np.flatnonzero((x @ centres.T + longest >= threshold - 1e-9).any(1))
                if not len(near):
                    continue
                other = read(j)
                coarse = q.decoded(other.column("list").to_numpy(), _fixed(other.column("code"), np.uint8)).astype(np.float32).T
                least = (threshold - rounding(x.shape[1]) - other.column("miss").to_numpy()).astype(np.float32)
                hit = small[near] @ coarse >= least
                some, own = x[near], unit_rows(_fixed(other.column("raw"), dtype))
                maybe = np.flatnonzero(hit)
                if len(maybe) > hit.size // 8:
                    r, c = np.nonzero(some @ own.T >= threshold)
                else:
                    r, c = np.divmod(maybe, hit.shape[1])
                    parts = [slice(k, k + 8192) for k in range(0, len(r), 8192)]
                    sure = np.concatenate([np.einsum("ij,ij->i", some[r[k]], own[c[k]]) >= threshold for k in parts] or [maybe > 0])
                    r, c = r[sure], c[sure]
                # most blocks hold nothing near a vector
                if not len(r):
                    continue
                (r, at_r), (c, at_c) = np.unique(near[r], return_inverse=True), np.unique(c, return_inverse=True)
                hit = np.zeros((len(r), len(c)), dtype=bool)
                hit[at_r, at_c] = True
                if not step:
                    hit &= r[:, None] != c[None, :]
                counts[r] += hit @ other.column("mult").to_numpy()[c]
                others = other.column("id").to_numpy(zero_copy_only=False)[c]
                if step:
                    back = mult[r] @ hit
                    yield from ((others[k], int(back[k]), None) for k in np.flatnonzero(back))
                names, place = np.unique(np.concatenate([ids[r], others]), return_inverse=True)
                yield from ((names[f], 0, names[g]) for f, g in _linked(hit, place[: len(r)].astype(np.int64), place[len(r) :].astype(np.int64)))
            yield from ((ids[k], int(counts[k]), None) for k in np.flatnonzero(counts))

        for batch in batches:
            for i in batch.column(0).to_pylist():
                rows = list(links_of(i))
                if rows:
                    key = read(i).schema.field("id").type
                    a, counted, b = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, key), pa.array(counted, pa.int64()), pa.array(b, key)], ["id", "n", "other"])

    tasks = spark.range(0, len(index), 1, max(1, min(len(index), 1000)))
    found = cut(map_arrow(tasks, compare, f"id {kind}, n long, other {kind}"))
    roots = components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    heads = classes.join(links, F.col("head") == F.col("id"), "left").drop("id").join(roots, F.col("head") == F.col("node"), "left")
    heads = heads.select("digest", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "head").alias("component"))
    joined = units.filter(valid).select("id", "digest").join(heads, "digest").select("id", "n_links", "component")
    out = joined.unionByName(alone.join(units.filter(~valid).select("id"), "id", "left_semi"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
