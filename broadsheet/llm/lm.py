"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped sorted hash arrays.

Counting: tasks hash words, count bigrams and words in chunks of bounded size and send packed arrays, dealt by bits of a
mixed hash of both words, so a frequent word's bigrams spread over all shards. A shard's task sorts and adds up its
bigrams, writes their sorted hashes and counts as plain arrays, and sends on what contexts and continuations need, dealt
by the word; a second set of tasks writes the words' arrays (count, context total, numbers of followers met once, twice,
more often, number of predecessors). The driver gets one row per shard: names of files and sums for the discounts.

Scoring: workers map the arrays and look up a batch's distinct words and bigrams by binary search.

P(w | v) = max(c(vw) - D(c), 0) / c(v) + g(v) * Pc(w), with the three discounts of the counts, and Pc the same over
numbers of predecessors, interpolated with 1 / (V + 1). A text stands between a start (context only) and an end token.

Hashes of words have 64 bits; bigrams are made of 40 bits of each word and found by shard number and 32 bits, so a bigram
that was never counted is taken for another one about once in ten thousand look-ups of a large shard. The model's files
lie in the shared folder, which workers must have mounted.

Defined cases: a null or empty text is the end token alone; without training rows all counts are zero and every token has
the uniform probability 1 / (V + 1) = 1; repeated rows count and are scored each; a null id belongs to the fold of the
empty text; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm._common import map_arrow, shared_folder, type_of
from broadsheet.session import cut

START = np.uint64(xxhash.xxh3_64_intdigest(b"\n start"))  # words hold no white space
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n end"))
CHUNK = 1_000_000
REMEMBERED = 500_000


class Words:
    """64-bit hashes of a text's lower-cased words, then the end token."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for w in (text or "").encode("utf-8", "surrogatepass").lower().split():
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        out.append(int(END))
        return np.array(out, dtype=np.uint64)


def short(h: np.ndarray) -> np.ndarray:
    """The 40 bits of a word by which bigrams know it."""
    return h >> np.uint64(24)


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hash of a bigram of short words."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def packed(x: np.ndarray) -> bytes:
    """40-bit numbers in five bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the columns added up."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], *(np.add.reduceat(c[order], first) if len(keys) else c for c in columns)


def shard_of(x: np.ndarray, bits: int, width: int) -> np.ndarray:
    return (x >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(x), dtype=np.int64)


def sliced(shards: np.ndarray):
    """(shard, slice) of an ascending array of shard numbers."""
    ids, at = np.unique(shards, return_index=True)
    return [(int(s), slice(a, b)) for s, a, b in zip(ids, at, [*at[1:], len(shards)], strict=True)]


def discounts(n: list[float]) -> tuple[float, float, float]:
    """Discounts for counts of one, two, and more, from the numbers of things met one to four times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return (0.5, 0.75, 0.9)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)]


@dataclass
class Model:
    """Names of the shards' files and the few numbers that all of them share."""

    bits: int
    pairs: dict[int, str]
    words: dict[int, str]
    tokens: int
    distinct: int
    types: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_spare: float
    opened: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"opened": {}}

    def array(self, path: str, dtype) -> np.ndarray:
        if path not in self.opened:
            self.opened[path] = np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype=dtype)
        return self.opened[path]

    def word_rows(self, h: np.ndarray) -> np.ndarray:
        """count, context total, followers met once, twice, more often, predecessors, of ascending word hashes."""
        out = np.zeros((len(h), 6), dtype=np.int64)
        for shard, part in sliced(shard_of(h, self.bits, 64)):
            if shard in self.words:
                keys, rows = self.array(self.words[shard] + ".keys", np.uint64), self.array(self.words[shard] + ".rows", np.uint32).reshape(-1, 6)
                at = np.minimum(np.searchsorted(keys, h[part]), max(len(keys) - 1, 0))
                known = keys[at] == h[part] if len(keys) else np.zeros(len(at), dtype=bool)
                out[part][known] = rows[at[known]]
        return out

    def pair_counts(self, m: np.ndarray) -> np.ndarray:
        """Counts of ascending bigram hashes."""
        out = np.zeros(len(m), dtype=np.int64)
        for shard, part in sliced(shard_of(m, self.bits, 64)):
            if shard in self.pairs:
                keys, counts = self.array(self.pairs[shard] + ".keys", np.uint32), self.array(self.pairs[shard] + ".rows", np.uint32)
                want = ((m[part] << np.uint64(self.bits)) >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
                known = keys[at] == want if len(keys) else np.zeros(len(at), dtype=bool)
                out[part][known] = counts[at[known]]
        return out

    def score(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of each second word after the first, and the second word's count."""
        h, place = np.unique(np.concatenate([first, second]), return_inverse=True)
        rows = self.word_rows(h)
        context, word = rows[place[: len(first)]], rows[place[len(first) :]]
        m, back = np.unique(mixed(short(first), short(second)), return_inverse=True)
        c = self.pair_counts(m)[back]
        uniform = 1.0 / (self.distinct + 1)
        types = max(self.types, 1)
        lower = np.maximum(word[:, 5] - discount(word[:, 5], self.word_discounts), 0) / types + self.word_spare * uniform
        total = np.maximum(context[:, 1], 1)
        spare = np.where(context[:, 1] > 0, context[:, 2:5] @ np.array(self.pair_discounts) / total, 1.0)
        c = np.where(context[:, 1] > 0, c, 0)
        p = np.maximum(c - discount(c, self.pair_discounts), 0) / total + spare * lower
        return np.log10(np.maximum(p, 1e-300)), word[:, 0]


def fit(docs: DataFrame, text_col: str = "text", shard_tokens: int = 1_000_000) -> Model:
    """Count the bigrams of all rows and write the model's arrays. `shard_tokens`: about how many tokens make a shard."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "lm")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + 6)).first()[0] or 0
    bits = max(2, math.ceil(math.log2(size / 6 / shard_tokens + 1)))

    def count(batches):
        words = Words()
        names = ["shard", "kind", "a", "b", "n"]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

        def flush(held: list[np.ndarray]):
            stream = np.concatenate(held)
            inner = stream != START
            h, n = np.unique(stream[inner], return_counts=True)
            out = [(s, 0, h[part].tobytes(), None, n[part].astype("<u4").tobytes()) for s, part in sliced(shard_of(h, bits, 64))]
            later = np.flatnonzero(inner)
            first, second = short(stream[later - 1]), short(stream[later])
            m, at, n = np.unique(mixed(first, second), return_index=True, return_counts=True)
            first, second = first[at], second[at]
            for s, part in sliced(shard_of(m, bits, 64)):
                out.append((s, 1, packed(first[part]), packed(second[part]), n[part].astype("<u4").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        held, n = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                w = words(text)
                held += [np.array([START]), w]
                n += len(w)
                if n >= CHUNK:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    def write(name: str, keys: np.ndarray, rows: np.ndarray) -> str:
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        for part, x in (("keys", keys), ("rows", rows)):
            with open(f"{path}.{part}", "wb") as f:
                f.write(np.ascontiguousarray(x).tobytes())
        return path

    def add_pairs(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        own = group[group["kind"] == 0]
        out = []
        if len(own):
            h, n = summed(np.frombuffer(b"".join(own["a"]), dtype=np.uint64), np.frombuffer(b"".join(own["n"]), dtype="<u4").astype(np.int64))
            out.append((shard, 0, h.tobytes(), None, n.astype("<u4").tobytes(), None, 0, 0, 0, 0, 0))
        own = group[group["kind"] == 1]
        if len(own):
            first, second = unpacked(b"".join(own["a"])), unpacked(b"".join(own["b"]))
            n = np.frombuffer(b"".join(own["n"]), dtype="<u4").astype(np.int64)
            m = mixed(first, second)
            order = np.argsort(m, kind="stable")
            m, first, second = m[order], first[order], second[order]
            at = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
            m, first, second, n = m[at], first[at], second[at], np.add.reduceat(n[order], at)
            path = write("pairs", ((m << np.uint64(bits)) >> np.uint64(32)).astype("<u4"), n.astype("<u4"))
            tally = [int((n == k).sum()) for k in range(1, 5)]
            out.append((shard, 4, None, None, None, path, *tally, len(n)))
            h, *sums = summed(first, n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))
            rows = np.column_stack(sums).astype("<u4")
            out += [(s, 2, packed(h[part]), None, rows[part].tobytes(), None, 0, 0, 0, 0, 0) for s, part in sliced(shard_of(h, bits, 40))]
            h, sums = summed(second, np.ones(len(second), dtype=np.int64))
            out += [(s, 3, packed(h[part]), None, sums[part].astype("<u4").tobytes(), None, 0, 0, 0, 0, 0) for s, part in sliced(shard_of(h, bits, 40))]
        return pd.DataFrame(out, columns=["shard", "kind", "a", "b", "n", "path", "t1", "t2", "t3", "t4", "types"])

    def add_words(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        parts = {k: g for k, g in group.groupby("kind")}
        out = [(shard, "pairs", r["path"], r["t1"], r["t2"], r["t3"], r["t4"], r["types"], 0) for _, r in parts[4].iterrows()] if 4 in parts else []

        def arrays(kind: int, width: int):
            g = parts.get(kind)
            if g is None:
                return np.empty(0, dtype=np.uint64), np.empty((0, width), dtype=np.int64)
            keys = np.frombuffer(b"".join(g["a"]), dtype=np.uint64) if kind == 0 else unpacked(b"".join(g["a"]))
            rows = np.frombuffer(b"".join(g["n"]), dtype="<u4").reshape(-1, width).astype(np.int64)
            keys, *columns = summed(keys, *rows.T)
            return keys, np.column_stack(columns)

        h, n = arrays(0, 1)
        start = np.array([START]) if shard == int(shard_of(np.array([START]), bits, 64)[0]) else np.empty(0, dtype=np.uint64)
        h, n = np.concatenate([h, start]), np.concatenate([n.ravel(), np.zeros(len(start), dtype=np.int64)])
        order = np.argsort(h)
        h, n = h[order], n[order]
        table = np.zeros((len(h), 6), dtype=np.int64)
        table[:, 0] = n
        for kind, width, to in ((2, 4, slice(1, 5)), (3, 1, slice(5, 6))):
            keys, rows = arrays(kind, width)
            if len(keys) and len(h):
                at = np.minimum(np.searchsorted(keys, short(h)), len(keys) - 1)
                known = keys[at] == short(h)
                table[known, to] = rows[at[known]]
        met = table[:, 5]
        tally = [int((met == k).sum()) for k in range(1, 5)]
        # of predecessors: one, two, three, four, any
        out.append((shard, "words", write("words", h, table.astype("<u4")), *tally, int((n > 0).sum()), int(n.sum())))
        out.append((shard, "more", "", 0, 0, int((met > 2).sum()), 0, 0, 0))
        return pd.DataFrame(out, columns=["shard", "kind", "path", "t1", "t2", "t3", "t4", "types", "tokens"])

    packed_rows = map_arrow(texts, count, "shard int, kind int, a binary, b binary, n binary")
    paired = packed_rows.groupBy("shard").applyInPandas(add_pairs, "shard int, kind int, a binary, b binary, n binary, path string, t1 long, t2 long, t3 long, t4 long, types long")
    manifest = cut(paired.groupBy("shard").applyInPandas(add_words, "shard int, kind string, path string, t1 long, t2 long, t3 long, t4 long, types long, tokens long")).collect()
    by = {k: [r for r in manifest if r["kind"] == k] for k in ("pairs", "words", "more")}
    tally = {k: [sum(r[f"t{i}"] for r in by[k]) for i in range(1, 5)] for k in by}
    word_d = discounts(tally["words"])
    types = sum(r["types"] for r in by["pairs"])
    spare = (word_d[0] * tally["words"][0] + word_d[1] * tally["words"][1] + word_d[2] * tally["more"][2]) / types if types else 1.0
    return Model(
        bits, {r["shard"]: r["path"] for r in by["pairs"]}, {r["shard"]: r["path"] for r in by["words"]},
        sum(r["tokens"] for r in by["words"]), sum(r["types"] for r in by["words"]), types, discounts(tally["pairs"]), word_d, spare,
    )


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (add-half unigrams), score (log10 P of the text), perplexity."""

    def run(batches):
        words = Words()
        norm = math.log10(model.tokens + 0.5 * (model.distinct + 1))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if not texts:
                continue
            streams = [words(t) for t in texts]
            n = np.array([len(s) for s in streams])
            ends = np.cumsum(n)
            second = np.concatenate(streams)
            first = np.concatenate([[START], second[:-1]]).astype(np.uint64)
            first[ends[:-1]] = START
            logs, counts = model.score(first, second)
            at = ends - n
            total = np.add.reduceat(logs, at)
            base = np.add.reduceat(np.log10(counts + 0.5) - norm, at)
            known = np.add.reduceat((counts > 0).astype(np.int64), at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int64)), pa.array(known), pa.array(base), pa.array(total), pa.array(10 ** np.minimum(-total / n, 300))],
                ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"],
            )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(source, run, f"doc_id {type_of(docs, id_col)}, n_tokens long, n_known long, base_score double, score double, perplexity double")
