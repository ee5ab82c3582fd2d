"""Quality by ordinal regression on hashed text.

Ratings are grades 0 .. K-1. The cumulative-link model P(grade >= k) = s(w.x - t_k) has one weight vector for all grades
and ascending thresholds. x counts hashed features of the words (shape, first letters), repeated neighbours and repeated
lines, as square roots of their shares, so its length does not grow with the text. Weights and thresholds are fitted on at
most about `sample_rows` rated rows of each grade, drawn by a hash of the id; the expected grade and the tail probability of a
grade select documents.

Defined cases: a null or empty text has the feature of emptiness alone; a row rated more than once counts with its lowest
grade, null ratings are ignored; a row with a null id is never rated; with fewer than two grades among the rated rows every
document gets the highest grade and tail probability 1; repeated rows are scored each; no rows give no rows; other columns
are ignored by `score` and kept by `select_documents`.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm._common import map_arrow, type_of

DIM = 4096
REMEMBERED = 400_000
_LINES, _ECHO, _EMPTY, _LONG = 0, 1, 2, 3
_RESERVED = 8
_SHAPE = ((re.compile(r"[^\W\d_A-Z]+"), "a"), (re.compile(r"[A-Z]+"), "A"), (re.compile(r"\d+"), "9"))


def grade_of(quality: Column, toxic: Column) -> Column:
    """0: bad, 1: good but toxic, 2: good; null without a rating."""
    return F.when(quality == 0, 0).when(quality == 1, F.when(F.coalesce(toxic, F.lit(0)) == 1, 1).otherwise(2)).cast("int")


class Features:
    """Square roots of the shares of hashed features."""

    def __init__(self, dim: int = DIM):
        self.dim, self.known = dim, {}

    def of_word(self, word: str) -> tuple[int, int]:
        shape = word
        for pattern, mark in _SHAPE:
            shape = pattern.sub(mark, shape)
        place = lambda s: _RESERVED + zlib.crc32(s.encode("utf-8", "surrogatepass")) % (self.dim - _RESERVED)
        return place("s" + shape[:8]), place("p" + word[:3].lower())

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        out = np.zeros(self.dim)
        if not words:
            out[_EMPTY] = 1.0
            return out
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        places = []
        for w in words:
            p = known.get(w)
            if p is None:
                p = known[w] = self.of_word(w)
            places.append(p)
        n = len(words)
        out += np.bincount(np.array(places).ravel(), minlength=self.dim) / n
        out[_ECHO] = 4 * sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
        lines = [x for x in text.split("\n") if x]
        out[_LINES] = 4 * (len(lines) - len(set(lines))) / max(len(lines), 1)
        out[_LONG] = min(n, 4000) / 4000
        return np.sqrt(out)


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; grade k or more lies above the k-th

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1 of one document."""
        return 1 / (1 + np.exp(-np.clip(x @ self.weights - self.thresholds, -40, 40)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, ridge: float = 1e-4, rounds: int = 150, rate: float = 0.1) -> Ordinal:
    """Maximum likelihood by Adam; grades weigh the same. Thresholds stay in order as a first one and positive steps."""
    x = x.astype(np.float32, copy=False)  # products in the matrix's own type, without copies of it
    n = np.bincount(y, minlength=grades)
    share = (1.0 / (np.maximum(n, 1) * (n > 0).sum()))[y]
    params = np.zeros(x.shape[1] + grades - 1)
    m, v = np.zeros_like(params), np.zeros_like(params)
    rows = np.arange(len(y))
    for t in range(1, rounds + 1):
        w, raw = params[: x.shape[1]], params[x.shape[1] :]
        steps = np.exp(np.clip(raw[1:], -20, 5))
        cuts = raw[0] + np.concatenate([[0.0], np.cumsum(steps)])
        s = 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32)).astype(float)[:, None] - cuts[None, :], -40, 40)))
        upper = np.column_stack([np.ones(len(y)), s])[rows, y]
        lower = np.column_stack([s, np.zeros(len(y))])[rows, y]
        p = np.maximum(upper - lower, 1e-9)
        up, down = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_score = -share * (up - down)
        g_cut = np.zeros(grades - 1)
        np.add.at(g_cut, y[y > 0] - 1, (share * up)[y > 0])
        np.add.at(g_cut, y[y < grades - 1], -(share * down)[y < grades - 1])
        g_raw = np.concatenate([[g_cut.sum()], [g_cut[k + 1 :].sum() * steps[k] for k in range(grades - 2)]])
        g = np.concatenate([(g_score.astype(np.float32) @ x).astype(float) + ridge * w, g_raw])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    raw = params[x.shape[1] :]
    return Ordinal(params[: x.shape[1]], raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(raw[1:], -20, 5)))]))


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grades: int = 3, sample_rows: int = 1500, dim: int = DIM) -> Ordinal | None:
    """The model from documents and ratings (doc_id, grade), or None without two grades."""
    rated = ratings.select("doc_id", "grade").filter(F.col("grade").between(0, grades - 1)).groupBy(F.col("doc_id").alias("r_id")).agg(F.min("grade").cast("int").alias("grade"))
    counts = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.lit(0.0)
    for g, n in counts.items():
        share = F.when(F.col("grade") == g, min(1.0, sample_rows / n)).otherwise(share)
    rated = rated.filter(F.pmod(F.xxhash64("r_id", F.lit("quality")), F.lit(1 << 30)) < share * (1 << 30))
    # the ratings left are about grades x sample_rows at most, whatever the size of either table, so texts need no shuffle
    texts = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(rated), F.col("d_id") == F.col("r_id")).select("text", "grade")

    def run(batches):
        features = Features(dim)
        for batch in batches:
            found = [features(t).astype(np.float32) for t in batch.column(0).to_pylist()]
            places = [np.flatnonzero(x).astype(np.int32) for x in found]
            x = [v[p].tobytes() for v, p in zip(found, places, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in places], pa.binary()), pa.array(x, pa.binary()), batch.column(1)], ["places", "x", "grade"])

    # grades x sample_rows rows of the numbers that are not 0; the driver holds one dense matrix of them
    sample = map_arrow(rows, run, "places binary, x binary, grade int").collect()
    grade = np.array([r["grade"] for r in sample], dtype=np.int64)
    if len(set(grade.tolist())) < 2:
        return None
    x = np.zeros((len(sample), dim), dtype=np.float32)
    for i, r in enumerate(sample):
        x[i, np.frombuffer(r["places"], np.int32)] = np.frombuffer(r["x"], np.float32)
    del sample
    return fit_ordinal(x, grade, grades)


def score(docs: DataFrame, model: Ordinal | None, id_col: str = "doc_id", text_col: str = "text", at_least: int = 1, grades: int = 3, dim: int = DIM) -> DataFrame:
    """doc_id, expected_grade and tail_probability, that of grade `at_least` or more."""

    def run(batches):
        features = Features(dim)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            expected, tail = np.full(len(texts), grades - 1.0), np.ones(len(texts))
            if model is not None and texts:
                tails = np.array([model.tails(features(t)) for t in texts])
                expected, tail = tails.sum(1), tails[:, at_least - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(tail)], ["doc_id", "expected_grade", "tail_probability"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(source, run, f"doc_id {type_of(docs, id_col)}, expected_grade double, tail_probability double")


def select_documents(docs: DataFrame, model: Ordinal | None, text_col: str = "text", at_least: int = 1, probability: float = 0.5, dim: int = DIM) -> DataFrame:
    """The rows, with all columns, whose tail probability reaches `probability`."""
    if model is None:
        return docs
    k = docs.columns.index(text_col)

    def run(batches):
        features = Features(dim)
        for batch in batches:
            tails = [model.tails(features(t))[at_least - 1] for t in batch.column(k).to_pylist()]
            yield batch.filter(pa.array([p >= probability for p in tails], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
