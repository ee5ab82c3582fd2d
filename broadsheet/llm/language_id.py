"""Language of a text by error-correcting output codes.

Every learnt language has a codeword of signs. Each bit has a linear classifier over hashed n-grams of letters (lengths
1 to 3, within a word and its borders, lower-cased), a logistic regression that tells the languages with +1 in that place
from those with -1. A text's features are the shares of its n-grams, so scoring is one sum of weight rows over the whole
text, whatever its length. Decoding adds up the logistic losses of the bits against every codeword, weighted by how often
a bit's classifier is right, and takes the codeword with the least loss; the score is its share after a softmax, and a text is
flagged as ambiguous when the second codeword comes within `margin` of the first.

Codes: up to six languages get every split once (2^(n-1) - 1 bits), more get the most distant of several seeded random codes of
about 15 log2(n) bits. The classifiers are fitted on at most about `sample_rows` texts in all, in equal shares for the languages, drawn
by a hash of the text, equal texts once; all other work is one pass without a shuffle.

Defined cases: a null text and one without a letter give `und`, score 0, not ambiguous; nothing learnt gives `und` for
all; one learnt language gives that language with score 1; equal texts with two languages teach both; a null language
teaches nothing, an empty one is a language like others; ties go to the language that comes first by its bytes; repeated rows are judged each; no
rows give no rows; other columns are ignored. Long texts are worked through in pieces of about `PIECE` characters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm._common import map_arrow, type_of
from broadsheet.session import cut

UNKNOWN = "und"
BITS = 14
ORDERS = (1, 2, 3)
#: Characters whose n-grams are held at once.
PIECE = 1 << 17


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _places(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Where an n-gram starts and the bucket of its hash, in a text whose non-letters are spaces (runs are one space)."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = codes != 32
    good = letter[:n] if order == 1 else letter[:n] | letter[order - 1 : order - 1 + n] if order == 2 else np.ones(n, dtype=bool)
    for k in range(1, order - 1):  # only the first and the last may be a word's border
        good = good & letter[k : k + n]
    mixed = np.full(n, order, dtype=np.uint32)
    for k in range(order):
        mixed = (mixed ^ codes[k : k + n]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
    at = np.flatnonzero(good)
    return at, (mixed[at] >> np.uint32(32 - BITS)).astype(np.int64)


def cleaned(text: str) -> np.ndarray:
    """Code points of the lower-cased text, non-letters as one space, with a space at either end."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, codes, np.uint32(32))[keep]


def pieces(codes: np.ndarray):
    """Cuts with an overlap, so that each n-gram starts in exactly one of them: (piece, starts allowed below)."""
    for at in range(0, len(codes), PIECE):
        yield codes[at : at + PIECE + max(ORDERS) - 1], min(PIECE, len(codes) - at)


def buckets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and their shares."""
    total = np.zeros(1 << BITS)
    for piece, below in pieces(cleaned(text)):
        for order in ORDERS:
            at, bucket = _places(piece, order)
            total += np.bincount(bucket[at < below], minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at] / max(total.sum(), 1)


def margins(texts: list[str], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The classifiers' values for every text: one row of weights for each n-gram, averaged, plus the bias."""
    out = np.zeros((len(texts), weights.shape[1]))
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at + len(group) < len(texts) and (not group or size + len(texts[at + len(group)]) <= PIECE):
            size += len(texts[at + len(group)])
            group.append(texts[at + len(group)])
        if len(group) == 1 and size > PIECE:
            counted = 0
            for piece, below in pieces(cleaned(group[0])):
                for order in ORDERS:
                    place, bucket = _places(piece, order)
                    own = bucket[place < below]
                    out[at] += weights[own].sum(0, dtype=np.float64)
                    counted += len(own)
            out[at] /= max(counted, 1)
        else:
            out[at : at + len(group)] = _group_means(group, weights)
        at += len(group)
    return out + bias


def _group_means(group: list[str], weights: np.ndarray) -> np.ndarray:
    """Means for several texts laid end to end; the border space before a text starts it."""
    whole = [cleaned(t) for t in group]
    codes = np.concatenate([*(w[:-1] for w in whole), np.array([32], np.uint32)])
    begins = np.concatenate([[0], np.cumsum([len(w) - 1 for w in whole])])[:-1]
    sums, counts = np.zeros((len(group), weights.shape[1])), np.zeros(len(group))
    for order in ORDERS:
        place, bucket = _places(codes, order)
        first = np.searchsorted(place, begins)
        n = np.diff(np.append(first, len(place)))
        some = n > 0
        if some.any():
            sums[some] += np.add.reduceat(weights[bucket], first[some], axis=0)
        counts += n
    return sums / np.maximum(counts, 1)[:, None]


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """A sign matrix, one row for each language, no constant column."""
    if languages < 2:
        return np.ones((languages, 0), dtype=np.int64)
    if languages <= 6:
        columns = np.arange(1, 1 << (languages - 1))
        rows = [np.ones_like(columns)] + [1 - 2 * ((columns >> k) & 1) for k in range(languages - 1)]
        return np.array(rows)
    rng, length, best, apart = np.random.default_rng(seed), math.ceil(15 * math.log2(languages)), None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], size=(languages, length))
        code = code[:, np.abs(code.sum(0)) < languages]
        gap = (code.shape[1] - (code @ code.T)[np.triu_indices(languages, 1)].max()) // 2  # least number of places in which two rows differ
        if gap > apart:
            best, apart = code, gap
    return best


@dataclass
class Identifier:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray  # of each bit, adding up to 1

    def losses(self, values: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every text (row) against every codeword (column)."""
        fit, misfit = np.logaddexp(0, -values), np.logaddexp(0, values)
        plus = (self.code > 0).T.astype(float)
        return (fit * self.trust) @ plus + (misfit * self.trust) @ (1 - plus)

    def decode(self, values: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the nearest codeword, its score, whether another is nearly as near."""
        loss = self.losses(values)
        best = loss.argmin(1)
        share = np.exp(-(loss - loss.min(1, keepdims=True)) * len(self.trust))
        score = 1 / share.sum(1)
        if loss.shape[1] < 2:
            return best, score, np.zeros(len(best), dtype=bool)
        two = np.partition(loss, 1, axis=1)[:, :2]
        return best, score, two[:, 1] - two[:, 0] < margin


def fit_bits(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, importance: np.ndarray, rounds: int = 60, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regressions for all bits at once (accelerated gradient, features scaled): weights, bias, values reached.

    rows are sparse (buckets, shares); targets has a sign for each row and bit."""
    index = np.concatenate([b for b, _ in rows])
    share = np.concatenate([s for _, s in rows])
    begins = np.concatenate([[0], np.cumsum([len(b) for b, _ in rows])])[:-1]
    row = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    scale = np.sqrt(np.bincount(index, weights=share**2, minlength=1 << BITS) / len(rows) + 1e-7)
    x = (share / scale[index]).astype(np.float32)
    norm = math.sqrt((np.add.reduceat(x**2, begins) * importance).sum())
    x /= norm
    n_bits = targets.shape[1]
    w, c = np.zeros((1 << BITS, n_bits), np.float32), np.zeros(n_bits)
    ahead_w, ahead_c = w.copy(), c.copy()

    def values(w, c):
        out = np.empty((len(rows), n_bits))
        for a in range(0, len(rows), 256):
            lo, hi = begins[a], begins[a + 256] if a + 256 < len(rows) else len(index)
            out[a : a + 256] = np.add.reduceat(w[index[lo:hi]] * x[lo:hi, None], begins[a : a + 256] - lo, axis=0)
        return out + c

    for k in range(rounds):
        v = values(ahead_w, ahead_c)
        pull = targets * importance[:, None] / (1 + np.exp(np.clip(targets * v, -30, 30)))
        step = 2.0  # the curvature is at most a quarter of the mean squared length, the bias included
        new_w = ahead_w * (1 - step * ridge)
        for b in range(n_bits):
            new_w[:, b] += step * np.bincount(index, weights=x * pull[row, b], minlength=1 << BITS)
        new_c = ahead_c + step * pull.sum(0)
        ahead_w, ahead_c = new_w + k / (k + 3) * (new_w - w), new_c + k / (k + 3) * (new_c - c)
        w, c = new_w, new_c
    return (w / (norm * scale)[:, None]).astype(np.float32), c, values(w, c)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = 3000) -> Identifier:
    """The classifiers from rows with a text and a language; equal texts of a language teach once."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    rows = rows.withColumn("key", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}  # one row for each language
    languages = sorted(counts, key=lambda s: s.encode())
    code = codewords(len(languages))
    empty = Identifier(languages, code, np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.full(code.shape[1], 1 / max(1, code.shape[1])))
    if len(languages) < 2:
        return empty
    share = sample_rows / len(languages)
    place = rows.sparkSession.createDataFrame([(name, i, min(1.0, share / max(1, counts[name]))) for i, name in enumerate(languages)], "lang string, place int, share double")
    # one row for each language
    drawn = rows.join(F.broadcast(place), "lang").filter(F.pmod(F.xxhash64("key", F.lit("language")), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def run(batches):
        for batch in batches:
            found = [buckets(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([b.astype(np.uint16).tobytes() for b, _ in found]), pa.array([s.astype(np.float32).tobytes() for _, s in found])],
                ["place", "key", "buckets", "shares"],
            )

    features = map_arrow(drawn.select("text", "place", "key"), run, "place int, key long, buckets binary, shares binary")
    sample = cut(features.dropDuplicates(["place", "key"])).orderBy("place", "key").toPandas()  # bounded by sample_rows
    rows_ = [(np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(s, np.float32)) for b, s in zip(sample["buckets"], sample["shares"], strict=True)]
    own = sample["place"].to_numpy()
    if not len(own):
        return empty
    of_each = np.bincount(own, minlength=len(languages))
    importance = (1 / of_each[own]) / (of_each > 0).sum()
    targets = code[own].astype(float)
    weights, bias, reached = fit_bits(rows_, targets, importance)
    right = ((reached * targets > 0) * importance[:, None]).sum(0)
    trust = np.log((right + 0.01) / (1.01 - right)).clip(0.01)
    return Identifier(languages, code, weights, bias, trust / trust.sum())


def identify(docs: DataFrame, model: Identifier, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.05) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2^14 rows of one weight for each bit

    def run(batches):
        known = shipped.value
        for batch in batches:
            texts, readable = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(readable) if known.languages else np.zeros(0, np.int64)
            lang, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
            if len(at):
                best, score[at], unsure[at] = known.decode(margins([texts[i] for i in at], known.weights, known.bias), margin)
                for i, k in zip(at, best, strict=True):
                    lang[i] = known.languages[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("readable"))
    return map_arrow(source, run, f"doc_id {type_of(docs, id_col)}, lang_pred string, score double, ambiguous boolean")
