"""Toxicity scores from a weighted lexicon.

Texts are folded: lower case, look-alike letters of other scripts and digits written for letters become Latin letters
(i, l and 1 are one letter), combining marks and format characters (soft hyphens, zero-width characters) vanish, everything
else that is no letter or digit becomes a space. The lexicon holds whole words and
word beginnings with weights, learnt from labelled rows: the log odds of being met in a toxic rather than a harmless text,
kept only where a likelihood ratio passes a Bonferroni bound over all candidates. Near copies (equal least shingle hash)
teach once. Phrases around lexicon words that labelled rows know as harmless, and given ones, are exceptions: hits inside
them do not count. One Aho-Corasick automaton finds terms and exceptions in a pass over the text; the sum of weights,
divided by the square root of the length, goes through a logistic curve fitted on the same rows.

What is learnt comes from about `sample_rows` labelled rows of either label (all if fewer), drawn by a hash of the id.

Defined cases: a null or empty text has no hits and the score of a harmless one; an unlabelled corpus gives an empty
lexicon and scores of 0; of several labels for a row the highest counts, null labels are ignored; a row with a null id is
never labelled; repeated rows are scored each; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm._common import map_arrow, type_of
from broadsheet.session import cut

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
LOOK_ALIKE = dict(zip("аеорсухіјѕкмтвнԁɡαεορτυνικ", "aeopcyxijskmtbhdgaeoptuvik", strict=True))
WRITTEN_FOR = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "i": "l"}
EXCEPTIONS = ("trash can", "trash bin", "clown fish")
BEGINNINGS = (4, 5, 6)

#: Decompositions of signs that are written as letters, unlike those of marks set beside a word.
AS_LETTERS = ("<wide>", "<narrow>", "<circle>", "<font>")


class _Table(dict):
    """What each character becomes, filled as characters are met: marks and format characters vanish, letters and digits
    lose their marks, all others become a space."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        category = unicodedata.category(c)
        if category[0] == "M" or category == "Cf":
            out = ""
        elif not c.isalnum() and c not in WRITTEN_FOR and not unicodedata.decomposition(c).startswith(AS_LETTERS):
            out = " "
        else:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x)[0] != "M")
            letters = (LOOK_ALIKE.get(x, x) for x in unicodedata.normalize("NFKC", plain).lower())
            out = "".join(WRITTEN_FOR.get(x, x if x.isalnum() else " ") for x in letters)
        self[code] = out
        return out


_TABLE = _Table()


def folded(text: str | None) -> str:
    """The folded text with a space at either end."""
    return f" {(text or '').lower().translate(_TABLE)} "


def terms_of(word: str) -> list[str]:
    """A whole word, and its beginnings; the leading space anchors them at the word's start."""
    return [f" {word} ", *(f" {word[:n]}" for n in BEGINNINGS if len(word) >= n)]


def copy_key(words: list[str]) -> int:
    """Least hash of three words in a row: equal for most near copies."""
    return min((xxhash.xxh3_64_intdigest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))), default=0) >> 1


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -4.0
    slope: float = 10.0
    trained: bool = True
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for term, w in self.weights.items():
                a.add_word(term, (len(term), w))
            for phrase in self.exceptions:
                a.add_word(f" {folded(phrase).strip()} ", (len(folded(phrase).strip()) + 2, None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, text: str) -> list[tuple[int, float]]:
        """(start of the word, weight) of a folded text, the strongest term of each word, outside exceptions."""
        if not self.weights:
            return []
        best: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (n, w) in self.automaton().iter(text):
            start = end - n + 1
            if w is None:
                free.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        return [(s, w) for s, w in sorted(best.items()) if not any(a <= s < b for a, b in free)]

    def strength(self, text: str | None) -> float:
        """Sum of weights over the square root of the number of words."""
        f = folded(text)
        hits = self.hits(f)
        return sum(w for _, w in hits) / math.sqrt(len(f.split()) + 10) if hits else 0.0

    def score(self, strength: float) -> float:
        return 1 / (1 + math.exp(-max(min(self.bias + self.slope * strength, 500), -500))) if self.trained else 0.0


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, float]:
    """Bias and slope by Newton's method; both labels weigh the same."""
    w = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * len(y)
    design, beta = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        beta += np.clip(np.linalg.solve(hess, design.T @ (w * (y - p)) - ridge * beta), -2, 2)
    return float(beta[0]), float(beta[1])


def chosen(rows: list, n: dict[int, int], candidates: int) -> dict[str, float]:
    """Weights of the terms (term, harmless, toxic) whose likelihood ratio passes; a term says nothing new if a
    beginning of it is as strong."""
    share = n[1] / (n[0] + n[1])
    kept: dict[str, float] = {}
    for term, harmless, toxic in sorted(rows, key=lambda r: (len(r[0].strip()), r[0])):
        both = harmless + toxic
        ratio = sum(k * math.log(k / (both * q)) for k, q in ((toxic, share), (harmless, 1 - share)) if k)
        weight = math.log((toxic + 0.5) / (n[1] + 1)) - math.log((harmless + 0.5) / (n[0] + 1))
        if weight < 1.5 or ratio < math.log(candidates + 1) + 3:
            continue
        word = term.strip()
        if any(weight <= kept.get(f" {word[:k]}", -9.0) + 0.3 for k in BEGINNINGS if f" {word[:k]}" != term):
            continue
        kept[term] = weight
    return kept


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 5000, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon from documents and their labels (doc_id, toxic 0 or 1)."""
    marks = labels.filter(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Lexicon({}, exceptions, trained=False)
    share = F.when(F.col("toxic") == 1, min(1.0, sample_rows / counts[1])).otherwise(min(1.0, sample_rows / counts[0]))
    marks = marks.filter(F.pmod(F.xxhash64("l_id", F.lit("toxicity")), F.lit(1 << 30)) < share * (1 << 30))
    # the marks left are about twice sample_rows at most, whatever the size of either table, so texts need no shuffle
    rows = docs.join(F.broadcast(marks), F.col(id_col) == F.col("l_id")).select(F.col(text_col).cast("string").alias("text"), "toxic")

    def prepare(batches):
        for batch in batches:
            texts = [folded(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts), batch.column(1), pa.array([copy_key(t.split()) for t in texts], pa.int64())], ["text", "toxic", "key"])

    sample = cut(map_arrow(rows, prepare, "text string, toxic int, key long").dropDuplicates(["key", "toxic"]))
    counted = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = {k: counted.get(k, 0) for k in (0, 1)}
    if not n[0] or not n[1]:
        return Lexicon({}, exceptions, trained=False)

    def tally(pieces):
        def run(batches):
            found: dict[int, Counter] = {0: Counter(), 1: Counter()}

            def flush():
                out = [(t, c if k == 0 else 0, c if k == 1 else 0) for k in (0, 1) for t, c in found[k].items()]
                found[0].clear()
                found[1].clear()
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["term", "harmless", "toxic"])

            for batch in batches:
                for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found[toxic].update(pieces(text))
                    if len(found[0]) + len(found[1]) > 300_000:
                        yield flush()
            yield flush()

        parts = map_arrow(sample.select("text", "toxic"), run, "term string, harmless long, toxic long")
        return parts.groupBy("term").agg(F.sum("harmless").alias("harmless"), F.sum("toxic").alias("toxic"))

    terms = tally(lambda text: {t for w in set(text.split()) for t in terms_of(w)}).filter("toxic >= 3")
    # a term needs this many toxic rows at least to pass, so few rows come to the driver
    strong = terms.filter(F.col("toxic") > F.col("harmless") * (n[1] / n[0])).collect()
    weights = chosen([(r["term"], r["harmless"], r["toxic"]) for r in strong], n, len(strong))
    lexicon = Lexicon(weights, exceptions)

    def phrases(text: str) -> set[str]:
        out = set()
        for start, _ in lexicon.hits(text):
            end = text.find(" ", start + 1)
            word, before, after = text[start + 1 : end], text[:start].rsplit(None, 1)[-1:], text[end:].split(None, 1)[:1]
            out |= {f"{b} {word}" for b in before} | {f"{word} {a}" for a in after}
        return out

    if weights:
        harmless = tally(phrases).filter((F.col("harmless") >= 5) & (F.col("harmless") * n[1] > 4 * F.col("toxic") * n[0])).orderBy(F.desc("harmless"), "term")
        lexicon = Lexicon(weights, exceptions + tuple(r["term"] for r in harmless.collect()))

    def strengths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.strength(t) for t in batch.column(0).to_pylist()]), batch.column(1)], ["x", "toxic"])

    fitted = map_arrow(sample.select("text", "toxic"), strengths, "x double, toxic int").toPandas()
    lexicon.bias, lexicon.slope = logistic(fitted["x"].to_numpy(), fitted["toxic"].to_numpy())
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and the number of lexicon words met."""
    shipped = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most as many terms as the bounded sample can prove

    def run(batches):
        known = shipped.value
        for batch in batches:
            scores, counts = [], []
            for text in batch.column(1).to_pylist():
                f = folded(text)
                hits = known.hits(f)
                counts.append(len(hits))
                scores.append(known.score(sum(w for _, w in hits) / math.sqrt(len(f.split()) + 10) if hits else 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(counts, pa.int64())], ["doc_id", "score", "n_hits"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(source, run, f"doc_id {type_of(docs, id_col)}, score double, n_hits long")
