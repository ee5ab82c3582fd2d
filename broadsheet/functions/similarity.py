"""Sequence similarity of two titles; order of the arguments matters."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions import text

#: Bins that a title's characters, and its pairs of neighbouring characters, are counted in.
BINS, PAIR_BINS = 64, 256
#: SequenceMatcher starts no common stretch from a frequent character of a later text that is at least this long.
LONG = 200


def _score(floor: float, earlier: str, later: str) -> float:
    matcher = SequenceMatcher(None, earlier, later)
    # Two cheap upper bounds first: a pair below the floor needs no exact value.
    if matcher.real_quick_ratio() < floor or matcher.quick_ratio() < floor:
        return 0.0
    return matcher.ratio()


def ratio_at_least(floor: float):
    """Arrow-batched similarity; values under the floor come back as 0.

    Declared non-deterministic so that the optimizer evaluates it once per pair, after the cheap conditions,
    and never moves it into a join.
    """

    @F.pandas_udf(T.DoubleType())
    def ratio(earlier: pd.Series, later: pd.Series) -> pd.Series:
        return pd.Series([_score(floor, a, b) for a, b in zip(earlier, later)], dtype="float64")

    return ratio.asNondeterministic()


def letters(title_key: Column) -> Column:
    """Characters of a title counted in bins by their code."""
    bins = F.transform(F.regexp_extract_all(title_key, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.ascii(c) % BINS)
    return text.given(bins, lambda b: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: F.size(F.filter(b, lambda x: x == k))))


def in_common(a: Column, b: Column) -> Column:
    """At most so many characters of two titles can be matched with each other."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every text its length, characters and pairs by bin, and the most stretches it can share as the later text."""
    n = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    own = np.repeat(np.arange(len(texts)), n)
    one = np.bincount(own * BINS + codes % BINS, minlength=len(texts) * BINS).reshape(-1, BINS)
    inside = own[1:] == own[:-1]
    pair = ((codes[:-1] * 31 + codes[1:]) % PAIR_BINS)[inside]
    two = np.bincount(own[1:][inside] * PAIR_BINS + pair, minlength=len(texts) * PAIR_BINS).reshape(-1, PAIR_BINS)
    each, times = np.unique((own << 21) | codes, return_counts=True)
    rare = times <= (n // 100 + 1)[each >> 21]
    starts = np.bincount((each >> 21)[rare], weights=times[rare], minlength=len(texts))
    # a stretch starts from a rare character or at the beginning of what lies between two others
    stretches = np.where(n >= LONG, 2 * starts + 1, np.inf)
    return n, one.astype(np.float32), two.astype(np.float32), stretches


def possible(earlier: list[str], later: list[str], floor: float) -> list[np.ndarray]:
    """For every earlier text the places of the later ones whose similarity may reach the floor; all that do are among them.

    A similarity s of lengths a and b means s * (a + b) / 2 characters in common stretches. Stretches that touch are one,
    so there is at most one more of them than characters left over; a stretch of k characters holds k - 1 pairs.
    """
    a, one_a, two_a, _ = _counts(earlier)
    order = np.argsort(np.array([len(t) for t in later]), kind="stable")
    b, one_b, two_b, stretches = _counts([later[i] for i in order])
    lowest = np.searchsorted(b, a * (floor / (2 - floor)) - 1e-6, "left")
    highest = np.searchsorted(b, a * ((2 - floor) / floor) + 1e-6, "right")
    ones, pair_ones = np.ones(BINS, dtype=np.float32), np.ones(PAIR_BINS, dtype=np.float32)
    found = []
    for i, (low, high) in enumerate(zip(lowest, highest, strict=True)):
        total = a[i] + b[low:high]
        common = np.ceil(total * (floor / 2) - 1e-6)
        at = np.flatnonzero(np.minimum(one_b[low:high], one_a[i]) @ ones >= common)
        least = common[at] - np.minimum(total[at] - 2 * common[at] + 1, stretches[low:high][at])
        at = at[np.minimum(two_b[low:high][at], two_a[i]) @ pair_ones >= least]
        found.append(order[low + at])
    return found
