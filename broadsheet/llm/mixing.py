"""Mixing sources to target weights with soft membership, in DataFrame functions only.

A labelled table teaches a classifier the domains: every text is measured in a few ways, each measure falls into a
bucket, and naive Bayes over the buckets gives a posterior for every domain. Non-negative rates are then fitted by
least squares so that the expected tokens of each domain (posterior x tokens x rate, summed over all
documents) come in the target shares. Documents in the same buckets have the same posterior and so the same rate: the
fit runs on one row per bucket combination, which one aggregation over the documents makes.

The fit is an accelerated projected gradient descent on the rates: each step moves a rate against the gradient, scaled by
what its posteriors' domains ask for (goal squared over supply, which makes the domains equally steep), and projects it
onto the bounds. The gradient with respect to a document is its posteriors' product with one number per domain, so a step
is one Spark aggregation whose row (a sum per domain, and the length of the projected step) comes to the driver, and the
whole descent is told by those few numbers: a row's rate is the fold of the steps over its posteriors, an expression
that needs no join and no table of rates. Momentum restarts when the misses grow. It starts from an even rate and ends
when every miss is small or the projected step vanishes; misses are left only where the bounds hold them.

The caller names the total as a multiple of the table's tokens. Without `max_rate` scarce domains are met by rates above
one. With it, a domain that holds less than its share of the total stays below its target, which `Fit.targets` says; if no
total is named, it is the largest at which every domain holds its share. `copies` takes each document floor(rate) times
and once more where a hash of its id falls below the rest.

Defined cases: a null or empty text has no tokens, the buckets of zero and rate as fitted; without labels all posteriors
are equal; a domain without labelled rows gets only the smoothing's share, one without tokens stays unmet and does not set the total; repeated rows count as often as they stand, a
document labelled more than once teaches once for each label row; null ids are never labelled; no rows give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.session import cut

#: Shares of all tokens wanted of the domains that `label_domain` names.
TARGETS = {"en": 0.63, "de": 0.13, "fr": 0.14, "es": 0.09, "junk": 0.01}


def label_domain(quality: Column, lang: Column) -> Column:
    """Domain of a labelled row: its language, or junk if it is rated bad; null where the rating is unknown."""
    return F.when(quality == 0, F.lit("junk")).when(quality == 1, lang)


@dataclass(frozen=True)
class Feature:
    """Bucket k of a measure holds values from edges[k-1] on and below edges[k]."""

    name: str
    value: Column
    edges: tuple[float, ...]

    def bucket(self) -> Column:
        return sum((F.when(self.value >= e, 1).otherwise(0) for e in self.edges), F.lit(0)).cast("int").alias(self.name)


def features() -> list[Feature]:
    n = F.greatest(F.col("tokens"), F.lit(1))
    chars = F.greatest(F.char_length("text"), F.lit(1))
    return [
        Feature("symbols", F.regexp_count("text", F.lit(r"[#*$%&|<>]")) / n, (0.02, 0.1, 0.3, 0.6)),
        Feature("capitals", F.regexp_count("text", F.lit(r"[A-Z]")) / chars, (0.02, 0.05, 0.1, 0.3, 0.5)),
        Feature("echoes", F.regexp_count("text", F.lit(r"(?<![^ \n])([^ \n]+) \1(?![^ \n])")) / n, (0.01, 0.03, 0.1, 0.3)),
        Feature("th_wh", F.regexp_count("text", F.lit(r"[TtWw]h")) / n, (0.02, 0.1, 0.2, 0.4)),
        Feature("umlauts", F.regexp_count("text", F.lit(r"[äöüßÄÖÜ]")) / n, (0.02, 0.1, 0.2, 0.4)),
        Feature("graves", F.regexp_count("text", F.lit(r"[èêçàùÈÊÇ]")) / n, (0.02, 0.1, 0.2, 0.4)),
        Feature("tildes", F.regexp_count("text", F.lit(r"[ñóíáúÑÓÍ]")) / n, (0.02, 0.1, 0.2, 0.4)),
        Feature("stops", F.regexp_count("text", F.lit(r"[.,] ")) / n, (0.02, 0.05, 0.08, 0.12, 0.2)),
        Feature("word_length", chars / n, (3.0, 5.0, 6.0, 7.0, 9.0)),
        Feature("size", F.log2(F.col("tokens") + 1), (3.0, 5.0, 7.0, 9.0, 11.0)),
    ]


def bucketed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tokens (words) and a bucket per measure."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
    return rows.select("doc_id", "tokens", *[f.bucket() for f in features()])


def bucket_counts(labelled: DataFrame) -> dict[tuple[str, int, int], int]:
    """Labelled rows by domain, measure and bucket: one aggregation, whose rows are domains x measures x buckets."""
    named = features()
    longs = labelled.select(
        "domain", F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f.name).alias("bucket")) for i, f in enumerate(named)])).alias("x")
    )
    return {(r["domain"], r["feature"], r["bucket"]): r["n"] for r in longs.groupBy("domain", "x.feature", "x.bucket").agg(F.count("*").alias("n")).collect()}


def posteriors(cells: DataFrame, counts: dict[tuple[str, int, int], int], domains: list[str], smoothing: float = 1.0) -> DataFrame:
    """Adds p, an array of posteriors in the order of the domains, to rows with buckets."""
    named = features()
    total = {d: sum(n for (e, i, _), n in counts.items() if e == d and i == 0) for d in domains}
    everything = sum(total.values())
    logs = []
    for d in domains:
        score = F.log(F.lit((total[d] + smoothing) / (everything + smoothing * len(domains))))
        for i, f in enumerate(named):
            size = len(f.edges) + 1
            table = F.array(*[F.log(F.lit((counts.get((d, i, b), 0) + smoothing) / (total[d] + smoothing * size))) for b in range(size)])
            score = score + F.get(table, F.col(f.name))
        logs.append(score)
    rows = cells.withColumn("logs", F.array(*logs))
    rows = rows.withColumn("e", F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))))
    sum_e = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("p", F.transform("e", lambda x: x / sum_e)).drop("logs", "e")


@dataclass(frozen=True)
class Target:
    """Expected tokens of a domain: what the table holds, what was wanted, what the rates give."""

    domain: str
    supply: float
    wanted: float
    reached: float
    met: bool


@dataclass(frozen=True)
class Descent:
    """Start, bounds, the domains' scaling and, per step, a number per domain and the momentum after it."""

    start: float
    bound: float
    ask: list[float] = field(default_factory=list)
    steps: list[tuple[list[float], float]] = field(default_factory=list)

    def pull(self, p: Column) -> Column:
        return sum((p[k] * F.lit(float(a)) for k, a in enumerate(self.ask)), F.lit(0.0))

    def fold(self, p: Column) -> Column:
        """The rate after all steps and the last projected step's length, of a row with posteriors p."""
        told = ", ".join(f"named_struct('u', array({', '.join(f'{float(v)!r}D' for v in u)}), 'beta', {float(beta)!r}D)" for u, beta in self.steps)
        table = F.expr(f"array({told})")
        n = len(self.ask)

        def step(acc: Column, x: Column) -> Column:
            against = sum((p[k] * x["u"][k] for k in range(n)), F.lit(0.0))
            raised = acc["ahead"] - acc["pull"] * against
            rate = F.least(F.greatest(raised, F.lit(0.0)), F.lit(float(self.bound)))
            return F.struct(
                rate.alias("rate"), (rate + x["beta"] * (rate - acc["rate"])).alias("ahead"), (rate - acc["ahead"]).alias("move"), acc["pull"].alias("pull")
            )

        first = F.lit(float(self.start))
        return F.aggregate(table, F.struct(first.alias("rate"), first.alias("ahead"), F.lit(0.0).alias("move"), self.pull(p).alias("pull")), step)

    def rate(self, p: Column) -> Column:
        return self.fold(p)["rate"] if self.steps else F.lit(float(self.start))


@dataclass(frozen=True)
class Fit:
    rates: DataFrame
    targets: list[Target]
    path: Descent


def fit_rates(cells: DataFrame, targets: dict[str, float], max_rate: float | None = 1.0, steps: int = 400, tolerance: float = 0.01, total: float | None = None) -> DataFrame:
    """Adds the rate to rows with p and tokens; minimises the squared relative misses of the domains' expected tokens."""
    return fitted(cells, targets, max_rate, steps, tolerance, total).rates


def fitted(cells: DataFrame, targets: dict[str, float], max_rate: float | None = 1.0, steps: int = 400, tolerance: float = 0.01, total: float | None = None) -> Fit:
    """The rates, and what they reach of each target. `total`: wanted tokens as a multiple of all tokens."""
    domains, bound = list(targets), math.inf if max_rate is None else float(max_rate)
    share = [targets[d] / sum(targets.values()) for d in domains]
    start = 1.0 if max_rate is None else bound

    def sums(weight: Column) -> list[float]:
        row = cells.agg(*[F.sum(F.col("p")[k] * weight).alias(f"s{k}") for k in range(len(domains))]).first()
        return [float(x or 0.0) for x in row]

    tokens = F.col("tokens").cast("double")
    supply = sums(tokens)
    whole = sum(supply)
    if total is not None:
        wanted = total * whole
    elif max_rate is None:
        wanted = whole
    else:
        wanted = min((bound * s / w for s, w in zip(supply, share, strict=True) if s > 0 and w > 0), default=0.0)
    goal = [wanted * w for w in share]
    path = _descent(cells, goal, [g if g > 0 else wanted for g in goal], supply, start, bound, steps, tolerance) if wanted > 0 else Descent(start, bound)
    cells = cells.withColumn("rate", path.rate(F.col("p")))
    got = sums(tokens * F.col("rate"))
    met = [abs(x - g) <= tolerance * (g if g > 0 else wanted) for x, g in zip(got, goal, strict=True)]
    return Fit(cells, [Target(*x) for x in zip(domains, supply, goal, got, met, strict=True)], path)


def _descent(cells: DataFrame, goal: list[float], scale: list[float], supply: list[float], start: float, bound: float, steps: int, tolerance: float) -> Descent:
    """Projected gradient steps that minimise the sum over domains of (misses / scale) squared."""
    n, g, s = len(goal), np.array(goal), np.array(scale)
    p, t = [F.col("p")[k] for k in range(n)], F.col("tokens").cast("double")
    pairs = [(k, j) for k in range(n) for j in range(k + 1)]
    # what a domain asks of its documents; one without tokens moves nothing
    own = np.array([float(x or 0.0) for x in cells.agg(*[F.sum(t * p[k] * p[k]) for k in range(n)]).first()])
    ask = np.where(own > 0, s**2 / np.maximum(own, 1e-300), 0.0)
    path = Descent(start, bound, ask.tolist(), [])
    pull = path.pull(F.col("p"))
    row = cells.agg(*[F.sum(t * pull * p[k] * p[j]) for k, j in pairs]).first()
    curve = np.zeros((n, n))
    for (k, j), x in zip(pairs, row, strict=True):
        curve[k, j] = curve[j, k] = float(x or 0.0) / (s[k] * s[j])
    steep = max(float(np.linalg.eigvalsh(curve)[-1]), 1e-300)
    here = there = np.array(supply) * start
    value, speed = math.inf, 1.0
    for _ in range(steps):
        path.steps.append((((there - g) / s**2 / steep).tolist(), 0.0))
        at = path.fold(F.col("p"))
        moves = cells.select("p", t.alias("tokens"), at.alias("x")).select("p", "tokens", F.col("x")["rate"].alias("rate"), F.col("x")["move"].alias("move"))
        row = moves.agg(F.sum(F.col("tokens") * F.abs("move")), F.sum("tokens"), *[F.sum(F.col("tokens") * p[k] * F.col("rate")) for k in range(n)]).first()
        new = np.array([float(x or 0.0) for x in row[2:]])
        misses = (new - g) / s
        if (np.abs(misses) <= tolerance / 10).all() or float(row[0]) <= tolerance * 1e-3 * float(row[1]) * max(start, float(g.sum()) / float(row[1])):
            return path
        if misses @ misses > value:
            beta, speed = 0.0, 1.0
        else:
            faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
            beta, speed = (speed - 1) / faster, faster
        path.steps[-1] = (path.steps[-1][0], beta)
        value, there, here = misses @ misses, new + beta * (new - here), new
    raise RuntimeError(f"mixing: the projected step did not vanish within {steps} steps")


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rate: float | None = 1.0,
    total: float | None = None,
) -> DataFrame:
    """One row per document: doc_id, tokens, p_<domain>, rate. `labels` has doc_id and domain (null: not labelled)."""
    return mixed(docs, labels, targets, id_col, text_col, max_rate, total).rates


def mixed(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rate: float | None = 1.0,
    total: float | None = None,
) -> Fit:
    """The rows of mix(), and what the rates reach of each target."""
    targets = targets or TARGETS
    domains = list(targets)
    names = [f.name for f in features()]
    rows = cut(bucketed(docs, id_col, text_col))
    known = labels.filter(F.col("domain").isin(domains)).select(F.col("doc_id").alias("l_id"), "domain")
    labelled = rows.join(known, F.col("doc_id") == F.col("l_id")).select("domain", *names)
    counts = bucket_counts(labelled)
    cells = posteriors(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")), counts, domains)
    fit = fitted(cut(cells), targets, max_rate, total=total)
    out = posteriors(rows, counts, domains).withColumn("rate", fit.path.rate(F.col("p")))
    # written down: a condition on the rate that the optimizer moved below would repeat the posteriors wherever they are named
    out = cut(out.select("doc_id", "tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(domains)], "rate"))
    return Fit(out, fit.targets, fit.path)


def copies(key: Column, rate: Column) -> Column:
    """How often a document is taken: floor(rate), and once more where its hash falls below the rest."""
    draw = F.pmod(F.xxhash64(key.cast("string"), F.lit("mixing")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


