"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.session import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of the edges (a, b).

    Alternates the large-star and small-star steps: each joins the edges to the least neighbour of every node, which
    aggregation finds before the shuffle, so no neighbourhood is ever gathered. The number of rounds grows with the
    logarithm of the nodes. Ends when a round changes nothing.
    """
    pairs = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = cut(pairs), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        larger = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        joined = larger.join(least, "u")
        smaller = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        pairs = cut(smaller)
        row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        now = (row["n"], row["h"])
        if now == before:
            break
        before = now
    return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))
