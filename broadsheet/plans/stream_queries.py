"""Streaming forms of the state jobs, fed by the event file as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from broadsheet.plans.registry import query
from broadsheet.plans.state_queries import SIGHTINGS
from broadsheet.plans.tables import OBSERVATIONS, load, with_sql
from broadsheet.session import checkpoint_dir
from broadsheet.sources import tables
from broadsheet.streaming import state


def event_stream(spark, sf_dir):
    schema = load(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    doc, day = F.col("event_id"), F.to_date("ts")
    return rows.select(
        F.col("user_id").cast("string").alias("id"), doc.alias("seq"), day.alias("day"),
        F.when(doc % 3 == 0, F.date_sub(day, (doc % 50).cast("int"))).alias("published"),
        F.when(doc % 3 == 0, F.lit("listing")).when(doc % 3 == 1, F.lit("no_date_hint")).otherwise(F.lit("hint_unparsed")).alias("date_evidence"),
        F.when(doc % 5 == 0, day).alias("first_reported"),
        F.concat("event_type", F.lit(" "), F.repeat(F.lit("x"), (doc % 17).cast("int"))).alias("summary"),
        F.when(doc % 4 == 0, F.concat(F.lit("excerpt "), doc.cast("string"))).otherwise(F.lit("")).alias("excerpt"),
        F.when(doc % 97 == 0, day).alias("released"),
    )


def _run_folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("stream_first_seen", with_sql(OBSERVATIONS) + "SELECT item_id::VARCHAR AS id, min(day) AS first_seen FROM observations GROUP BY 1")
def stream_first_seen(spark, sf_dir):
    folder = _run_folder(spark)
    state.first_seen_stream(event_stream(spark, sf_dir), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return state.first_seen_table(spark, f"{folder}/log")


@query("stream_candidates", with_sql(OBSERVATIONS, SIGHTINGS) + "SELECT * FROM candidates")
def stream_candidates(spark, sf_dir):
    folder = _run_folder(spark)
    state.candidate_stream(event_stream(spark, sf_dir), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return tables.read_version(spark, f"{folder}/table", state.CANDIDATES).drop("seq")


@query(
    "stream_retained",
    with_sql(OBSERVATIONS, SIGHTINGS.replace("FROM observations)", "FROM observations WHERE event_id % 3 <> 0 OR event_id % 50 < 30)"))
    + "SELECT id, first_seen, last_seen, published FROM candidates",
)
def stream_retained(spark, sf_dir):
    folder = _run_folder(spark)
    state.retained_stream(event_stream(spark, sf_dir), f"{folder}/table", f"{folder}/checkpoint", 30).awaitTermination()
    return tables.read_version(spark, f"{folder}/table", state.CANDIDATES).select("id", "first_seen", "last_seen", "published")


_THIRDS = """thirds AS (SELECT *, ntile(3) OVER (ORDER BY day) AS part FROM (SELECT DISTINCT day FROM observations)),
  ends AS (SELECT part, max(day) AS last FROM thirds GROUP BY part),
  firsts AS (SELECT item_id, min(day) FILTER (WHERE part = 1) AS f1, min(day) FILTER (WHERE part = 2) AS f2, min(day) FILTER (WHERE part = 3) AS f3, max(day) AS last_seen
    FROM observations JOIN thirds USING (day) GROUP BY item_id),
  one AS (SELECT *, CASE WHEN f1 + 10 > (SELECT last FROM ends WHERE part = 1) - 1 THEN f1 END AS s1 FROM firsts),
  two AS (SELECT *, coalesce(s1, f2) AS g2, CASE WHEN coalesce(s1, f2) + 10 > (SELECT last FROM ends WHERE part = 2) - 1 THEN coalesce(s1, f2) END AS s2 FROM one),
  three AS (SELECT *, CASE WHEN coalesce(s2, f3) + 10 > (SELECT last FROM ends WHERE part = 3) - 1 THEN coalesce(s2, f3) END AS s3 FROM two)"""


@query(
    "stream_expiring",
    with_sql(OBSERVATIONS, _THIRDS) + "SELECT item_id::VARCHAR AS id, s3 AS first_seen, last_seen FROM three WHERE s3 IS NOT NULL AND item_id % 11 <> 0",
)
def stream_expiring(spark, sf_dir):
    """Undated sightings in three deliveries with a restart after each; candidates expire, and some are removed between the first two."""
    folder = _run_folder(spark)
    rows = load(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), F.to_date("ts").alias("day"), F.col("event_type").alias("summary")
    )
    # the days in thirds; there are few days
    parts = rows.select("day").distinct().withColumn("part", F.ntile(3).over(Window.orderBy("day")))
    rows = rows.join(parts, "day")
    middle = rows.filter("part = 2").agg(F.min("day").alias("day"))
    removed = rows.filter("cast(id as long) % 11 = 0").select("id").distinct().join(F.broadcast(middle))
    empty = {"published": F.lit(None).cast("date"), "first_reported": F.lit(None).cast("date"), "released": F.lit(None).cast("date"), "date_evidence": F.lit("no_date_hint"), "excerpt": F.lit("")}
    seen = rows.withColumns(empty)
    removed.limit(0).write.parquet(f"{folder}/graves/none")
    for part in (1, 2, 3):
        seen.filter(F.col("part") == part).drop("part").write.parquet(f"{folder}/seen/{part}")
        if part == 2:
            removed.write.parquet(f"{folder}/graves/{part}")
        observed = spark.readStream.schema(seen.drop("part").schema).option("recursiveFileLookup", True).parquet(f"{folder}/seen")
        graves = spark.readStream.schema(removed.schema).option("recursiveFileLookup", True).parquet(f"{folder}/graves")
        state.logged(state.expiring_candidates(observed, graves, 10), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return state.candidate_table(spark, f"{folder}/log").select("id", "first_seen", "last_seen")
