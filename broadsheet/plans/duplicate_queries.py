"""Duplicate reports over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions import text
from broadsheet.operators import duplicates
from broadsheet.plans.registry import query
from broadsheet.plans.tables import ARTICLES, articles, sql_title_key, with_sql


def reports(spark, sf_dir):
    """Documents in arrival order, each naming its own address as source."""
    return articles(spark, sf_dir).select(
        F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"), "title", "url", "source", "category",
        "published", F.lit(None).cast("date").alias("first_reported"), "summary", "body", F.array("url").alias("source_urls"),
    )


@query(
    "exact_duplicates",
    with_sql(ARTICLES)
    + f"""SELECT 'title' AS kind, sha256({sql_title_key("title")}) AS k, count(*) AS n, min(doc_id) AS first_doc FROM articles GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'url', sha256(url), count(*), min(doc_id) FROM articles GROUP BY ALL HAVING count(*) > 1""",
)
def exact_duplicates(spark, sf_dir):
    """Groups sharing a title key or an address, as counts rather than pairs."""
    rows = reports(spark, sf_dir)
    keys = rows.select("pos", F.explode(F.array(
        F.struct(F.lit("title").alias("kind"), text.digest(text.title_key(F.col("title"))).alias("k")),
        F.struct(F.lit("url").alias("kind"), text.digest(F.col("url")).alias("k")),
    )).alias("x")).select("pos", "x.*")
    return keys.groupBy("kind", "k").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_doc")).filter("n > 1")


@query("report_assignments")
def report_assignments(spark, sf_dir):
    return duplicates.assign_representatives(reports(spark, sf_dir))


@query("merged_articles")
def merged_articles(spark, sf_dir):
    rows = reports(spark, sf_dir)
    assigned = duplicates.assign_representatives(rows)
    merged = duplicates.merge(rows, assigned)
    sources = duplicates.merged_sources(rows, assigned).groupBy("rep").agg(F.count(F.lit(1)).alias("n_sources"))
    return merged.join(sources, "rep").select(
        "rep", "id", "title", "url", "category", "published", "first_reported", F.length("summary").alias("summary_length"),
        F.length("body").alias("body_length"), "members", "n_sources",
    )
