"""Sample tables mapped to the engine's inputs, once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import text, urls

EPOCH = "2024-01-01"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table, TEXT_KEYS[name]) if name in TEXT_KEYS else table


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def spread(table: DataFrame, key: str) -> DataFrame:
    """Give every core a share of a text table that arrives as fewer splits than there are cores.

    Text work is bound by the processor. A table of cluster size has more splits than cores and is read as is.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table


def raw_url(doc_id, source):
    n = doc_id.cast("string")
    decade = (doc_id - doc_id % 10).cast("string")
    k = doc_id % 10
    return (
        F.when(k == 0, F.concat(F.lit("https://www."), source, F.lit(".gov.cn/a/"), n, F.lit("?utm_source=feed")))
        .when(k == 1, F.concat(F.lit("https://arxiv.org/abs/"), n))
        .when(k == 3, F.concat(F.lit("https://www."), source, F.lit(".edu.cn/a/"), n))
        .when(k == 5, F.concat(F.lit("https://mp.weixin.qq.com/s/"), n))
        .when(k == 7, F.concat(F.lit("https://news.sohu.com/a/"), n, F.lit("#top")))
        .when(k == 9, F.concat(F.lit("http://m.stcn.com/news/"), n, F.lit(".html?id="), n, F.lit("&spm=x")))
        .when(k.isin(2, 8), F.concat(F.lit("https://wire.example.org/a/"), decade))
        .otherwise(F.concat(F.lit("https://"), source, F.lit(".example.org/a/"), n))
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    category = F.array(*[F.lit(c) for c in fixed.CATEGORIES])
    day = F.date_add(F.to_date(F.lit(EPOCH)), (F.col("doc_id") % 40).cast("int"))
    return docs.select(
        "doc_id",
        lines[0].alias("title"),
        F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("summary"),
        F.col("text").alias("body"),
        "source",
        F.col("lang").alias("profile_id"),
        urls.canonical(raw_url(F.col("doc_id"), F.col("source"))).alias("url"),
        F.when(F.col("doc_id") % 19 != 5, day).alias("published"),
        day.alias("seen_day"),
        F.element_at(category, (F.col("doc_id") % 4 + 1).cast("int")).alias("category"),
    )


ARTICLES = """articles AS (
  SELECT doc_id, split_part(text, chr(10), 1) AS title, split_part(text, chr(10), 2) AS summary, text AS body,
         source, lang AS profile_id,
         CASE doc_id % 10
           WHEN 0 THEN 'https://www.' || source || '.gov.cn/a/' || doc_id
           WHEN 1 THEN 'https://arxiv.org/abs/' || doc_id
           WHEN 3 THEN 'https://www.' || source || '.edu.cn/a/' || doc_id
           WHEN 5 THEN 'https://mp.weixin.qq.com/s/' || doc_id
           WHEN 7 THEN 'https://news.sohu.com/a/' || doc_id
           WHEN 9 THEN 'http://m.stcn.com/news/' || doc_id || '.html?id=' || doc_id
           WHEN 2 THEN 'https://wire.example.org/a/' || (doc_id - doc_id % 10)
           WHEN 8 THEN 'https://wire.example.org/a/' || (doc_id - doc_id % 10)
           ELSE 'https://' || source || '.example.org/a/' || doc_id END AS url,
         CASE WHEN doc_id % 19 <> 5 THEN DATE '2024-01-01' + (doc_id % 40)::INT END AS published,
         DATE '2024-01-01' + (doc_id % 40)::INT AS seen_day,
         ['行业', '资本', '政策', '学术'][doc_id % 4 + 1] AS category
  FROM documents)"""

HOST = "regexp_extract({0}, '^[a-z]+://([^/?#:]*)', 1)"


def sql_host(column: str) -> str:
    return HOST.format(column)


def sql_title_key(column: str) -> str:
    return f"regexp_replace(replace(lower({column}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


def sql_normal(column: str) -> str:
    return f"trim(regexp_replace(lower({column}), '[^a-z0-9一-鿿]+', ' ', 'g'))"


def first_word(title):
    """First word of three letters or more: stands in for the company an assessor would name."""
    return F.regexp_extract(title, r"(\p{L}{3,})", 1)


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels read as assessor decisions, keyed by document."""
    labels = load(spark, sf_dir, "labels")
    kinds = F.array(*[F.lit(k) for k in fixed.SOURCE_KINDS])
    doc = F.col("doc_id")
    return labels.select(
        "doc_id",
        F.when(F.col("quality") == 1, 60 + doc % 41).otherwise(doc % 60).cast("int").alias("relevance"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("accept"),
        F.element_at(kinds, (doc % 7 % 4 + 1).cast("int")).alias("source_kind"),
    )


ASSESSMENTS = """assessments AS (
  SELECT doc_id, (CASE WHEN quality = 1 THEN 60 + doc_id % 41 ELSE doc_id % 60 END)::INT AS relevance,
         quality = 1 AND toxic = 0 AS accept,
         ['original', 'media', 'secondary', 'unknown'][doc_id % 7 % 4 + 1] AS source_kind
  FROM labels)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as sightings of an item by the collector."""
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"),
        F.to_date("ts").alias("day"),
        "ts",
        "event_id",
        F.col("event_type").alias("status"),
        "value",
    )


OBSERVATIONS = """observations AS (
  SELECT user_id AS item_id, ts::DATE AS day, ts, event_id, event_type AS status, value FROM events)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
