"""Readers and writers for snapshots, fixtures, reports and versioned state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed


def write_snapshot(repos: DataFrame, path: str, fmt: str = "json") -> None:
    """Dated snapshot; rewriting a day replaces that day only."""
    (
        repos.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_day").format(fmt).save(path)
    )


def previous_snapshot(snapshots: DataFrame, today: Column) -> DataFrame:
    """Rows of the latest day before today; only partition values are read to find it."""
    earlier = snapshots.filter(F.col("snapshot_day") < today)
    last = earlier.agg(F.max("snapshot_day").alias("snapshot_day"))
    return earlier.join(F.broadcast(last), "snapshot_day", "left_semi")


def read_articles(spark: SparkSession, path: str, today: Column) -> DataFrame:
    """Article fixture; an empty publication date means today."""
    schema = "title string, url string, published string, source string, category string, summary string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return (
        rows.withColumn("published", F.coalesce(F.try_to_date(F.nullif("published", F.lit(""))), today))
        .withColumn("category", F.coalesce("category", F.lit(fixed.INDUSTRY)))
        .withColumn("summary", F.coalesce("summary", F.lit("")))
    )


def write_reputation(ratings: DataFrame, path: str) -> None:
    """Publisher ratings, best first."""
    ratings.orderBy(F.desc("authority"), F.desc("recognition"), "publisher_key").write.mode("overwrite").option(
        "header", True
    ).csv(path)


def write_json(rows: DataFrame, path: str, partition: str | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).json(path)


def write_version(table: DataFrame, root: str, version: int) -> None:
    """A full new version in its own folder; readers only follow versions that were completed and listed."""
    spark = table.sparkSession
    table.write.mode("overwrite").parquet(f"{root}/data/v{version:08d}")
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{root}/versions")


def current_version(spark: SparkSession, root: str) -> int | None:
    """Highest listed version; one number comes back, however large the table."""
    try:
        return spark.read.schema("version long").parquet(f"{root}/versions").agg(F.max("version")).first()[0]
    except Exception as exc:  # noqa: BLE001 - a table that was never written has no versions folder
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise


def read_version(spark: SparkSession, root: str, schema: str, version: int | None = None) -> DataFrame:
    """A version of a state table, the current one by default, empty before the first write."""
    number = current_version(spark, root) if version is None else version
    if number is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/data/v{number:08d}")
