"""Session defaults and the one place that decides where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "broadsheet") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a private one only when none is named."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if configured is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = context.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Write a step of an iterative job as a table in the shared folder and go on from the table.

    Unlike an RDD checkpoint the step is computed once, keeps its column statistics, and small steps are
    recognised as small, so later joins can broadcast them by measured size. A lost executor costs a
    re-read, never a recomputation of earlier rounds.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
