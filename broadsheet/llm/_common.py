"""Helpers shared by the operators: shared folders, Arrow batches, held-out rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.session import checkpoint_dir

#: Rows of text that a Python worker holds at once.
BATCH_ROWS = 1000
#: Bits in a row of a map of keys (Spark's bitmaps), and in the largest map: 8 MB, whatever the number of keys.
ROW_BITS, MAP_BITS = 1 << 15, 1 << 26


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place, as a path that workers can open; they need it mounted (file: or a bare path)."""
    uri = urlparse(f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")
    if uri.scheme not in ("", "file"):
        raise RuntimeError(f"workers write and map plain files: mount {uri.scheme}:// and name the mount in spark.checkpoint.dir")
    return unquote(uri.path)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches small enough for very long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def marked(rows: DataFrame, column: str, keys: DataFrame, name: str) -> DataFrame:
    """Rows with a boolean: true wherever the column is among the keys (one column of the same type), and on few others.

    A bitmap of the keys' hashes, 16 bits or more for a key as long as it stays below MAP_BITS, travels to the rows, so
    that rows which are surely not among the keys need no shuffle. With more keys it only marks more rows in vain.
    """
    bits = min(max(ROW_BITS, 1 << (16 * keys.count()).bit_length()), MAP_BITS)

    def place(key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(bits).cast("long"))

    hashes = keys.filter(F.col(keys.columns[0]).isNotNull()).select(place(keys.columns[0]).alias("h"))
    part, held = f"part_{uuid.uuid4().hex}", f"held_{uuid.uuid4().hex}"
    maps = hashes.groupBy(F.expr(f"h div {ROW_BITS}").alias(part)).agg(F.bitmap_construct_agg(F.col("h") % ROW_BITS).alias(held))
    at = place(column) % ROW_BITS
    byte = F.conv(F.hex(F.substring(held, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(maps), F.floor(place(column) / ROW_BITS) == F.col(part), "left")
    return found.withColumn(name, F.coalesce((F.getbit(byte, (at % 8).cast("int")) == 1) & F.col(column).isNotNull(), F.lit(False))).drop(part, held)


def among(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose column is among the keys, and few others."""
    name = f"among_{uuid.uuid4().hex}"
    return marked(rows, column, keys, name).filter(name).drop(name)


def without(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose column is not among the keys; only those that the keys' bitmap marks are shuffled. A null is no key."""
    name, key = f"among_{uuid.uuid4().hex}", f"key_{uuid.uuid4().hex}"
    both = marked(rows, column, keys, name)
    left = both.filter(name).join(keys.select(F.col(keys.columns[0]).alias(key)), F.col(column) == F.col(key), "left_anti")
    return both.filter(~F.col(name)).unionByName(left).drop(name)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def fold_of(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo folds; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds
