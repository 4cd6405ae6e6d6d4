"""Broadcast only what has been measured.

`broadcast_if_small` adds the hint only when both rows and bytes stay below the limits. Rows given by the driver are known
to; anything else is counted by one bounded job that stops one row past the limit, as the size of a file says
little about the rows in it. Above the limits the frame is returned as it is and the join shuffles, with AQE splitting hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.session import checkpoint_root, work_path

MAX_ROWS = 500_000
MAX_BYTES = 64 * 1024 * 1024


def _width(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 16
    if isinstance(field.dataType, T.ArrayType) and isinstance(
        field.dataType.elementType, (T.NumericType, T.BooleanType)
    ):
        return F.greatest(F.size(column), F.lit(0)).cast("long") * 8 + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.length(F.to_json(F.struct(column))), F.lit(0)).cast("long") * 2 + 16
    return F.lit(16).cast("long")


def measured_size(df: DataFrame, max_rows: int = MAX_ROWS) -> tuple[int, int]:
    """(rows, approximate bytes), both exact up to one row past `max_rows`."""
    total = sum((_width(f) for f in df.schema.fields[1:]), _width(df.schema.fields[0]))
    row = (
        df.limit(max_rows + 1)
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(total), F.lit(0)).alias("b"))
        .first()
    )
    return int(row["n"]), int(row["b"])


def _estimate(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


# Plan nodes that read data, or can return more of it than they read.
GROWING = ("Generate", "Join", "Expand", "Union", "Map", "LogicalRDD", "pandas_udf", "explode", "Relation [", "Relation[", "Range")
SURELY_SMALL = 2 * 1024 * 1024


def _known_small(df: DataFrame) -> bool:
    """Up to two megabytes of rows the driver itself has given, only projected, filtered or aggregated."""
    plan = df._jdf.queryExecution().analyzed().toString()
    leaves = plan.replace("LocalRelation", "")
    return "LocalRelation" in plan and not any(node in leaves for node in GROWING) and _estimate(df) <= SURELY_SMALL


def fits(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Whether the frame stays below both limits."""
    if max_rows >= MAX_ROWS and max_bytes >= MAX_BYTES and _known_small(df):
        return True
    rows, size = measured_size(df, max_rows)
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df


def settled(df: DataFrame) -> DataFrame:
    """The frame, computed once into the shared checkpoint folder; for short results with several uses."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like `settled`, for a long result: the rows are packed and compressed in the files, where a checkpoint's take several times the room."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def settled_broadcast(df: DataFrame) -> DataFrame:
    """Like `broadcast_if_small`, for a frame too costly to compute for the check and again for the join."""
    return broadcast_if_small(settled(df))


SPREAD_BYTES = 2 * 1024**3


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a small input for a CPU-heavy step; a small table often sits in a single split.

    Larger inputs are read in many splits anyway and are left where they are, without a shuffle.
    """
    return df.repartition(*keys) if _estimate(df) <= SPREAD_BYTES else df


@contextmanager
def _held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffled_over(spark: SparkSession, parts: int):
    """Jobs run inside shuffle over `parts` partitions, or the session's count if that is more; AQE joins small ones again.

    For stored results whose groups grow with the input, so that a task holds as many of them whatever the size of the input.
    """
    key = "spark.sql.shuffle.partitions"
    return _held(spark, key, str(max(int(spark.conf.get(key)), parts)))


def task_per_bucket(spark: SparkSession):
    """Jobs run inside read a bucketed table by a task per bucket, also where no join or sum asks for that."""
    return _held(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
