"""Stored tables: build once, reuse later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        table = spark.read.parquet(path)
    except AnalysisException:
        return None
    return table if table.limit(1).count() else None


def ensure_table(spark: SparkSession, path: str, build: Callable[[], DataFrame], recreate: bool = False) -> tuple[DataFrame, bool]:
    """(table, reused): the stored table when it exists and has rows, else built, written and read back."""
    if not recreate:
        found = _stored(spark, path)
        if found is not None:
            return found, True
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), False


def ensure_graph(spark: SparkSession, path: str, build: Callable[[], tuple[DataFrame, DataFrame]],
                 recreate: bool = False) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes, edges, reused): the stored graph, or one built by `build` and saved."""
    if not recreate:
        nodes, edges = _stored(spark, f"{path}/nodes"), _stored(spark, f"{path}/edges")
        if nodes is not None and edges is not None:
            return nodes, edges, True
    nodes, edges = build()
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), False


def scalarise_metadata(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """The metadata struct as MAP<STRING,STRING>: scalars as text, nested values as JSON; nulls are kept."""
    fields = df.schema[metadata].dataType.fields
    pairs = []
    for field in fields:
        value = F.col(f"{metadata}.{field.name}")
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        pairs += [F.lit(field.name), F.to_json(value) if nested else value.cast("string")]
    return df.withColumn(metadata, F.create_map(*pairs))


def clear_table(spark: SparkSession, path: str) -> None:
    """Empty a stored table, keeping its schema; the next `ensure_table` builds it anew."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
