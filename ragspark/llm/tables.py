"""Small helpers the operators share: sizes of inputs, placing by measured size, numbering rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions.sizing import broadcast_if_small
from ragspark.session import checkpoint_root, work_path

SHARD_BYTES = 32 << 20  # text behind one shard of a packed exchange


def settle(df: DataFrame) -> DataFrame:
    """The frame, computed once into the folder that spark.checkpoint.dir names."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def text_shards(docs: DataFrame, least: int = 12, per_shard: int = SHARD_BYTES) -> int:
    """A number of shards in proportion to the bytes of all texts, so that a shard stays the same size as the input grows."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"]
    return max(least, int(total or 0) // per_shard)


def small_side(df: DataFrame) -> DataFrame:
    """The frame settled, and hinted for a broadcast only if its measured size allows it; else the join shuffles."""
    return broadcast_if_small(settle(df))


def numbered(df: DataFrame, groups: list[str], order: list[Column], bucket: Column, number: str) -> DataFrame:
    """Gapless numbers from 0 inside each group, counted bucket by bucket.

    `bucket` cuts the rows into pieces of bounded size whose order is the order of the result. Buckets are numbered in
    parallel; only their sizes, a row per group and bucket, are summed along a group.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*groups, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    placed = rows.withColumn("_at", F.row_number().over(inside) - 1)
    same = [placed[c].eqNullSafe(starts[c]) for c in [*groups, "_bucket"]]
    return placed.join(starts, same).select(
        *[placed[c] for c in df.columns], (F.col("_start") + F.col("_at")).cast("long").alias(number))


def work_table(df: DataFrame) -> DataFrame:
    """The frame written as Parquet into the shared folder and read again."""
    path = work_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_work_table(table: DataFrame) -> None:
    """Delete the files of a frame that `work_table` returned; nothing may read it any more."""
    spark = table.sparkSession
    folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
    for folder in folders:
        if "/ragspark/stage-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
