"""Upload ingest as a stream.

Uploads arrive as files of rows (doc_id, content_type, content, uploaded_at). Each micro-batch is written
as its own folder of the version store, keyed by the batch id, so a batch that is replayed after a failure
replaces its own output and nothing else. Readers take the newest version of each document. `compact` stores these for
all batches landed so far; from then on only later batches are aggregated, and the compacted rows are read where they lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragspark.functions.sizing import broadcast_if_small, settled
from ragspark.lexicons import UPLOAD_TYPES
from ragspark.operators.lexical import postings_of, token_rows

UPLOAD_SCHEMA = "doc_id STRING, content_type STRING, content STRING, uploaded_at TIMESTAMP"
VERSION_SCHEMA = f"{UPLOAD_SCHEMA}, batch_id BIGINT"
POSTING_SCHEMA = "doc_id STRING, doc_len BIGINT, term STRING, tf BIGINT, batch_id BIGINT"
LANDED = "batch_id BIGINT"


def read_uploads(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(UPLOAD_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def split_uploads(batch: DataFrame, allowed: Sequence[str] = UPLOAD_TYPES) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(F.col("content_type").isin(list(allowed)), F.lit(False))
    return batch.where(ok), batch.where(~ok)


def newest(rows: DataFrame, *order: str) -> DataFrame:
    """The last upload of each id; repeats are reduced map-side, so a hot id is no hot task."""
    fields = F.struct(*[c for c in rows.columns if c != "doc_id"])
    # The content closes the order, so equal times still give one fixed answer.
    return rows.groupBy("doc_id").agg(F.max_by(fields, F.struct(*order, "content")).alias("_v")).select("doc_id", "_v.*")


def ingest_uploads(stream: DataFrame, store: str, checkpoint: str, with_postings: bool = True) -> StreamingQuery:
    """Run the available uploads into `store`: versions/, quarantine/ and, per batch, postings/."""

    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        good, bad = split_uploads(batch)
        latest = newest(good, "uploaded_at").withColumn("batch_id", F.lit(batch_id).cast("long"))
        latest.write.mode("overwrite").parquet(f"{store}/versions/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{store}/quarantine/batch={batch_id}")
        if with_postings:
            written = spark.read.schema(VERSION_SCHEMA).parquet(f"{store}/versions/batch={batch_id}")
            postings = postings_of(token_rows(written)).withColumn("batch_id", F.lit(batch_id).cast("long"))
            postings.write.mode("overwrite").parquet(f"{store}/postings/batch={batch_id}")
        # Written last: a batch without this row is not yet compacted.
        spark.createDataFrame([(batch_id,)], LANDED).coalesce(1).write.mode("overwrite").parquet(f"{store}/landed/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _batches(spark: SparkSession, path: str, schema: str, after: int, upto: int | None) -> DataFrame:
    """Rows of the batches in (after, upto]; the folders of others are not opened."""
    try:
        rows = spark.read.schema(f"{schema}, batch BIGINT").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    kept = rows.where(F.col("batch") > after) if upto is None else rows.where((F.col("batch") > after) & (F.col("batch") <= upto))
    return kept.drop("batch")


def compacted_upto(spark: SparkSession, store: str) -> int:
    """The last batch of the newest compaction, -1 without one."""
    return _read(spark, f"{store}/compactions", LANDED).agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]


def _winners(spark: SparkSession, store: str, done: int, upto: int | None) -> tuple[DataFrame, DataFrame]:
    """(base, winners): the compacted documents, and (doc_id, batch_id) of documents whose newest version came after the compaction."""
    base = _read(spark, f"{store}/compacted/upto={done}/documents", VERSION_SCHEMA)
    versions = _batches(spark, f"{store}/versions", VERSION_SCHEMA, done, upto)
    # Only the small columns are compared; a batch holds a document once, so the pair is a key.
    last = versions.groupBy("doc_id").agg(F.max(F.struct("uploaded_at", "batch_id")).alias("_l"))
    if done < 0:
        return base, last.select("doc_id", F.col("_l.batch_id").alias("batch_id"))
    last = settled(last)
    before = base.select(F.col("doc_id").alias("_id"), F.struct("uploaded_at", "batch_id").alias("_before")).join(
        broadcast_if_small(last.select(F.col("doc_id").alias("_id"))), "_id", "left_semi")
    newer = last.join(before, F.col("doc_id") == F.col("_id"), "left")
    return base, settled(newer.where(F.col("_before").isNull() | (F.col("_l") > F.col("_before"))).select("doc_id", F.col("_l.batch_id").alias("batch_id")))


def current_documents(spark: SparkSession, store: str, upto: int | None = None) -> DataFrame:
    """The newest version of every document (of batches up to `upto`). Uploads without an id are no versions of each other and are left out."""
    done = compacted_upto(spark, store)
    base, winners = _winners(spark, store, done, upto)
    versions = _batches(spark, f"{store}/versions", VERSION_SCHEMA, done, upto)
    if done < 0:
        return versions.join(winners, ["doc_id", "batch_id"], "left_semi")
    winners = broadcast_if_small(winners)
    return base.join(winners, "doc_id", "left_anti").unionByName(versions.join(winners, ["doc_id", "batch_id"], "left_semi"))


def compact(spark: SparkSession, store: str) -> int:
    """Store the newest versions, and their postings, of all batches landed so far; returns the last of these batches.

    Readers see the compaction when its row is written, at the end. Nothing is deleted; a replayed batch that is compacted already changes nothing.
    """
    upto = _read(spark, f"{store}/landed", LANDED).agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]
    if upto > compacted_upto(spark, store):
        folder = f"{store}/compacted/upto={upto}"
        current_documents(spark, store, upto).write.mode("overwrite").parquet(f"{folder}/documents")
        current_postings(spark, store, upto).write.mode("overwrite").parquet(f"{folder}/postings")
        spark.createDataFrame([(upto,)], LANDED).coalesce(1).write.mode("overwrite").parquet(f"{store}/compactions/upto={upto}")
    return upto


def quarantined(spark: SparkSession, store: str) -> DataFrame:
    return _read(spark, f"{store}/quarantine", UPLOAD_SCHEMA)


def current_postings(spark: SparkSession, store: str, upto: int | None = None) -> DataFrame:
    """Postings of the newest versions only; statistics are re-aggregated from these counts."""
    done = compacted_upto(spark, store)
    _, winners = _winners(spark, store, done, upto)
    later = _batches(spark, f"{store}/postings", POSTING_SCHEMA, done, upto)
    if done < 0:
        return later.join(winners, ["doc_id", "batch_id"], "left_semi").drop("batch_id")
    winners = broadcast_if_small(winners)
    base = _read(spark, f"{store}/compacted/upto={done}/postings", POSTING_SCHEMA.rsplit(",", 1)[0])
    return base.join(winners, "doc_id", "left_anti").unionByName(later.join(winners, ["doc_id", "batch_id"], "left_semi").drop("batch_id"))
