"""From `documents` to training sequences, in five stages.

quality   documents that the quality rules reject go
near      one document of each group of near-duplicates stays, the one of smallest doc_id
repeats   passages that repeat earlier text are cut out of the texts
mix       documents are dropped or repeated until the sources meet their target weights
pack      texts become token sequences

Every stage takes the documents its predecessor kept and returns them with the same columns; the last returns the packed pieces.
Every row is judged by itself, whatever its doc_id: a stage gives every row a key of its own, runs its operator on the keys and
joins the results by them. Rows read from Parquet files have a lasting key, their file and place in it, so texts are written only at the end
of a stage; rows of any other frame are written with keys first. Where the smallest doc_id decides, rows come in order of (doc_id, key),
those without doc_id last.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions.ranking import rank_rows
from ragspark.llm.jaccard import jaccard_groups
from ragspark.llm.mixing import mix_sources
from ragspark.llm.packing import pack_documents
from ragspark.llm.quality import judge_quality
from ragspark.llm.queries import tokenizer_file
from ragspark.llm.repeats import remove_repeats
from ragspark.llm.tables import drop_work_table, settle, small_side, work_table


KEY = "_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own, which stays with its row however often the rows are computed."""
    try:
        located = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        files = located.select("_file").distinct()
    except AnalysisException:  # no file scan, or none with row numbers
        return work_table(docs.withColumn(KEY, F.monotonically_increasing_id()))
    numbered = settle(rank_rows(files, [], [F.col("_file").asc()], "_n"))
    key = F.shiftleft(F.col("_n"), 40) + F.col("_row")
    return located.join(small_side(numbered), "_file").withColumn(KEY, key).select(*docs.columns, KEY)


def _as_ids(rows: DataFrame, key: str = KEY) -> DataFrame:
    """The rows with their keys for doc_ids."""
    return rows.drop("doc_id").withColumnRenamed(key, "doc_id")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows but those with the keys in `gone`."""
    return rows.join(small_side(gone), KEY, "left_anti").drop(KEY)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    gone = judge_quality(_as_ids(rows)).where("NOT kept")
    return _without(rows, gone.select(F.col("doc_id").alias(KEY))).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    groups = jaccard_groups(_as_ids(rows)).where("component_id <> doc_id OR n_links > 0").select(F.col("doc_id").alias(KEY), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", KEY)
    members = settle(rows.select("doc_id", KEY).join(small_side(groups), KEY).select("component_id", place.alias("place")))
    first = members.groupBy("component_id").agg(F.min("place").alias("first"))
    gone = members.join(small_side(first), "component_id").where(F.col(f"place.{KEY}") != F.col(f"first.{KEY}"))
    return _without(rows, gone.select(f"place.{KEY}")).select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    places = rank_rows(rows.select("doc_id", KEY), [], [F.col("doc_id").asc_nulls_last(), F.col(KEY).asc()], "_place")
    placed = rows.join(small_side(places.select(KEY, "_place")), KEY).drop(KEY)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    found = remove_repeats(_as_ids(placed.withColumn("_id", F.col("doc_id")), "_place"))
    found = found.withColumn("text", text).withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")))
    found = found.drop("doc_id").withColumnRenamed("_id", "doc_id")
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in docs.schema.fields])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    copies = mix_sources(rows, row=KEY).where("copies > 0").select(KEY, F.col("copies").alias("_copies"))
    taken = rows.join(small_side(copies), KEY)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_file())


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near), ("substring dedup", repeats), ("mixing", mix), ("packing", pack)]

# Token ids and the distance histograms have no SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = work_table(stage(spark, docs, sf_dir))
        if before is not None:
            drop_work_table(before)  # its successor is written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
