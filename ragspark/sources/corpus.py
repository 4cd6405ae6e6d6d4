"""Corpus files to document rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions.sizing import broadcast_if_small
from ragspark.functions.text import char_count, clean_text, line_count
from ragspark.lexicons import CLASS_NAMES

SUFFIXES = (".txt", ".md", ".json")


def _stem(path: Column) -> Column:
    name = F.regexp_extract(F.url_decode(path), r"([^/]+)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Whole text and markdown files: (doc_id, path, suffix, content), doc_id being the file stem."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    return files.select(
        _stem(where).alias("doc_id"),
        where.alias("path"),
        F.lower(F.regexp_extract(where, r"(\.[^./]+)$", 1)).alias("suffix"),
        F.col("value").alias("content"),
    )


def read_json_docs(spark: SparkSession, path: str) -> DataFrame:
    """JSON files, one object each: (doc_id, path, content); a missing content is the empty text."""
    files = spark.read.schema("content STRING").option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    where = F.col("_metadata.file_path")
    return files.select(_stem(where).alias("doc_id"), where.alias("path"), F.coalesce("content", F.lit("")).alias("content"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every file; the bytes are not read, because the column is pruned."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def join_manifest(files: DataFrame, manifest: DataFrame, key: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """Files the manifest names, and manifest rows without a file."""
    small = broadcast_if_small(manifest)
    return files.join(small, key), manifest.join(files.select(key), key, "left_anti")


def route_by_format(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Accepted files with their suffix, and the quarantined rest."""
    tagged = files.withColumn("suffix", F.regexp_extract(path, r"(\.[^./]+)$", 1))
    ok = F.col("suffix").isin(list(SUFFIXES))
    return tagged.where(ok), tagged.where(~ok)


def document_rows(raw: DataFrame, names: dict[str, str] = CLASS_NAMES) -> DataFrame:
    """(doc_id, content, metadata) with cleaned text and its counts."""
    cleaned = raw.select("doc_id", clean_text(F.col("content")).alias("content"))
    pairs = [F.lit(x) for item in names.items() for x in item]
    return cleaned.select(
        "doc_id",
        "content",
        F.struct(
            F.col("doc_id").alias("craft_id"),
            char_count(F.col("content")).alias("char_count"),
            line_count(F.col("content")).alias("line_count"),
            F.coalesce(F.element_at(F.create_map(*pairs), F.col("doc_id")), F.col("doc_id")).alias("craft_name"),
        ).alias("metadata"),
    )


def lookup_or_self(df: DataFrame, dim: DataFrame, key: str, name: str = "name") -> DataFrame:
    """Adds `name` of the key from a dimension, the key itself when unknown."""
    small = dim.select(F.col("key").alias(key), F.col("name").alias("_n"))
    return df.join(broadcast_if_small(small), key, "left").withColumn(name, F.coalesce("_n", key)).drop("_n")


def tag_keywords(docs: DataFrame, lexicon: DataFrame, content: str = "content", klass: str = "class") -> DataFrame:
    """Adds `keywords`: the terms of the document's own class that occur in it, in lexicon order.

    The lexicon (class, ord, keyword) becomes one short array per class, so documents are not multiplied.
    """
    terms = lexicon.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("ord", "keyword"))).alias("_t"))
    terms = terms.select(F.col("class").alias(klass), F.col("_t.keyword").alias("_t"))
    found = F.filter(F.coalesce("_t", F.array().cast("array<string>")), lambda t: F.contains(F.col(content), t))
    return docs.join(broadcast_if_small(terms), klass, "left").withColumn("keywords", found).drop("_t")
