"""Corpus and index maintenance, and statistics about both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions.sizing import broadcast_if_small, settled
from ragspark.operators.filters import all_documents
from ragspark.operators.lexical import Bm25Index, document_frequency, lengths_of, postings_of, statistics_of_counts, term_caps, token_rows


def upsert_docs(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Rows of `delta` replace rows of `base` with the same doc_id."""
    kept = base.join(broadcast_if_small(delta.select("doc_id")), "doc_id", "left_anti")
    return kept.unionByName(delta)


# Fixed value: only the first existing form of a document is deleted, in this order.
SUFFIX_ORDER = (".txt", ".md", ".json")


def delete_docs(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Files (doc_id, suffix, ...) that remain: per deleted id only its first suffix in order goes."""
    order = F.array_position(F.array(*[F.lit(s) for s in SUFFIX_ORDER]), F.col("suffix"))
    doomed = (
        files.join(broadcast_if_small(ids.select("doc_id").distinct()), "doc_id", "left_semi")
        .where(order > 0)
        .groupBy("doc_id")
        .agg(F.min_by("suffix", order).alias("suffix"))
    )
    return files.join(broadcast_if_small(doomed), ["doc_id", "suffix"], "left_anti")


def docs_by_id(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(broadcast_if_small(ids.select("doc_id").distinct()), "doc_id", "left_semi")


def docs_by_type(docs: DataFrame, mapping: DataFrame, types: DataFrame, key: str = "doc_id") -> DataFrame:
    """(type, doc_id, n_docs): documents mapped to each asked type; a type the mapping lacks returns all documents,
    as one row with a null doc_id whose n_docs counts them."""
    asked = types.select("type").distinct()
    known = mapping.join(broadcast_if_small(asked), "type", "left_semi").select("type", key)
    found = docs.join(broadcast_if_small(known), key).select("type", "doc_id", F.lit(1).cast("long").alias("n_docs"))
    missing = asked.join(mapping.select("type").distinct(), "type", "left_anti")
    return found.unionByName(all_documents(missing, docs))


def index_add(index: Bm25Index, delta: DataFrame, text: str = "content", mode: str = "mixed") -> Bm25Index:
    """Add only documents whose id is not indexed. Statistics are sums of the old counts and those of the added rows.

    For an index that changes often, `segments` stores each addition without touching the rest.
    """
    fresh = delta.join(index.doc_len.select("doc_id"), "doc_id", "left_anti")
    postings = settled(postings_of(token_rows(fresh, text, mode)))
    counts = index.term_stats.select("term", "df").unionByName(document_frequency(postings)).groupBy("term").agg(F.sum("df").alias("df"))
    caps = index.caps.unionByName(term_caps(postings)).groupBy("term", "len_class").agg(F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
    doc_len = index.doc_len.unionByName(lengths_of(postings))
    return Bm25Index(index.postings.unionByName(postings), doc_len, statistics_of_counts(counts, doc_len), caps)


def index_append(docs: DataFrame, delta: DataFrame) -> DataFrame:
    """Append without looking for ids already present."""
    return docs.unionByName(delta)


def index_remove(index: Bm25Index, ids: DataFrame) -> tuple[Bm25Index, DataFrame]:
    """The index without the documents, and (doc_id, found) for every requested id. Only the removed documents are counted."""
    asked = broadcast_if_small(ids.select("doc_id").distinct())
    gone = document_frequency(index.postings.join(asked, "doc_id", "left_semi")).withColumn("df", -F.col("df"))
    counts = index.term_stats.select("term", "df").unionByName(gone).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    doc_len = index.doc_len.join(asked, "doc_id", "left_anti")
    kept = Bm25Index(index.postings.join(asked, "doc_id", "left_anti"), doc_len, statistics_of_counts(counts, doc_len), index.caps)
    present = index.doc_len.select("doc_id", F.lit(True).alias("found"))
    found = ids.select("doc_id").distinct().join(present, "doc_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False)))
    return kept, found


def embed_missing(texts: DataFrame, store: DataFrame, vectorise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A vector for every input row (text_id, text), each distinct text being embedded at most once.

    `store` holds (text_hash, embedding); `vectorise` maps (text_hash, text) to (text_hash, embedding).
    Copies are reduced to one row per text map-side, so a text with many copies is no hot key there.
    """
    keyed = texts.withColumn("text_hash", F.sha2("text", 256))
    distinct = keyed.groupBy("text_hash").agg(F.first("text").alias("text"))
    todo = distinct.join(store.select("text_hash"), "text_hash", "left_anti")
    known = store.select("text_hash", "embedding", F.lit(True).alias("reused"))
    made = vectorise(todo).select("text_hash", "embedding", F.lit(False).alias("reused"))
    return keyed.select("text_id", "text_hash").join(known.unionByName(made), "text_hash", "left")


def corpus_summary(docs: DataFrame, content: str = "content", name: str = "craft_name") -> DataFrame:
    """(class, total_documents, total_characters): a row per class name, and one with null for the whole."""
    sized = docs.select(F.col(name).alias("class"), F.length(content).cast("long").alias("_n"))
    return sized.groupingSets([[], ["class"]], "class").agg(
        F.count(F.lit(1)).alias("total_documents"), F.sum("_n").alias("total_characters"))


def top_keywords(docs: DataFrame, keywords: str = "keywords", k: int = 20) -> DataFrame:
    """(keyword, freq) of the k most frequent document keywords; ties in alphabetical order."""
    counts = docs.select(F.explode(keywords).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("freq"))
    return counts.orderBy(F.desc("freq"), F.asc("keyword")).limit(k)


def index_coverage(docs: DataFrame, indexed: DataFrame, top_k: int = 5, threshold: float = 0.7) -> DataFrame:
    """One row: total and indexed documents, and the retrieval settings."""
    flags = docs.select("doc_id").join(
        indexed.select("doc_id", F.lit(1).alias("_in")).distinct(), "doc_id", "left")
    return flags.agg(
        F.count(F.lit(1)).alias("total_documents"), F.count("_in").alias("indexed_documents")
    ).select("*", F.lit(top_k).cast("long").alias("top_k"), F.lit(threshold).alias("similarity_threshold"))


def index_count(index: Bm25Index) -> DataFrame:
    return index.doc_len.agg(F.count(F.lit(1)).alias("document_count"))


