"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions.containment import term_hits
from ragspark.functions.sizing import broadcast_if_small
from ragspark.lexicons import PROFILES

def matched_values(docs: DataFrame, values: DataFrame, kind: str = "type") -> DataFrame:
    """(doc_id, filter_value) for values (filter_value) that occur in the document's type or id."""
    text = F.concat_ws("\u0000", F.coalesce(F.col(kind), F.lit("")), F.col("doc_id").cast("string"))
    hits = term_hits(docs.select("doc_id", text.alias("_t")), "doc_id", "_t", values, "filter_value")
    return hits.select("doc_id", F.explode("terms").alias("filter_value"))


def all_documents(values: DataFrame, docs: DataFrame) -> DataFrame:
    """A row per value that stands for all documents: doc_id null, n_docs their number."""
    total = docs.agg(F.count(F.lit(1))).scalar()
    return values.select("*", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), total.alias("n_docs"))


def filter_or_all(docs: DataFrame, filters: DataFrame, column: str = "type_filter", kind: str = "type") -> DataFrame:
    """(filter_value, doc_id, n_docs): per distinct filter value the matching documents, or all when none matches.

    "All" is one row with a null doc_id whose n_docs counts the documents; they are not written out once per value.
    """
    values = filters.select(F.col(column).alias("filter_value")).where("filter_value is not null").distinct()
    matched = matched_values(docs, values, kind)
    missed = values.join(matched.select("filter_value").distinct(), "filter_value", "left_anti")
    everything = all_documents(missed, docs)
    return matched.withColumn("n_docs", F.lit(1).cast("long")).unionByName(everything).select("filter_value", "doc_id", "n_docs")


def filter_hits_or_all(hits: DataFrame, queries: DataFrame, docs: DataFrame, column: str = "type_filter",
                       kind: str = "type") -> DataFrame:
    """The same rule applied to hits: a hit stays if it passes its query's filter, if the query has no
    filter, or if no document at all passes that filter."""
    wanted = queries.select("query_id", F.col(column).alias("filter_value"))
    values = wanted.select("filter_value").where("filter_value is not null").distinct()
    known = matched_values(docs, values, kind).select("filter_value").distinct().withColumn("_some", F.lit(True))
    wanted = wanted.join(broadcast_if_small(known), "filter_value", "left")
    kinds = docs.select("doc_id", F.coalesce(F.col(kind), F.lit("")).alias("_kind"))
    want = F.col("filter_value")
    passes = F.contains(F.col("_kind"), want) | F.contains(F.col("doc_id").cast("string"), want)
    return (
        hits.join(broadcast_if_small(wanted), "query_id")
        .join(kinds, "doc_id")
        .where(want.isNull() | F.col("_some").isNull() | passes)
        .drop("filter_value", "_some", "_kind")
    )


def min_similarity(hits: DataFrame, threshold: float = 0.7, column: str = "similarity") -> DataFrame:
    """Keep hits at or above the threshold; a hit without similarity counts as 1."""
    return hits.where(F.coalesce(F.col(column), F.lit(1.0)) >= threshold)


def metadata_filter(docs: DataFrame, criteria: dict[str, object]) -> DataFrame:
    """Equality on metadata columns, as plain predicates that the scan can take."""
    for name, value in criteria.items():
        docs = docs.where(F.col(name) == F.lit(value))
    return docs


def usable_responses(responses: DataFrame) -> DataFrame:
    return responses.where(F.col("success") & (F.length("content") > 0))


def valid_profile(df: DataFrame, column: str = "user_profile", profiles: Sequence[str] | None = None) -> DataFrame:
    """Flag rows whose profile id is one of the enumerated ids."""
    known = list(profiles if profiles is not None else [p[0] for p in PROFILES])
    return df.withColumn("is_valid", F.coalesce(F.col(column).isin(known), F.lit(False)))
