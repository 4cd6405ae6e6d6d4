"""Merging and fusing ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.ranking import DECIMALS, rank_rows, row_rank, top_k
from ragspark.functions.sizing import broadcast_if_small, settled

# Fixed values.
KEYWORD_WEIGHT = 0.4
SEMANTIC_WEIGHT = 0.6
RRF_K = 60
RRF_DECIMALS = 9


def blend(keyword: Column, semantic: Column) -> Column:
    return F.round(keyword * KEYWORD_WEIGHT + semantic * SEMANTIC_WEIGHT, DECIMALS)


def merge_hybrid(keyword_hits: DataFrame, semantic_hits: DataFrame) -> DataFrame:
    """Full outer merge of two hit lists on (query_id, doc_id).

    Pairs found by both get 0.4 keyword + 0.6 semantic and type `hybrid`. A pair found by one list keeps
    that list's raw score and type, even where a blended score is lower.
    """
    kw = keyword_hits.select("query_id", "doc_id", F.col("similarity").alias("_k"))
    sem = semantic_hits.select("query_id", "doc_id", F.col("similarity").alias("_s"))
    both = F.col("_k").isNotNull() & F.col("_s").isNotNull()
    blended = blend(F.col("_k"), F.col("_s"))
    return kw.join(sem, ["query_id", "doc_id"], "full_outer").select(
        "query_id",
        "doc_id",
        F.coalesce("_k", F.lit(0.0)).alias("keyword_similarity"),
        F.coalesce("_s", F.lit(0.0)).alias("semantic_similarity"),
        F.when(both, blended).otherwise(F.coalesce("_k", "_s")).alias("similarity"),
        F.when(both, "hybrid").when(F.col("_k").isNotNull(), "keyword").otherwise("semantic").alias("retrieval_type"),
    )


def _ranked_lists(hits: DataFrame, lists: Sequence[str], ascending: Sequence[str], bounded: bool) -> DataFrame:
    signed = F.when(F.col("source").isin(list(ascending)), -F.col("score")).otherwise(F.col("score"))
    hits = hits.withColumn("_goodness", signed)
    order = [F.desc("_goodness"), F.asc("doc_id")]
    if bounded:
        ranked = hits.withColumn("_rank", row_rank(lists, order))
    else:
        ranked = rank_rows(hits, lists, order, "_rank")
    # A blank id uses up a rank but never enters the fusion.
    blank = F.col("doc_id").isNull() | (F.trim(F.col("doc_id").cast("string")) == "")
    return ranked.withColumn("_rank", (F.col("_rank") - 1).cast("long")).where(~blank)


def _fuse(ranked: DataFrame, weight: Column, k: int, payload: str | Sequence[str] | None, trace: bool, limit: int | None,
          bounded: bool, sources: Sequence[str] | None) -> DataFrame:
    step = weight / (F.lit(k) + F.col("_rank"))
    measures = [F.round(F.sum(step), RRF_DECIMALS).alias("score"), F.count(F.lit(1)).alias("sources_count")]
    kept = [payload] if isinstance(payload, str) else list(payload or ())
    if kept:
        place = F.array_position(F.array(*map(F.lit, sources)), F.col("source")) if sources else F.lit(0)
        first = F.min_by(F.struct(*kept), F.struct(place.alias("place"), "source", "_rank"))
        measures.append(first.alias("_first"))
    if trace:
        entry = F.struct("source", F.col("_rank").alias("rank"), F.col("score").alias("original_score"),
                         weight.cast("double").alias("weight"))
        measures.append(F.sort_array(F.collect_list(entry)).alias("sources"))
    fused = ranked.groupBy("query_id", "doc_id").agg(*measures)
    if kept:
        fused = fused.select("*", *[F.col(f"_first.{c}").alias(c) for c in kept]).drop("_first")
    order = [F.desc("score"), F.asc("doc_id")]
    if limit is not None:
        placed = top_k(fused, ["query_id"], order, limit, "final_rank")
    elif bounded:
        placed = fused.withColumn("final_rank", row_rank(["query_id"], order))
    else:
        placed = rank_rows(fused, ["query_id"], order, "final_rank")
    return placed.withColumn("final_rank", F.col("final_rank").cast("long"))


def with_payload(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """The hits with the columns of `docs` (doc_id, ...), nulls for a hit without a document. Only documents that were hit move; hits are the short side."""
    hits = settled(hits)  # their ids choose the documents, then the rows are joined
    wanted = docs.join(broadcast_if_small(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    return hits.join(wanted, "doc_id", "left")


def rrf(hits: DataFrame, k: int = RRF_K, ascending: Sequence[str] = (), payload: str | Sequence[str] | None = None,
        trace: bool = False, limit: int | None = None, bounded: bool = False, sources: Sequence[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion of long (source, query_id, doc_id, score) hits.

    Every list is sorted by score (descending, or ascending for the sources named in `ascending`, whose
    scores are distances); a row at 0-based rank r adds 1/(k + r). An id repeated in one list counts again.
    `payload` keeps columns (content, metadata) of the first list a document was seen in, the lists being in the order of `sources`
    (by name where that is not given); `trace` keeps the contributing rows.

    Ranks are computed without bringing a list into one task. Set `bounded=True` for top-k lists, which are
    short by construction: a plain window is cheaper there.
    """
    ranked = _ranked_lists(hits, ["source", "query_id"], ascending, bounded)
    return _fuse(ranked, F.lit(1.0), k, payload, trace, limit, bounded, sources)


def weighted_rrf(hits: DataFrame, weights: dict[str, float] | None, sources: Sequence[str], k: int = RRF_K,
                 ascending: Sequence[str] = (), payload: str | Sequence[str] | None = None, trace: bool = False,
                 limit: int | None = None, bounded: bool = False) -> DataFrame:
    """RRF with a weight per source, `sources` being the order of the lists. Given weights are scaled to sum 1; without
    weights each list counts 1."""
    if weights is None:
        shares = {s: 1.0 for s in sources}
    else:
        if len(weights) != len(sources) or set(weights) != set(sources):
            raise ValueError(f"{len(weights)} weights for {len(sources)} lists")
        total = sum(weights.values())
        shares = {s: w / total for s, w in weights.items()}
    spark = hits.sparkSession
    table = spark.createDataFrame([(s, float(w)) for s, w in shares.items()], "source string, _weight double")
    ranked = _ranked_lists(hits, ["source", "query_id"], ascending, bounded)
    weighted = ranked.join(F.broadcast(table), "source")
    return _fuse(weighted, F.col("_weight"), k, payload, trace, limit, bounded, sources)


def normalize_scores(hits: DataFrame, method: str = "minmax", lists: Sequence[str] = ("source", "query_id"),
                     score: str = "score") -> DataFrame:
    """Normalise the scores of every list; lists without spread and unknown methods are left unchanged.

    The statistics are a grouped aggregate joined back, not a window, so a long list is not gathered.
    """
    if method not in ("minmax", "zscore"):
        return hits
    keys = list(lists)
    value = F.coalesce(F.col(score), F.lit(0.0))
    if method == "minmax":
        stats = hits.groupBy(*keys).agg(F.min(value).alias("_base"), (F.max(value) - F.min(value)).alias("_spread"))
    else:
        one = F.count(F.lit(1)) == 1
        stats = hits.groupBy(*keys).agg(
            F.avg(value).alias("_base"), F.when(one, 1.0).otherwise(F.stddev_samp(value)).alias("_spread"))
    scaled = F.when(F.col("_spread") == 0, F.col(score)).otherwise(
        F.round((value - F.col("_base")) / F.col("_spread"), DECIMALS))
    return (
        hits.join(broadcast_if_small(stats), keys)
        .withColumn(score, scaled)
        .drop("_base", "_spread")
    )
