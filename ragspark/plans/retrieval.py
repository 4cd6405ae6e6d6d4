"""Retrieval arms put together. Arms carry ids and scores only; texts are joined last, by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions.containment import term_hits
from ragspark.functions.ranking import DECIMALS, top_k
from ragspark.functions.sizing import broadcast_if_small, fits, settled
from ragspark.functions.vectors import cosine, norm
from ragspark.lexicons import STOPWORDS, SYNONYMS
from ragspark.operators.dense import dense_topk, semantic_search
from ragspark.operators.filters import filter_hits_or_all, min_similarity
from ragspark.operators.fusion import KEYWORD_WEIGHT, RRF_K, SEMANTIC_WEIGHT, blend, rrf
from ragspark.operators.keyword import keyword_pairs, keyword_search, many_pairs
from ragspark.operators.lexical import Bm25Index, bm25_topk
from ragspark.operators.rerank import coverage_scores, rerank
from ragspark.operators.rewrite import query_variants

TOP_K = 5
THRESHOLD = 0.7
FUSED_K = 10
BLOCK_DOCS, BLOCK_QUERIES = 4_096, 1_024  # of an array of counts


def retrieve(queries: DataFrame, docs: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD,
             type_filter: str | None = None, query_vectors: DataFrame | None = None,
             doc_vectors: DataFrame | None = None, stopwords: Sequence[str] = STOPWORDS,
             doc_keywords: str | None = "keywords", kind: str = "type") -> DataFrame:
    """Basic retrieval: type filter, keyword search, optional dense search and merge, floor, top k.

    The dense arm never scores all pairs for the merge: documents it alone finds need the floor
    themselves, and those the keyword arm found are scored as given pairs.
    """
    options = {"doc_keywords": doc_keywords, "stopwords": stopwords}
    if query_vectors is None or doc_vectors is None:
        hits = keyword_search(queries, docs, with_matches=False, floor=threshold, **options)
    elif threshold > KEYWORD_WEIGHT and many_pairs(queries, docs):
        hits = _merge_above(queries, docs, query_vectors, doc_vectors, threshold, options)
    else:
        hits = _merge_dense(keyword_search(queries, docs, with_matches=False, **options), query_vectors, doc_vectors, threshold)
    hits = min_similarity(hits, threshold)
    if type_filter is not None:
        hits = filter_hits_or_all(hits, queries, docs, type_filter, kind)
    ranked = top_k(hits, ["query_id"], [F.desc("similarity"), F.asc("doc_id")], k)
    return ranked.select("query_id", "doc_id", "similarity", "retrieval_type", F.col("rank").cast("long"))


def hit_similarity(hits: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, column: str = "similarity") -> DataFrame:
    """Hits with the cosine of their question and document; null where either has no vector."""
    # Norms are computed once per vector, before the join.
    qv = query_vectors.select("query_id", F.col("embedding").alias("_q"), norm(F.col("embedding")).alias("_qn"))
    dv = doc_vectors.select("doc_id", F.col("embedding").alias("_d"), norm(F.col("embedding")).alias("_dn"))
    similarity = F.round(cosine(F.col("_q"), F.col("_d"), F.col("_qn"), F.col("_dn")), DECIMALS)
    return (
        hits.join(broadcast_if_small(dv), "doc_id", "left")
        .join(broadcast_if_small(qv), "query_id", "left")
        .select(*hits.columns, F.when(F.col("_q").isNotNull() & F.col("_d").isNotNull(), similarity).alias(column))
    )


def _merge_above(queries: DataFrame, docs: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, floor: float, options: dict, prune_above: int | None = None) -> DataFrame:
    """The merge for a floor above the keyword weight, where no keyword score alone lifts a pair that has a similarity to it.

    A blended pair then needs a similarity of its own: pairs come from the dense search at that lower floor, their keywords are
    counted as given pairs, and keyword hits without a similarity need the floor themselves.
    """
    own = (floor - KEYWORD_WEIGHT) / SEMANTIC_WEIGHT - 10.0**-DECIMALS
    near = settled(semantic_search(query_vectors, doc_vectors, min_similarity=own).select("query_id", "doc_id", F.col("similarity").alias("_s")))
    counted = near.join(keyword_pairs(near, queries, docs, **options).where("match_count > 0").select(
        "query_id", "doc_id", F.col("similarity").alias("_k")), ["query_id", "doc_id"], "left")
    found = F.col("_k").isNotNull()
    both = counted.select("query_id", "doc_id", F.when(found, blend(F.col("_k"), F.col("_s"))).otherwise(F.col("_s")).alias("similarity"),
                          F.when(found, "hybrid").otherwise("semantic").alias("retrieval_type"))
    alone = keyword_search(queries, docs, with_matches=False, floor=floor, prune_above=prune_above, **options).select("query_id", "doc_id", "similarity")
    alone = hit_similarity(alone, query_vectors, doc_vectors, "_s").where("_s IS NULL")
    return both.unionByName(alone.select("query_id", "doc_id", "similarity", F.lit("keyword").alias("retrieval_type")))


def _merge_dense(hits: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, floor: float) -> DataFrame:
    """Keyword hits blended with their own similarity, and documents near the question that no keyword found.

    This is `merge_hybrid` for a result that is cut at `floor` afterwards, reading the keyword hits once.
    """
    scored = hit_similarity(hits.select("query_id", "doc_id", F.col("similarity").alias("_k")), query_vectors, doc_vectors, "_s")
    # Below the floor a keyword hit only matters where it keeps a near document from counting as unmatched.
    own = F.when(F.col("_s").isNull(), F.col("_k")).otherwise(blend(F.col("_k"), F.col("_s")))
    scored = scored.withColumn("_own", own).where((F.col("_own") >= floor) | (F.col("_s") >= floor))
    near = semantic_search(query_vectors, doc_vectors, min_similarity=floor).select(
        "query_id", "doc_id", F.col("similarity").alias("_n"))
    found = F.col("_k").isNotNull()
    return scored.join(near, ["query_id", "doc_id"], "full_outer").select(
        "query_id",
        "doc_id",
        F.coalesce("_own", "_n").alias("similarity"),
        F.when(~found, "semantic").when(F.col("_s").isNull(), "keyword").otherwise("hybrid").alias("retrieval_type"),
    )


def routed_retrieve(routes: DataFrame, docs: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD,
                    kind: str = "type", **options) -> DataFrame:
    """(query_id, category, doc_id, similarity, rank): basic retrieval once per (question, category), the
    category being the type filter. `routes` has query_id, question and required_experts; the category
    `x_expert` filters on `x`."""
    keyed = routes.select("query_id", "question", F.explode("required_experts").alias("category")).withColumn(
        "type_filter", F.regexp_replace("category", "_expert$", ""))
    # A question's score does not depend on its category, so it is searched once and filtered per category.
    hits = keyword_search(routes.select("query_id", "question"), docs, with_matches=False, floor=threshold, **options)
    pair = F.concat_ws("\u0000", F.col("query_id").cast("string"), "category")
    wanted = keyed.select(F.col("query_id").alias("_qid"), pair.alias("query_id"), "category", "type_filter")
    spread = hits.join(broadcast_if_small(wanted.select(F.col("_qid").alias("query_id"), F.col("query_id").alias("_pair"))), "query_id")
    kept = filter_hits_or_all(spread.select(F.col("_pair").alias("query_id"), "doc_id", "similarity"), wanted, docs, "type_filter", kind)
    ranked = top_k(kept, ["query_id"], [F.desc("similarity"), F.asc("doc_id")], k)
    return ranked.join(broadcast_if_small(wanted.select("query_id", "_qid", "category")), "query_id").select(
        F.col("_qid").alias("query_id"), "category", "doc_id", "similarity", F.col("rank").cast("long"))


def graph_retrieve(queries: DataFrame, nodes: DataFrame, edges: DataFrame, docs: DataFrame, entities: DataFrame,
                   k: int | None = None, content: str = "content") -> DataFrame:
    """(query_id, doc_id, score[, rank]): documents naming the neighbours of the entities in a question.

    `entities` (id, name) are the nodes looked for in questions. The score counts distinct neighbours named.
    """
    named = term_hits(queries.select("query_id", "question"), "query_id", "question", entities, "name")
    found = named.select("query_id", F.explode("terms").alias("name")).join(broadcast_if_small(entities.select("id", "name")), "name")
    around = (
        edges.select(F.col("source").alias("id"), F.col("target"))
        .join(broadcast_if_small(found.select("query_id", "id")), "id")
        .join(nodes.select(F.col("id").alias("target"), F.col("name").alias("neighbor")), "target")
        .select("query_id", "neighbor")
        .distinct()
    )
    hits = term_hits(docs.select("doc_id", F.col(content).alias("_c")), "doc_id", "_c", around, "neighbor")
    if k is not None and fits(around):
        ranked = top_k(_best_by_count(hits, settled(around), k), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
        return ranked.select("query_id", "doc_id", "score", F.col("rank").cast("long"))
    scored = (
        hits.repartition("doc_id")
        .select("doc_id", F.explode("terms").alias("neighbor"))
        .join(broadcast_if_small(around), "neighbor")
        .groupBy("query_id", "doc_id")
        .agg(F.count(F.lit(1)).cast("double").alias("score"))
    )
    if k is None:
        return scored
    ranked = top_k(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
    return ranked.select("query_id", "doc_id", "score", F.col("rank").cast("long"))


def _best_by_count(hits: DataFrame, around: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): how many of a question's words (`around`: query_id, neighbor; few, sent to the tasks) a document holds, the k best per question and block of documents.

    A block's counts are summed in an array of documents and questions, so that a word that many questions and documents share makes no rows.
    """
    asked = around.toArrow()
    words, queries = asked["neighbor"].combine_chunks().dictionary_encode(), asked["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    shared = around.sparkSession.sparkContext.broadcast((words.dictionary, words.indices.to_numpy(zero_copy_only=False), queries.dictionary, queries.indices.to_numpy(zero_copy_only=False)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, word_of, ids, query_of = shared.value
        order = np.argsort(word_of, kind="stable")
        asking = np.split(query_of[order], np.searchsorted(word_of[order], np.arange(1, len(listed))))  # the questions of every word
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                docs = batch.slice(at, BLOCK_DOCS)
                docs = docs.take(pc.sort_indices(docs.column(0), null_placement="at_start"))  # ties go to the lower id
                doc = np.repeat(np.arange(docs.num_rows), np.asarray(docs.column(1).value_lengths().fill_null(0)))
                word = pc.index_in(docs.column(1).flatten(), listed)
                known = np.asarray(word.is_valid())
                doc, word = doc[known], np.asarray(word.drop_null())
                by_word = np.argsort(word, kind="stable")
                doc, starts = doc[by_word], np.searchsorted(word[by_word], np.arange(len(listed) + 1))
                for first in range(0, len(ids), BLOCK_QUERIES):
                    last = min(first + BLOCK_QUERIES, len(ids))
                    counts = np.zeros((last - first, docs.num_rows), dtype=np.int32)
                    for w in np.flatnonzero(np.diff(starts)):
                        some = asking[w][(asking[w] >= first) & (asking[w] < last)] - first
                        if len(some):
                            counts[some] += np.bincount(doc[starts[w]:starts[w + 1]], minlength=docs.num_rows).astype(np.int32)
                    n = min(k, docs.num_rows)
                    key = counts.astype(np.int64) * docs.num_rows + np.arange(docs.num_rows)[::-1]
                    best = np.argpartition(key, docs.num_rows - n, axis=1)[:, docs.num_rows - n:]
                    score = np.take_along_axis(counts, best, axis=1)
                    q, at_best = np.nonzero(score)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + first)), docs.column(0).take(pa.array(best[q, at_best])), pa.array(score[q, at_best].astype(np.float64))],
                                                     names=["query_id", "doc_id", "score"])

    kinds = [around.schema["query_id"].dataType.simpleString(), hits.schema["doc_id"].dataType.simpleString()]
    # Rows with the same id are one document.
    whole = hits.groupBy("doc_id").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    return whole.mapInArrow(count, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")


def _arm(hits: DataFrame, source: str) -> DataFrame:
    return hits.select(F.lit(source).alias("source"), "query_id", "doc_id", F.col("score").cast("double").alias("score"))


Vectoriser = Callable[[DataFrame], DataFrame]  # (query_id, question) -> (query_id, embedding)


def variant_hits(queries: DataFrame, index: Bm25Index, vectorise: Vectoriser, doc_vectors: DataFrame, k: int, synonyms=SYNONYMS,
                 mode: str = "mixed") -> DataFrame:
    """(source, query_id, doc_id, score): BM25 and dense top k of every expanded variant, one source per retriever and variant."""
    variants = query_variants(queries, synonyms=synonyms)
    keyed = settled(variants.select(F.concat_ws("/", "variant", "query_id").alias("query_id"), "question"))

    def arm(hits: DataFrame, retriever: str) -> DataFrame:
        cut = F.split("query_id", "/", 2)
        return hits.select(F.concat(F.lit(f"{retriever}:"), cut[0]).alias("source"),
                           cut[1].cast(queries.schema["query_id"].dataType).alias("query_id"), "doc_id", "score")

    return arm(bm25_topk(keyed, index, k, mode=mode), "bm25").unionByName(arm(dense_topk(vectorise(keyed), doc_vectors, k), "dense"))


def multi_query_search(queries: DataFrame, index: Bm25Index, vectorise: Vectoriser, doc_vectors: DataFrame,
                       k: int = TOP_K, limit: int = FUSED_K, synonyms=SYNONYMS, mode: str = "mixed") -> DataFrame:
    """Every expanded variant through BM25 and dense search, fused by rank. `vectorise` gives the variants' vectors."""
    return rrf(variant_hits(queries, index, vectorise, doc_vectors, k, synonyms, mode), RRF_K, limit=limit, bounded=True)


def hybrid_search(queries: DataFrame, index: Bm25Index, vectorise: Vectoriser, doc_vectors: DataFrame,
                  nodes: DataFrame, edges: DataFrame, entities: DataFrame, docs: DataFrame, k: int = TOP_K,
                  fused: int = FUSED_K, synonyms=SYNONYMS, mode: str = "mixed") -> DataFrame:
    """Expand, search by BM25, vectors and graph, fuse the lists to `fused` rows, rescore and keep k.

    The fused list is bounded (`fused` rows per question) and is written once before its two uses.
    """
    lists = variant_hits(queries, index, vectorise, doc_vectors, fused, synonyms, mode).unionByName(
        _arm(graph_retrieve(queries, nodes, edges, docs, entities, fused), "graph"))
    merged = rrf(lists, RRF_K, limit=fused, bounded=True).select("query_id", "doc_id", "score", F.col("final_rank").alias("rank"))
    merged = settled(merged)
    return rerank(merged, coverage_scores(merged, queries, index, mode=mode), k)
