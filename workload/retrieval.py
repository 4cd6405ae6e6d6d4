"""Retrieval, fusion, rewriting and reranking queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.functions.models import batched_model
from ragspark.functions.sizing import settled
from ragspark.functions.text import tokenize
from ragspark.operators import cells, dense, filters, fusion, keyword, lexical, rerank, rewrite
from ragspark.operators.gram_index import GramIndex
from ragspark.operators.vectorize import bucket_idf, hashed_tfidf
from ragspark.plans import retrieval as plans
from ragspark.session import work_path
from workload import bindings as B
from workload import params as P


def joined(column: str):
    return F.array_join(column, "|")


DIM = 256  # components of the hashed vectors


# ---- lexical ----

def bm25_term_stats(spark, sf):
    index = lexical.bm25_index(B.documents(spark, sf))
    return index.term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf):
    return lexical.bm25_topk(B.questions(spark, sf), B.stored_index(spark, sf), 5)


def bm25_all_scores(spark, sf):
    return lexical.bm25_scores(B.questions(spark, sf), B.stored_index(spark, sf))


def bm25_post_filter(spark, sf):
    allowed = B.documents(spark, sf).where("class = 'en'")
    return lexical.bm25_filtered(B.questions(spark, sf), B.stored_index(spark, sf), allowed, 5, "post")


def bm25_pre_filter(spark, sf):
    allowed = B.documents(spark, sf).where("class = 'en'")
    return lexical.bm25_filtered(B.questions(spark, sf), B.stored_index(spark, sf), allowed, 5, "pre")


def bm25_pair_scores(spark, sf):
    """Every labelled document against the question that shares its number."""
    pairs = B.table(spark, sf, "labels").select("doc_id", F.col("doc_id").alias("query_id")).join(
        B.questions(spark, sf).select("query_id"), "query_id")
    return lexical.bm25_pair_scores(pairs, B.questions(spark, sf), B.stored_index(spark, sf)).select("query_id", "doc_id", "score")


def tokenize_documents(spark, sf):
    docs = B.documents(spark, sf).repartition("doc_id")
    return docs.select("doc_id", tokenize(F.col("content")).alias("t")).select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), joined("t").alias("tokens"))


def query_keywords(spark, sf):
    out = keyword.query_keywords(B.questions(spark, sf), stopwords=P.STOP)
    return out.select("query_id", F.size("keywords").cast("long").alias("n"), joined("keywords").alias("keywords"))


def keyword_search(spark, sf):
    out = keyword.keyword_search(B.questions(spark, sf), B.tagged_documents(spark, sf), stopwords=P.STOP)
    return out.select("query_id", "doc_id", "match_count", "similarity", joined("matched_keywords").alias("matched_keywords"), "retrieval_type")


def keyword_topk(spark, sf):
    out = keyword.keyword_search(B.questions(spark, sf), B.tagged_documents(spark, sf), stopwords=P.STOP, k=5)
    return out.select("query_id", "doc_id", "match_count", "similarity", joined("matched_keywords").alias("matched_keywords"), F.col("rank").cast("long"))


def substring_search(spark, sf):
    terms = B.lexicon(spark).select(F.col("keyword").alias("term"))
    out = keyword.substring_search(B.documents(spark, sf), terms)
    return out.select("term", "doc_id", "match_count", joined(F.col("match_positions").cast("array<string>")).alias("positions"))


def gram_search(spark, sf):
    """Every word of the benchmark items, and every first three characters of one, in the texts, by a stored index of grams."""
    docs = B.documents(spark, sf)
    words = B.table(spark, sf, "benchmark").select(F.explode(tokenize(F.col("text"), "words")).alias("w")).distinct()
    terms = words.select(F.explode(F.array("w", F.substring("w", 1, 3))).alias("term"))
    index = GramIndex.build(docs, work_path(spark, "grams"), slots=32)
    return index.hits(terms).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"), F.sum("doc_id").alias("doc_sum"))


# ---- dense ----

def cosine_pairs(spark, sf):
    """Every vector against the first vector of its label."""
    vectors = B.table(spark, sf, "embeddings")
    first = vectors.groupBy("label").agg(F.min("vec_id").alias("right_id"))
    pairs = vectors.select(F.col("vec_id").alias("left_id"), "label").join(first, "label").drop("label")
    return dense.pair_similarity(pairs, vectors, vectors).select("left_id", "right_id", "similarity")


def semantic_search(spark, sf):
    """The mean vector of every label against all vectors."""
    return dense.semantic_search(B.label_centroids(spark, sf), B.doc_vectors(spark, sf))


def semantic_floor(spark, sf):
    return dense.semantic_search(B.query_vectors(spark, sf), B.doc_vectors(spark, sf), min_similarity=0.3)


def dense_topk(spark, sf):
    return dense.dense_topk(B.query_vectors(spark, sf), B.doc_vectors(spark, sf), 5)


def cells_topk(spark, sf):
    """The same from an index of cells, built and stored first."""
    index = cells.CellIndex.build(B.doc_vectors(spark, sf), work_path(spark, "cells"), cells=32)
    return cells.cells_topk(B.query_vectors(spark, sf), index, 5, probes=8)


def dense_filtered(spark, sf):
    return dense.dense_topk(B.query_vectors(spark, sf), filters.metadata_filter(B.doc_vectors(spark, sf), {"label": 3}), 5)


def hybrid_merge(spark, sf):
    """Keyword hits with their similarity whatever it is, and documents at 0.2 or above that no keyword found."""
    kw = keyword.keyword_search(B.questions(spark, sf), B.tagged_documents(spark, sf), stopwords=P.STOP, with_matches=False)
    kw = settled(kw)  # merged, and scored by vectors
    near = dense.semantic_search(B.query_vectors(spark, sf), B.doc_vectors(spark, sf), min_similarity=0.2)
    known = plans.hit_similarity(kw.select("query_id", "doc_id"), B.query_vectors(spark, sf), B.doc_vectors(spark, sf))
    sem = known.where("similarity IS NOT NULL").unionByName(near.drop("retrieval_type")).distinct()
    return fusion.merge_hybrid(kw, sem)


def basic_retrieve(spark, sf):
    return plans.retrieve(B.questions(spark, sf), B.tagged_documents(spark, sf), threshold=0.5, type_filter="type_filter",
                          query_vectors=B.query_vectors(spark, sf), doc_vectors=B.doc_vectors(spark, sf), stopwords=P.STOP)


def similarity_floor(spark, sf):
    hits = keyword.keyword_search(B.questions(spark, sf), B.tagged_documents(spark, sf), stopwords=P.STOP, with_matches=False, floor=0.7, prune_above=0)
    return filters.min_similarity(hits, 0.7).select("query_id", "doc_id", "similarity")


def filter_or_all(spark, sf):
    return filters.filter_or_all(B.documents(spark, sf), B.questions(spark, sf)).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))


# ---- fusion ----

def _lists(spark, sf, k=10):
    bm = lexical.bm25_topk(B.questions(spark, sf), B.stored_index(spark, sf), k)
    dn = dense.dense_topk(B.query_vectors(spark, sf), B.doc_vectors(spark, sf), k)
    return plans._arm(bm, "bm25").unionByName(plans._arm(dn, "dense"))


def rrf_fusion(spark, sf):
    out = fusion.rrf(_lists(spark, sf), trace=True, bounded=True)
    trace = F.transform("sources", lambda s: F.concat(s["source"], F.lit(":"), s["rank"].cast("string")))
    return out.select("query_id", "doc_id", "score", "sources_count", "final_rank", F.array_join(trace, "|").alias("sources"))


def rrf_payload(spark, sf):
    """Text and metadata of the first list a document is in, the dense list being the first."""
    texts = B.documents(spark, sf).select("doc_id", "content", F.concat(F.lit("class="), "class").alias("said"))
    hits = fusion.with_payload(_lists(spark, sf), texts).withColumn("metadata", F.create_map(F.lit("from"), "source", F.lit("about"), "said"))
    out = fusion.rrf(hits, payload=["content", "metadata"], bounded=True, sources=["dense", "bm25"])
    return out.select("query_id", "doc_id", "score", "final_rank", "content", F.col("metadata")["from"].alias("seen_in"), F.col("metadata")["about"].alias("about"))


def rrf_unbounded(spark, sf):
    """Whole keyword and label-centroid lists, ranked without gathering a list."""
    kw = keyword.keyword_search(B.questions(spark, sf), B.documents(spark, sf), doc_keywords=None, stopwords=P.STOP, with_matches=False)
    sem = dense.semantic_search(B.label_centroids(spark, sf), B.doc_vectors(spark, sf))
    lists = plans._arm(kw.withColumnRenamed("similarity", "score"), "keyword").unionByName(
        plans._arm(sem.withColumnRenamed("similarity", "score"), "dense"))
    return fusion.rrf(lists).select("query_id", "doc_id", "score", "sources_count", "final_rank")


def weighted_rrf(spark, sf):
    out = fusion.weighted_rrf(_lists(spark, sf), {"bm25": 2.0, "dense": 3.0}, ["bm25", "dense"], bounded=True)
    return out.select("query_id", "doc_id", "score", "sources_count", "final_rank")


def score_minmax(spark, sf):
    return fusion.normalize_scores(settled(_lists(spark, sf)), "minmax")  # measured and then scaled


def score_zscore(spark, sf):
    return fusion.normalize_scores(settled(_lists(spark, sf)), "zscore")


# ---- rewriting ----

def query_expand(spark, sf):
    out = rewrite.query_variants(B.user_turns(spark, sf), synonyms=P.SYNONYMS)
    return out


def replies(spark, sf):
    """A stored reply per user turn: fenced, bare, without variants, malformed, or missing."""
    kind = F.col("query_id") % 5
    body = F.concat(F.lit('{"rewritten_query": "r'), F.col("query_id").cast("string"), F.lit('", "expanded_queries": ["a'),
                    F.col("query_id").cast("string"), F.lit('", "b"]}'))
    reply = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 1, body)
        .when(kind == 2, F.concat(F.lit('{"rewritten_query": "r'), F.col("query_id").cast("string"), F.lit('", "expanded_queries": []}')))
        .when(kind == 3, F.concat(body, F.lit(" trailing")))
    )
    return B.user_turns(spark, sf).select("query_id", reply.alias("reply")).where("reply is not null")


def rewrite_batch(spark, sf):
    out = rewrite.rewrite_batch(B.user_turns(spark, sf), replies(spark, sf))
    return out.select("query_id", "original_query", "rewritten_query", joined("expanded_queries").alias("expanded_queries"))


# ---- reranking and whole plans ----

def rerank_topk(spark, sf):
    index = B.stored_index(spark, sf)
    best = settled(lexical.bm25_topk(B.questions(spark, sf), index, 10))  # scored and then sorted
    return rerank.rerank(best, rerank.coverage_scores(best, B.questions(spark, sf), index), 5)


def pair_scores(spark, sf):
    index = B.stored_index(spark, sf)
    pairs = B.table(spark, sf, "labels").select("doc_id", F.col("doc_id").alias("query_id")).join(
        B.questions(spark, sf).select("query_id"), "query_id")
    return rerank.pair_scores(rerank.coverage_scores(pairs, B.questions(spark, sf), index))


@F.pandas_udf(T.DoubleType())
def word_share(question: pd.Series, content: pd.Series) -> pd.Series:
    """A stand-in for a model: share of the question's words found in the text; it fails on questions of a length divisible by 5."""
    def score(q, c):
        words = set(q.split(" "))
        return None if len(q) % 5 == 0 else round(sum(w in c for w in words) / len(words), 6)
    return pd.Series([score(q, c) for q, c in zip(question, content)], dtype="float64")


def model_rerank(spark, sf):
    best = settled(lexical.bm25_topk(B.questions(spark, sf), B.stored_index(spark, sf), 10))
    return rerank.rerank(best, rerank.model_scores(best, B.questions(spark, sf), B.documents(spark, sf), word_share), 5)


def model_pair_scores(spark, sf):
    """Every labelled document against the question its number falls on."""
    n = B.questions(spark, sf).agg(F.count(F.lit(1))).scalar()
    pairs = B.table(spark, sf, "labels").select("doc_id", (F.col("doc_id") % n).alias("query_id")).distinct()
    return rerank.pair_scores(rerank.model_scores(pairs, B.questions(spark, sf), B.documents(spark, sf), word_share))


def load_word_share():
    """Loads the stand-in as a model of batches: it raises on a question of a length divisible by 5."""
    def model(given):
        scores = []
        for question, content in given:
            if len(question) % 5 == 0:
                raise ValueError("not scored")
            words = set(question.split(" "))
            scores.append(round(sum(w in content for w in words) / len(words), 6))
        return scores
    return model


def loaded_pair_scores(spark, sf):
    """Every labelled document against the question its number falls on, by a model that is loaded per task and scores batches of 32."""
    n = B.questions(spark, sf).agg(F.count(F.lit(1))).scalar()
    pairs = B.table(spark, sf, "labels").select("doc_id", (F.col("doc_id") % n).alias("query_id")).distinct()
    return rerank.model_scores(pairs, B.questions(spark, sf), B.documents(spark, sf), batched_model(load_word_share))


def _vectors(spark, sf):
    """A vectoriser for questions, and the documents' vectors, both weighed by the documents' idf."""
    docs, postings = B.documents(spark, sf), B.stored_index(spark, sf).postings
    idf = settled(bucket_idf(docs, DIM, postings=postings))
    return (lambda asked: hashed_tfidf(asked, DIM, "question", "query_id", idf=idf)), hashed_tfidf(docs, DIM, idf=idf, postings=postings)


def multi_query_rrf(spark, sf):
    out = plans.multi_query_search(B.questions(spark, sf), B.stored_index(spark, sf), *_vectors(spark, sf), synonyms=P.SYNONYMS)
    return out.select("query_id", "doc_id", "score", "sources_count", "final_rank")


def graph_retrieve(spark, sf):
    nodes, edges = B.word_graph(spark, sf)
    return plans.graph_retrieve(B.questions(spark, sf), nodes, edges, B.documents(spark, sf), nodes, 10)


def hybrid_search(spark, sf):
    nodes, edges = B.word_graph(spark, sf)
    return plans.hybrid_search(B.questions(spark, sf), B.stored_index(spark, sf), *_vectors(spark, sf),
                               nodes, edges, nodes, B.documents(spark, sf), synonyms=P.SYNONYMS)


def category_docs(spark, sf):
    kind = F.when(F.col("class") == "en", "craft").when(F.col("class") == "fr", "history").otherwise("other")
    return B.tagged_documents(spark, sf).withColumn("type", kind)


def routed(spark, sf):
    from ragspark.operators.classify import route

    return route(B.questions(spark, sf).select("query_id", "question"), routes=P.ROUTES)


def routed_retrieve(spark, sf):
    return plans.routed_retrieve(routed(spark, sf), category_docs(spark, sf), threshold=0.3, stopwords=P.STOP)


def tfidf_vectors(spark, sf):
    """Every component other than zero."""
    out = hashed_tfidf(B.documents(spark, sf), DIM)
    return out.select("doc_id", F.posexplode("embedding").alias("bucket", "value")).where("value <> 0").select(
        "doc_id", F.col("bucket").cast("long").alias("bucket"), F.round("value", 6).alias("value"))


QUERIES = {f.__name__: f for f in (
    bm25_term_stats, bm25_topk, bm25_all_scores, bm25_post_filter, bm25_pre_filter, bm25_pair_scores, query_keywords,
    keyword_search, keyword_topk, substring_search, gram_search, cosine_pairs, semantic_search, semantic_floor, dense_topk, cells_topk, dense_filtered,
    hybrid_merge, basic_retrieve, similarity_floor, filter_or_all, rrf_fusion, rrf_payload, rrf_unbounded, weighted_rrf, score_minmax,
    score_zscore, query_expand, rewrite_batch, rerank_topk, pair_scores, model_rerank, model_pair_scores, loaded_pair_scores, multi_query_rrf, graph_retrieve, hybrid_search,
    routed_retrieve, tfidf_vectors)}
QUERIES["tokenize"] = tokenize_documents

BM = B.QUESTIONS + ",\n" + B.bm25_sql()
BM_TOP = BM + ",\nbm_top AS (SELECT qk AS query_id, doc_id, score, row_number() OVER (PARTITION BY qk ORDER BY score DESC, doc_id) AS rank FROM bm_scores)"
DN_TOP = B.DENSE + ",\ndn_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dn_scores)"


def filled_sql(name: str, keys: str, scores: str, k: int) -> str:
    """CTE `{name}` (qk, doc_id, score, rank): the k best of `scores` for the `qk` in `keys`, completed with zeros."""
    return f"""{name}_all AS (SELECT qk, doc_id, score FROM {scores} UNION ALL SELECT k.qk, f.doc_id, 0.0 FROM ({keys}) k, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT {2 * k}) f
  WHERE NOT EXISTS (SELECT 1 FROM {scores} s WHERE s.qk = k.qk AND s.doc_id = f.doc_id)),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY score DESC, doc_id) AS rank FROM {name}_all) WHERE rank <= {k})"""


BM_TEN = BM + ",\n" + filled_sql("bm_ten", "SELECT query_id AS qk FROM qs", "bm_scores", 10)
LISTS = BM_TEN + ",\n" + DN_TOP + """,
hits AS (SELECT 'bm25' AS source, qk AS query_id, doc_id, score, rank FROM bm_ten
  UNION ALL SELECT 'dense', query_id, doc_id, score, rank FROM dn_top WHERE rank <= 10)"""
FILLED = """need AS (SELECT q.query_id, f.doc_id FROM qs q, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10) f
  WHERE NOT EXISTS (SELECT 1 FROM bm_scores s WHERE s.qk = q.query_id AND s.doc_id = f.doc_id)),
filled AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT query_id, doc_id, score FROM bm_top WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, 0.0 FROM need))"""
NORM = """SELECT source, query_id, doc_id, {} AS score FROM hits JOIN (SELECT source, query_id, min(score) AS lo, max(score) AS hi, avg(score) AS mean,
  CASE WHEN count(*) = 1 THEN 1.0 ELSE stddev_samp(score) END AS sd FROM hits GROUP BY ALL) USING (source, query_id)"""
SIGNALS = """qterms AS (SELECT qk AS query_id, t.term, coalesce(idf, 0) AS idf FROM bm_qt t LEFT JOIN bx_stats USING (term)),
qmass AS (SELECT query_id, count(*) AS n, sum(idf) AS mass FROM qterms GROUP BY 1)"""


def cover(candidates: str) -> str:
    """CTE `covered` (query_id, doc_id, score) for a candidate relation."""
    return f"""{SIGNALS},
got AS (SELECT c.query_id, c.doc_id, count(*) AS hit, sum(t.idf) AS mass FROM {candidates} c JOIN bx_post p ON p.doc_id = c.doc_id
  JOIN qterms t ON t.query_id = c.query_id AND t.term = p.term GROUP BY ALL),
covered AS (SELECT c.query_id, c.doc_id, round(coalesce(coalesce(g.hit, 0) / m.n + coalesce(g.mass / nullif(m.mass, 0), 0), 0), 6) AS score
  FROM {candidates} c LEFT JOIN qmass m ON m.query_id = c.query_id LEFT JOIN got g ON g.query_id = c.query_id AND g.doc_id = c.doc_id)"""


def variants_sql(source: str) -> str:
    """SELECT of (query_id, variant, question) from rows (query_id, question)."""
    q = "trim(question, ' ' || chr(9) || chr(10) || chr(13))"
    legs = ", ".join(f"CASE WHEN contains({q}, {P.text(k)}) THEN {P.texts(w[:2])} ELSE [] END" for k, w in P.SYNONYMS)
    full = f"list_concat([{q}], flatten([{legs}]))"
    # Distinct in order of first appearance.
    dist = f"list_filter({full}, lambda x, i: list_position({full}, x) = i)[1:5]"
    return f"""SELECT query_id, (unnest(range(0, len(v))))::BIGINT AS variant, unnest(v) AS question FROM (SELECT query_id, {dist} AS v FROM {source})"""


WS = "list_distinct(string_split(q.question, ' '))"
SHARE = f"CASE WHEN length(q.question) % 5 <> 0 THEN round(len(list_filter({WS}, lambda x: contains(d.text, x))) / len({WS}), 6) END"
PAIRS = "pairs AS (SELECT doc_id, doc_id AS query_id FROM labels WHERE doc_id IN (SELECT query_id FROM qs))"
VARIANT_BM = (B.QUESTIONS + ",\nvar AS (" + variants_sql("qs") + "),\n" + B.bm25_sql("SELECT query_id || '/' || variant AS qk, question FROM var", "vb")
              + ",\n" + filled_sql("vb_ten", "SELECT query_id || '/' || variant AS qk FROM var", "vb_scores", 10) + """,
vb_top AS (SELECT split_part(qk, '/', 1)::BIGINT AS query_id, split_part(qk, '/', 2) AS variant, doc_id, score, rank FROM vb_ten)""")

CAT_DOCS = """cd AS (SELECT doc_id, CASE WHEN class = 'en' THEN 'craft' WHEN class = 'fr' THEN 'history' ELSE 'other' END AS type FROM docs)"""


def routes_sql(source: str) -> str:
    """SELECT of query_id, question, cats (list) from rows (query_id, question)."""
    legs = ", ".join(f"CASE WHEN {P.any_of('question', ws)} THEN [{P.text(c)}] ELSE [] END" for c, ws in P.ROUTES)
    return f"SELECT query_id, question, CASE WHEN len(c) > 0 THEN c ELSE ['craft_expert'] END AS cats FROM (SELECT query_id, question, flatten([{legs}]) AS c FROM {source})"


ROUTED = B.KEYWORD + ",\n" + CAT_DOCS + ",\nrt AS (" + routes_sql("qs") + """),
rc AS (SELECT query_id, unnest(cats) AS category FROM rt),
rf AS (SELECT query_id, category, replace(category, '_expert', '') AS want FROM rc),
rh AS (SELECT f.query_id, f.category, h.doc_id, h.similarity FROM kw_hits h JOIN rf f USING (query_id) JOIN cd USING (doc_id)
  WHERE h.similarity >= 0.3 AND (contains(cd.type, f.want) OR contains(h.doc_id::VARCHAR, f.want) OR NOT EXISTS (SELECT 1 FROM cd c2 WHERE contains(c2.type, f.want)))),
routed AS (SELECT query_id, category, doc_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY similarity DESC, doc_id) AS rank FROM rh) WHERE rank <= 5)"""

BASIC = B.KEYWORD + ",\n" + B.DENSE + """,
known AS (SELECT k.query_id, k.doc_id, s.score AS similarity FROM kw_hits k JOIN dn_scores s USING (query_id, doc_id)),
near AS (SELECT query_id, doc_id, score AS similarity FROM dn_scores WHERE score >= 0.5),
sem AS (SELECT DISTINCT * FROM (SELECT * FROM known UNION ALL SELECT * FROM near)),
merged AS (SELECT query_id, doc_id, CASE WHEN k.similarity IS NOT NULL AND s.similarity IS NOT NULL THEN round(k.similarity * 0.4 + s.similarity * 0.6, 6)
    ELSE coalesce(k.similarity, s.similarity) END AS similarity,
  CASE WHEN k.similarity IS NOT NULL AND s.similarity IS NOT NULL THEN 'hybrid' WHEN k.similarity IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS retrieval_type
  FROM kw_hits k FULL OUTER JOIN sem s USING (query_id, doc_id)),
anyf AS (SELECT DISTINCT type_filter FROM qs WHERE EXISTS (SELECT 1 FROM docs d WHERE contains(d.type, type_filter) OR contains(d.doc_id::VARCHAR, type_filter))),
kept AS (SELECT m.* FROM merged m JOIN qs q USING (query_id) JOIN docs d USING (doc_id)
  WHERE m.similarity >= 0.5 AND (q.type_filter NOT IN (SELECT type_filter FROM anyf) OR contains(d.type, q.type_filter) OR contains(d.doc_id::VARCHAR, q.type_filter)))"""

TFIDF = f"""tt AS (SELECT doc_id, (('0x' || substr(md5(term), 1, 8))::BIGINT % {DIM})::BIGINT AS bucket FROM (SELECT doc_id, unnest({B.TOKENS.format('text')}) AS term FROM documents)),
tc AS (SELECT doc_id, bucket, count(*) AS tf FROM tt GROUP BY ALL),
ti AS (SELECT bucket, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM tc GROUP BY bucket),
tw AS (SELECT doc_id, bucket, tf * idf AS w FROM tc JOIN ti USING (bucket)),
tv AS (SELECT doc_id, bucket, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 0) AS value FROM tw)"""

VARIANT_DN = TFIDF + f""",
vt AS (SELECT qk, (('0x' || substr(md5(term), 1, 8))::BIGINT % {DIM})::BIGINT AS bucket
  FROM (SELECT query_id || '/' || variant AS qk, unnest({B.TOKENS.format('question')}) AS term FROM var)),
vw AS (SELECT qk, bucket, count(*) * any_value(idf) AS w FROM vt JOIN ti USING (bucket) GROUP BY qk, bucket),
vv AS (SELECT qk, bucket, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY qk)), 0) AS value FROM vw),
vdot AS (SELECT qk, doc_id, sum(vv.value * tv.value) AS dot FROM vv JOIN tv USING (bucket) GROUP BY ALL),
vpair AS (SELECT query_id, query_id || '/' || variant AS qk, doc_id FROM var, documents),
vd_top AS (SELECT query_id, qk, doc_id, row_number() OVER (PARTITION BY qk ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT p.query_id, p.qk, p.doc_id, round(coalesce(dot, 0), 6) AS score FROM vpair p LEFT JOIN vdot v ON v.qk = p.qk AND v.doc_id = p.doc_id))"""

ORACLES = {
    "bm25_term_stats": f"WITH {BM} SELECT term, df, round(idf, 6) AS idf FROM bx_stats",
    "bm25_topk": f"WITH {BM_TOP},\n{FILLED} SELECT query_id, doc_id, score, rank FROM filled WHERE rank <= 5",
    "bm25_all_scores": f"""WITH {BM} SELECT q.query_id, d.doc_id, coalesce(s.score, 0.0) AS score, 1::BIGINT AS n_docs
  FROM (SELECT DISTINCT query_id FROM qs) q CROSS JOIN (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN bm_scores s ON s.qk = q.query_id AND s.doc_id = d.doc_id""",
    "bm25_post_filter": f"WITH {BM_TOP},\n{FILLED} SELECT query_id, doc_id, score, rank FROM filled JOIN documents USING (doc_id) WHERE rank <= 5 AND lang = 'en'",
    "bm25_pre_filter": f"""WITH {BM}, r AS (SELECT qk AS query_id, doc_id, score, row_number() OVER (PARTITION BY qk ORDER BY score DESC, doc_id) AS rank
  FROM bm_scores JOIN documents USING (doc_id) WHERE lang = 'en') SELECT * FROM r WHERE rank <= 5""",
    "bm25_pair_scores": f"WITH {BM},\n{PAIRS} SELECT p.query_id, p.doc_id, coalesce(s.score, 0.0) AS score FROM pairs p LEFT JOIN bm_scores s ON s.qk = p.query_id AND s.doc_id = p.doc_id",
    "tokenize": f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, '|') AS tokens FROM (SELECT doc_id, {B.TOKENS.format('text')} AS t FROM documents)",
    "query_keywords": f"WITH {B.KEYWORD} SELECT query_id, len(kws) AS n, array_to_string(kws, '|') AS keywords FROM kq",
    "keyword_search": f"WITH {B.KEYWORD} SELECT *, 'keyword' AS retrieval_type FROM kw_hits",
    "keyword_topk": f"WITH {B.KEYWORD} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM kw_hits) WHERE rank <= 5",
    "substring_search": f"""WITH RECURSIVE {B.DOCS}, low AS (SELECT keyword AS term, doc_id, lower(content) AS c, lower(keyword) AS k FROM docs JOIN lex ON contains(lower(content), lower(keyword))),
o AS (SELECT term, doc_id, k, strpos(c, k) AS pos, substr(c, strpos(c, k) + 1) AS rest FROM low
  UNION ALL SELECT term, doc_id, k, pos + strpos(rest, k), substr(rest, strpos(rest, k) + 1) FROM o WHERE strpos(rest, k) > 0)
SELECT term, doc_id, count(*) AS match_count, array_to_string(list(pos - 1 ORDER BY pos)[1:5], '|') AS positions FROM o GROUP BY term, doc_id""",
    "gram_search": f"""WITH gw AS (SELECT DISTINCT unnest({B.TOKENS.format('text')}) AS w FROM benchmark), gt AS (SELECT w AS term FROM gw UNION SELECT substr(w, 1, 3) FROM gw)
SELECT term, count(*) AS n_docs, min(doc_id) AS first_doc, sum(doc_id)::BIGINT AS doc_sum FROM gt JOIN documents ON contains(text, term) GROUP BY term""",
    "cosine_pairs": """SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS similarity
  FROM embeddings a JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label) f USING (label) JOIN embeddings b ON b.vec_id = f.vec_id""",
    "semantic_search": """WITH cells AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings),
c AS (SELECT label, list(v ORDER BY pos) AS embedding FROM (SELECT label, pos, avg(v) AS v FROM cells GROUP BY ALL) GROUP BY label)
SELECT c.label::BIGINT AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(c.embedding, e.embedding::DOUBLE[]), 6) + 0.0 AS similarity, 'semantic' AS retrieval_type FROM c, embeddings e""",
    "semantic_floor": f"WITH {B.DENSE} SELECT query_id, doc_id, score AS similarity, 'semantic' AS retrieval_type FROM dn_scores WHERE score >= 0.3",
    "dense_topk": f"WITH {DN_TOP} SELECT query_id, doc_id, score, rank FROM dn_top WHERE rank <= 5",
    "cells_topk": f"WITH {DN_TOP} SELECT query_id, doc_id, score, rank FROM dn_top WHERE rank <= 5",
    "dense_filtered": f"""WITH {B.DENSE}, r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM dn_scores JOIN embeddings ON vec_id = doc_id WHERE label = 3) SELECT * FROM r WHERE rank <= 5""",
    "hybrid_merge": f"""WITH {B.KEYWORD},\n{B.DENSE}, s AS (SELECT query_id, doc_id, score AS similarity FROM dn_scores WHERE score >= 0.2 OR (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM kw_hits))
SELECT query_id, doc_id, coalesce(k.similarity, 0.0) AS keyword_similarity, coalesce(s.similarity, 0.0) AS semantic_similarity,
  CASE WHEN k.similarity IS NOT NULL AND s.similarity IS NOT NULL THEN round(k.similarity * 0.4 + s.similarity * 0.6, 6) ELSE coalesce(k.similarity, s.similarity) END AS similarity,
  CASE WHEN k.similarity IS NOT NULL AND s.similarity IS NOT NULL THEN 'hybrid' WHEN k.similarity IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS retrieval_type
  FROM kw_hits k FULL OUTER JOIN s USING (query_id, doc_id)""",
    "basic_retrieve": f"WITH {BASIC} SELECT query_id, doc_id, similarity, retrieval_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM kept) WHERE rank <= 5",
    "similarity_floor": f"WITH {B.KEYWORD} SELECT query_id, doc_id, similarity FROM kw_hits WHERE similarity >= 0.7",
    "filter_or_all": f"""WITH {B.QUESTIONS}, f AS (SELECT DISTINCT type_filter AS filter_value FROM qs),
h AS (SELECT filter_value, doc_id FROM f JOIN documents d ON contains(d.source, filter_value) OR contains(d.doc_id::VARCHAR, filter_value))
SELECT filter_value, doc_id, 1::BIGINT AS n_docs FROM h
UNION ALL SELECT filter_value, -1, (SELECT count(*) FROM documents) FROM f WHERE filter_value NOT IN (SELECT filter_value FROM h)""",
    "rrf_fusion": f"""WITH {LISTS}, f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (59 + rank)), 9) AS score, count(*) AS sources_count,
  string_agg(source || ':' || (rank - 1), '|' ORDER BY source, rank) AS sources FROM hits GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS final_rank FROM f""",
    "rrf_payload": f"""WITH {LISTS}, f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (59 + rank)), 9) AS score, max(source) AS seen_in FROM hits GROUP BY ALL)
SELECT f.query_id, f.doc_id, f.score, row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, f.doc_id) AS final_rank,
  d.text AS content, f.seen_in, 'class=' || d.lang AS about FROM f LEFT JOIN documents d USING (doc_id)""",
    "rrf_unbounded": f"""WITH {B.KEYWORD}, cells AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings),
c AS (SELECT label, list(v ORDER BY pos) AS embedding FROM (SELECT label, pos, avg(v) AS v FROM cells GROUP BY ALL) GROUP BY label),
plain AS (SELECT query_id, doc_id, round(least(sum(times) / greatest(any_value(len(kws)), 1) * 0.8, 1.0), 6) AS score
  FROM kt JOIN (SELECT query_id, kws FROM kq) USING (query_id) JOIN kd ON contains(content, lower(kw)) GROUP BY query_id, doc_id),
h AS (SELECT 'keyword' AS source, query_id, doc_id, score FROM plain UNION ALL
  SELECT 'dense', c.label::BIGINT, e.vec_id, round(list_cosine_similarity(c.embedding, e.embedding::DOUBLE[]), 6) FROM c, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY source, query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM h),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS sources_count FROM r GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS final_rank FROM f) SELECT * FROM o""",
    "weighted_rrf": f"""WITH {LISTS}, f AS (SELECT query_id, doc_id, round(sum(CASE WHEN source = 'bm25' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END / (59 + rank)), 9) AS score, count(*) AS sources_count FROM hits GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS final_rank FROM f""",
    "score_minmax": f"WITH {LISTS} " + NORM.format("CASE WHEN hi - lo = 0 THEN score ELSE round((score - lo) / (hi - lo), 6) END"),
    "score_zscore": f"WITH {LISTS} " + NORM.format("CASE WHEN sd = 0 THEN score ELSE round((score - mean) / sd, 6) END"),
    "query_expand": f"WITH {B.USER_TURNS} {variants_sql('us')}",
    "rewrite_batch": f"""WITH {B.USER_TURNS} SELECT query_id, question AS original_query,
  CASE WHEN query_id % 5 <= 2 THEN 'r' || query_id ELSE question END AS rewritten_query,
  CASE WHEN query_id % 5 <= 1 THEN 'a' || query_id || '|b' WHEN query_id % 5 = 2 THEN 'r' || query_id ELSE question END AS expanded_queries FROM us""",
    "rerank_topk": f"""WITH {BM_TEN}, cand AS (SELECT qk AS query_id, doc_id FROM bm_ten),\n{cover('cand')}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM covered) WHERE rank <= 5""",
    "pair_scores": f"WITH {BM},\n{PAIRS},\n{cover('pairs')} SELECT query_id, doc_id, score FROM covered",
    "model_rerank": f"""WITH {BM_TEN}, sc AS (SELECT b.qk AS query_id, b.doc_id, b.score AS old, b.rank AS before, {SHARE} AS score
    FROM bm_ten b JOIN qs q ON q.query_id = b.qk JOIN documents d USING (doc_id)),
o AS (SELECT query_id, doc_id, coalesce(score, old) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, -before) DESC, doc_id) AS rank FROM sc)
SELECT * FROM o WHERE rank <= 5""",
    "model_pair_scores": f"""WITH {B.QUESTIONS}, p AS (SELECT DISTINCT doc_id, doc_id % (SELECT count(*) FROM qs) AS query_id FROM labels)
SELECT query_id, doc_id, coalesce({SHARE}, 0.0) AS score FROM p JOIN qs q USING (query_id) JOIN documents d USING (doc_id)""",
    "loaded_pair_scores": f"""WITH {B.QUESTIONS}, p AS (SELECT DISTINCT doc_id, doc_id % (SELECT count(*) FROM qs) AS query_id FROM labels)
SELECT query_id, doc_id, {SHARE} AS score FROM p JOIN qs q USING (query_id) JOIN documents d USING (doc_id)""",
    "multi_query_rrf": f"""WITH {VARIANT_BM},\n{VARIANT_DN}, hits AS (SELECT query_id, doc_id, rank FROM vb_top WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, rank FROM vd_top WHERE rank <= 5),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (59 + rank)), 9) AS score, count(*) AS sources_count FROM hits GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS final_rank FROM f) SELECT * FROM o WHERE final_rank <= 10""",
    "graph_retrieve": f"""WITH {B.QUESTIONS},\n{B.WORD_GRAPH}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM gscores) SELECT * FROM r WHERE rank <= 10""",
    "hybrid_search": f"""WITH {VARIANT_BM},\n{VARIANT_DN},\n{B.WORD_GRAPH},
g_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM gscores),
hits AS (SELECT query_id, doc_id, rank FROM vb_top WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, rank FROM vd_top WHERE rank <= 10
  UNION ALL SELECT query_id, doc_id, rank FROM g_top WHERE rank <= 10),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (59 + rank)), 9) AS score FROM hits GROUP BY ALL),
cand AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS fr FROM f) WHERE fr <= 10),
bm_qt AS (SELECT query_id AS qk, term FROM (SELECT DISTINCT query_id, unnest({B.TOKENS.format('question')}) AS term FROM qs)),
{cover('cand')} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM covered) WHERE rank <= 5""",
    "tfidf_vectors": f"WITH {TFIDF} SELECT doc_id, bucket, round(value, 6) AS value FROM tv WHERE value <> 0",
    "routed_retrieve": f"WITH {ROUTED} SELECT query_id, category, doc_id, similarity, rank FROM routed",
}
