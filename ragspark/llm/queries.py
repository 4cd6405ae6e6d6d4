"""The operators of this package bound to the given tables, and the same as DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm.innerproduct import topk_inner_product
from ragspark.llm.jaccard import jaccard_groups
from ragspark.llm.licenses import scan_licenses
from ragspark.llm.manifest_sql import COLUMNS, manifest_sql
from ragspark.llm.merkle import merkle_manifest
from ragspark.llm.mixing import mix_sources
from ragspark.llm.packing import pack_documents
from ragspark.llm.perplexity import judge_perplexity
from ragspark.llm.quality import judge_quality
from ragspark.llm.repeats import remove_repeats
from ragspark.llm.sharding import shard_documents
from ragspark.llm.toxicity import score_toxicity
from ragspark.llm.urls import filter_urls
from ragspark.llm.whitening import whiten


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_karmarkar_karp(spark: SparkSession, sf: str) -> DataFrame:
    return shard_documents(table(spark, sf, "documents"), shards=40, overhead=16)


def op2_js_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return judge_quality(table(spark, sf, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_groups(table(spark, sf, "documents"), length=5, percent=80)


def op4_markov_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return filter_urls(table(spark, sf, "pages"))


def op5_binary_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"), tokenizer_file(), length=2048).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    return judge_perplexity(table(spark, sf, "documents"), table(spark, sf, "labels").where("quality = 1 AND toxic = 0"))


def op7_block_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(table(spark, sf, "documents").select("doc_id", "text"), window=20).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_fair_queueing(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_norm_sorted_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return topk_inner_product(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64)


def op10_license_bands(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(table(spark, sf, "documents"))


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whiten(table(spark, sf, "embeddings"), components=32, scale=64, shift=1_000_000)


def op12_merkle_witnesses(spark: SparkSession, sf: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    shown = [tampered if c == "text" else F.col(c) for c in COLUMNS]
    rows = merkle_manifest(table(spark, sf, "documents"), COLUMNS, "source", "doc_id", shown)
    as_hex = [F.lower(F.hex(c)).alias(name) for c, name in (
        ("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"), ("proof", "proof_sha256"), ("folded", "folded_root"))]
    return rows.select("doc_id", *as_hex, "verified")


def op13_tfidf_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    scored = score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels").where(remainder != 0))
    return scored.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


QUERIES = {
    "op1_karmarkar_karp": op1_karmarkar_karp,
    "op2_js_divergence": op2_js_divergence,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_markov_ratio": op4_markov_ratio,
    "op5_binary_packing": op5_binary_packing,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_block_anchors": op7_block_anchors,
    "op8_fair_queueing": op8_fair_queueing,
    "op9_norm_sorted_topk": op9_norm_sorted_topk,
    "op10_license_bands": op10_license_bands,
    "op11_whitening": op11_whitening,
    "op12_merkle_witnesses": op12_merkle_witnesses,
    "op13_tfidf_neighbours": op13_tfidf_neighbours,
}

WORD = r"[^\x20\x09-\x0D]+"

# 3: overlaps of all pairs that share an n-gram, then reachability.
_JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id LEFT JOIN k ON k.x = d.doc_id"""

# 7: every window, the first occurrence of each, the words under the others.
_REPEATS = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, unnest(list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i:i + 19], ' '))) AS s FROM w WHERE len(ws) >= 20),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM g),
x AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS i FROM f WHERE r > 1),
b AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN b USING (doc_id)"""

# 8: one window over each source, one over all entries.
_MIX = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
p AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
  sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened FROM s),
v AS (SELECT *, ((SELECT sum(source_size) FROM s) - filled)::DOUBLE / opened::DOUBLE AS level FROM p),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, (SELECT arg_min(level, 3 * source_size / weight) FROM v WHERE 3 * source_size >= level * weight) * weight) AS target FROM v),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) AS queued FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, unnest(range(1, least(3, floor(target / source_size) + 1)::BIGINT + 1)) AS round FROM q WHERE size > 0 AND target > 0),
f AS (SELECT *, sum(size) OVER (ORDER BY ((round - 1) * source_size + queued)::DOUBLE / target, o, coalesce(source, ''), round, doc_id, size ROWS UNBOUNDED PRECEDING) AS sent FROM e),
k AS (SELECT source, queued, count(*) AS times FROM f WHERE sent <= (SELECT sum(source_size) FROM s) GROUP BY ALL)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN coalesce(times, 0) ELSE 0 END * size)::BIGINT AS taken
FROM q LEFT JOIN k ON q.source IS NOT DISTINCT FROM k.source AND q.queued = k.queued"""

# 9: all scores of the stated queries.
_TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""

ORACLES = {
    "op3_ngram_jaccard": _JACCARD,
    "op7_block_anchors": _REPEATS,
    "op8_fair_queueing": _MIX,
    "op9_norm_sorted_topk": _TOPK,
    "op12_merkle_witnesses": manifest_sql(),
}
