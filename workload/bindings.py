"""The given tables in the shape the operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.operators.graph import edge_family, node_family
from ragspark.operators.lexical import Bm25Index, bm25_index
from ragspark.session import work_path
from ragspark.sources.corpus import tag_keywords
from ragspark.sources.store import ensure_graph
from workload import params as P


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- documents and questions ----

def documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, content, class, type."""
    return table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("content"), F.col("lang").alias("class"), F.col("source").alias("type"))


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [(c, i, w) for c, words in P.CLASS_KEYWORDS.items() for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "class string, ord int, keyword string")


def tagged_documents(spark: SparkSession, sf: str) -> DataFrame:
    return tag_keywords(documents(spark, sf), lexicon(spark))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, question, type_filter: every benchmark item, whole text."""
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("question"),
        F.concat(F.lit("src"), (F.col("item_id") % 25).cast("string")).alias("type_filter"),
    )


def user_turns(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, question: every user turn of the conversations."""
    return table(spark, sf, "conversations").where("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))


def doc_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The vector stored under each benchmark item's id."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return items.join(vectors, "query_id")


def label_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """query_id = label, embedding = mean vector of the label."""
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    means = cells.groupBy("label", "pos").agg(F.avg("v").alias("v"))
    return means.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("embedding"))


_INDEXES: dict[tuple[str, str], Bm25Index] = {}


def stored_index(spark: SparkSession, sf: str) -> Bm25Index:
    """The BM25 index of all documents: built and stored at first use, then reused by the session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = bm25_index(documents(spark, sf)).save(work_path(spark, "bm25"))
    return _INDEXES[key]


DOCS = f"""lex AS (SELECT * FROM {P.values([(c, i, w) for c, ws in P.CLASS_KEYWORDS.items() for i, w in enumerate(ws)])} t(class, ord, keyword)),
tags AS (SELECT d.doc_id, list(l.keyword ORDER BY l.ord) AS keywords FROM documents d JOIN lex l ON l.class = d.lang AND contains(d.text, l.keyword) GROUP BY d.doc_id),
docs AS (SELECT d.doc_id, d.text AS content, d.lang AS class, d.source AS type, coalesce(t.keywords, []) AS keywords FROM documents d LEFT JOIN tags t USING (doc_id))"""

QUESTIONS = "qs AS (SELECT item_id AS query_id, text AS question, 'src' || (item_id % 25) AS type_filter FROM benchmark)"

USER_TURNS = "us AS (SELECT conv_id * 1000 + turn AS query_id, text AS question FROM conversations WHERE role = 'user')"

TOKENS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def bm25_sql(source: str = "SELECT query_id AS qk, question FROM qs", name: str = "bm") -> str:
    """CTEs up to `{name}_scores` (qk, doc_id, score) of matching pairs, and `bx_stats`, for rows (qk, question)."""
    doc_side = f"""bx_tok AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents),
bx_post AS (SELECT doc_id, term, count(*) AS tf FROM bx_tok GROUP BY ALL),
bx_len AS (SELECT doc_id, len({TOKENS.format('text')}) AS doc_len FROM documents),
bx_n AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM bx_len),
bx_df AS (SELECT term, count(*) AS df FROM bx_post GROUP BY term),
bx_raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw_idf FROM bx_df, bx_n),
bx_stats AS (SELECT term, df, raw_idf, CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM bx_raw) ELSE raw_idf END AS idf FROM bx_raw)"""
    query_side = f"""{name}_q AS ({source}),
{name}_qt AS (SELECT qk, term, count(*) AS qtf FROM (SELECT qk, unnest({TOKENS.format('question')}) AS term FROM {name}_q) GROUP BY ALL),
{name}_scores AS (SELECT qk, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score
  FROM {name}_qt JOIN bx_stats USING (term) JOIN bx_post USING (term) JOIN bx_len USING (doc_id), bx_n GROUP BY qk, doc_id)"""
    return f"{doc_side},\n{query_side}"


DENSE = """qv AS (SELECT b.item_id AS query_id, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
dn_scores AS (SELECT q.query_id, e.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS score FROM qv q, embeddings e)"""

KEYWORD = DOCS + ",\n" + QUESTIONS + f""",
kq AS (SELECT query_id, question, list_filter(string_split_regex(trim(question, ' ' || chr(9) || chr(10) || chr(13)), '\\s+'), lambda x: length(x) >= 2 AND x NOT IN ({', '.join(P.text(s) for s in P.STOP)})) AS kws FROM qs),
kt AS (SELECT query_id, kw, count(*) AS times FROM (SELECT query_id, unnest(kws) AS kw FROM kq) GROUP BY ALL),
kd AS (SELECT doc_id, lower(content) AS content, keywords FROM docs),
leg AS (SELECT query_id, doc_id, kw, times AS points FROM kt JOIN kd ON contains(content, lower(kw))
  UNION ALL SELECT query_id, doc_id, kw, 2 FROM (SELECT doc_id, unnest(keywords) AS kw FROM kd) JOIN kq ON contains(lower(question), lower(kw))),
kw_hits AS (SELECT query_id, doc_id, sum(points)::BIGINT AS match_count,
    round(least(sum(points) / greatest(any_value(len(kws)), 1) * 0.8, 1.0), 6) AS similarity,
    array_to_string(list_sort(list_distinct(list(kw))), '|') AS matched_keywords
  FROM leg JOIN (SELECT query_id, kws FROM kq) USING (query_id) GROUP BY query_id, doc_id)"""


# ---- sessions and responses ----

def session_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations cut into sessions of up to five turns: session_id, seq, content, mode."""
    rows = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.floor(F.col("turn") / 5)).alias("session_id"),
        (F.col("turn") % 5 + 1).alias("seq"),
        "role",
        F.col("text").alias("content"),
    )
    return rows.join(sessions(spark, sf), "session_id")


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """session_id, mode: chosen so that the mode's plan has room for every turn of the session."""
    size = F.max(F.col("turn") % 5 + 1)
    counted = table(spark, sf, "conversations").groupBy(
        (F.col("conv_id") * 1000 + F.floor(F.col("turn") / 5)).alias("session_id")).agg(size.alias("n"))
    return counted.select("session_id", F.when(F.col("n") == 1, "simple").when(F.col("n") <= 4, "progressive")
                          .when(F.floor(F.col("session_id") / 1000) % 2 == 0, "parallel").otherwise("multi_perspective").alias("mode"))


AGENTS = ["craft_expert", "history_expert", "heritage_expert", "guest_expert"]


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """question_id, agent_name, ord, content, success: every turn is one agent's response."""
    agent = F.element_at(F.array(*[F.lit(a) for a in AGENTS]), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("question_id"),
        agent.alias("agent_name"),
        F.col("turn").alias("ord"),
        F.when(F.col("role") == "system", "").otherwise(F.col("text")).alias("content"),
        (F.col("role") != "assistant").alias("success"),
    )


SESSIONS = """se AS (SELECT conv_id * 1000 + turn // 5 AS session_id, max(turn % 5 + 1) AS n FROM conversations GROUP BY 1),
sm AS (SELECT session_id, CASE WHEN n = 1 THEN 'simple' WHEN n <= 4 THEN 'progressive' WHEN (session_id // 1000) % 2 = 0 THEN 'parallel' ELSE 'multi_perspective' END AS mode FROM se),
st AS (SELECT conv_id * 1000 + turn // 5 AS session_id, turn % 5 + 1 AS seq, role AS msg_role, text AS content FROM conversations)"""

RESPONSES = """rs AS (SELECT conv_id AS question_id, (['craft_expert', 'history_expert', 'heritage_expert', 'guest_expert'])[turn % 4 + 1] AS agent_name, turn AS ord,
  CASE WHEN role = 'system' THEN '' ELSE text END AS content, role <> 'assistant' AS success FROM conversations)"""


# ---- graph ----

def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes from the dimensions; edges from the foreign keys and the distinct supplier-part pairs."""
    t = lambda name: table(spark, sf, name)
    step = 10**12
    families = [
        node_family(t("part"), _key("P:", "p_partkey"), F.col("p_name"), "part",
                    {"brand": F.col("p_brand"), "kind": F.col("p_type"), "size": F.col("p_size"), "price": F.col("p_size")}, F.col("p_partkey")),
        node_family(t("supplier"), _key("S:", "s_suppkey"), F.col("s_name"), "supplier", {"nation": F.col("s_nationkey")}, F.col("s_suppkey") + step),
        node_family(t("customer"), _key("C:", "c_custkey"), F.col("c_name"), "customer", {"segment": F.col("c_mktsegment")}, F.col("c_custkey") + 2 * step),
        node_family(t("nation"), _key("N:", "n_nationkey"), F.col("n_name"), "nation", {}, F.col("n_nationkey") + F.lit(3 * step)),
        node_family(t("region"), _key("R:", "r_regionkey"), F.col("r_name"), "region", {}, F.col("r_regionkey") + F.lit(4 * step)),
    ]
    nodes = families[0]
    for family in families[1:]:
        nodes = nodes.unionByName(family)
    supplies = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    links = [
        edge_family(supplies, _key("S:", "l_suppkey"), _key("P:", "l_partkey"), "supplies", F.col("l_suppkey") * 1_000_000 + F.col("l_partkey")),
        edge_family(t("supplier"), _key("S:", "s_suppkey"), _key("N:", "s_nationkey"), "located_in", F.col("s_suppkey") + step * 100),
        edge_family(t("customer"), _key("C:", "c_custkey"), _key("N:", "c_nationkey"), "located_in", F.col("c_custkey") + step * 200),
        edge_family(t("nation"), _key("N:", "n_nationkey"), _key("R:", "n_regionkey"), "part_of", F.col("n_nationkey") + F.lit(step * 300)),
    ]
    edges = links[0]
    for link in links[1:]:
        edges = edges.unionByName(link)
    return nodes, edges


_GRAPHS: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def stored_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The graph as stored tables: written at first use, then loaded by every query of the session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _GRAPHS:
        nodes, edges, _ = ensure_graph(spark, work_path(spark, "graph-tables"), lambda: graph(spark, sf))
        _GRAPHS[key] = (nodes, edges)
    return _GRAPHS[key]


def bought_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Who buys from whom."""
    bought = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(
        table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey"
    ).select("o_custkey", "l_suppkey").distinct()
    return edge_family(bought, _key("C:", "o_custkey"), _key("S:", "l_suppkey"), "buys_from", F.col("o_custkey"))


def trade_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The graph's edges and who buys from whom."""
    _, edges = stored_graph(spark, sf)
    return edges.unionByName(bought_edges(spark, sf))


GRAPH = """nodes AS (SELECT 'P:' || p_partkey AS id, p_name AS name, 'part' AS type, p_partkey::BIGINT AS ord FROM part
  UNION ALL SELECT 'S:' || s_suppkey, s_name, 'supplier', s_suppkey + 1000000000000 FROM supplier
  UNION ALL SELECT 'C:' || c_custkey, c_name, 'customer', c_custkey + 2000000000000 FROM customer
  UNION ALL SELECT 'N:' || n_nationkey, n_name, 'nation', n_nationkey + 3000000000000 FROM nation
  UNION ALL SELECT 'R:' || r_regionkey, r_name, 'region', r_regionkey + 4000000000000 FROM region),
edges AS (SELECT DISTINCT 'S:' || l_suppkey AS source, 'P:' || l_partkey AS target, 'supplies' AS relation FROM lineitem
  UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'located_in' FROM supplier
  UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'located_in' FROM customer
  UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, 'part_of' FROM nation)"""


# ---- a graph of words that follow each other in the benchmark texts ----

def word_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes are the benchmark words, edges lead from a word to the next one."""
    from ragspark.functions.text import tokenize

    items = table(spark, sf, "benchmark").select(tokenize(F.col("text"), "words").alias("w"))
    words = items.select(F.explode("w").alias("name")).distinct()
    nodes = words.select(F.concat(F.lit("W:"), "name").alias("id"), "name", F.lit("word").alias("type"))
    pairs = items.where(F.size("w") >= 2).select(
        F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("p"))
    edges = pairs.select(F.concat(F.lit("W:"), "p.a").alias("source"), F.concat(F.lit("W:"), "p.b").alias("target"),
                         F.lit("followed_by").alias("relation")).distinct()
    return nodes, edges


WORD_GRAPH = f"""wi AS (SELECT item_id, {TOKENS.format('text')} AS w FROM benchmark),
wl AS (SELECT item_id, unnest(w) AS name, unnest(range(1, len(w) + 1)) AS pos FROM wi),
wnodes AS (SELECT DISTINCT name FROM wl),
wedges AS (SELECT DISTINCT a.name AS source, b.name AS target FROM wl a JOIN wl b ON a.item_id = b.item_id AND b.pos = a.pos + 1),
gfound AS (SELECT q.query_id, n.name FROM qs q JOIN wnodes n ON contains(q.question, n.name)),
garound AS (SELECT DISTINCT f.query_id, e.target AS neighbor FROM gfound f JOIN wedges e ON e.source = f.name),
gscores AS (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM garound JOIN documents d ON contains(d.text, neighbor) GROUP BY ALL)"""
