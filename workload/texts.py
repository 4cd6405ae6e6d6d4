"""Sources, text scalars, maintenance and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.functions import text as X
from ragspark.lexicons import AGENT_TYPES
from ragspark.operators import classify, filters, lexical, maintain
from ragspark.operators.segments import SegmentedIndex
from ragspark.session import work_path
from ragspark.sources import corpus, graph_files, store
from ragspark.sources.metadata import path_value, variant_metadata, where_metadata
from ragspark.streaming import ingest
from workload import bindings as B
from workload import params as P

PER_FILE = 25  # documents per corpus file in the file-reading queries


# ---- sources ----

def _bucket():
    return F.floor(F.col("doc_id") / PER_FILE).alias("bucket")


def corpus_scan(spark, sf):
    """Documents written as text files, a few per file, read back as one document per file and cleaned."""
    path = work_path(spark, "corpus")
    lines = B.table(spark, sf, "documents").select("doc_id", _bucket(), "text").repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    lines.select("bucket", "text").write.partitionBy("bucket").text(path)
    files = corpus.read_corpus(spark, path).withColumn("doc_id", F.regexp_extract("path", r"bucket=(\d+)", 1))
    rows = corpus.document_rows(files)
    return rows.select(F.col("doc_id").cast("long").alias("bucket"), "content", F.col("metadata.line_count").alias("line_count"))


def json_doc_scan(spark, sf):
    """One JSON file per few documents; every third file has no content."""
    path = work_path(spark, "json")
    packed = B.table(spark, sf, "documents").groupBy(_bucket()).agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("d"))
    content = F.when(F.col("bucket") % 3 != 0, F.array_join(F.col("d.text"), "\n"))
    packed.select("bucket", F.to_json(F.struct(content.alias("content"), F.lit("x").alias("title"))).alias("value")).repartition(
        "bucket").write.partitionBy("bucket").text(path)
    files = corpus.read_json_docs(spark, path)
    return files.select(F.regexp_extract("path", r"bucket=(\d+)", 1).cast("long").alias("bucket"), "content")


def _file_name():
    return F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name")


def manifest_missing(spark, sf):
    files = B.table(spark, sf, "labels").select(_file_name())
    manifest = B.table(spark, sf, "documents").select(_file_name(), F.col("lang").alias("class"))
    present, missing = corpus.join_manifest(files, manifest)
    return present.select("file_name", "class", F.lit("present").alias("state")).unionByName(missing.select("file_name", "class", F.lit("missing").alias("state")))


def format_quarantine(spark, sf):
    kinds = F.array(*[F.lit(s) for s in (".txt", ".md", ".json", ".pdf", ".docx")])
    files = B.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("/in/"), "source", F.lit("/d."), F.col("doc_id").cast("string"), F.element_at(kinds, (F.length("text") % 5 + 1).cast("int"))).alias("path"))
    good, bad = corpus.route_by_format(files)
    return good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))


def profile_dim(spark, sf):
    """Profile files, one per nation, with nested preferences and example questions, read back."""
    path = work_path(spark, "profiles")
    people = B.table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("c_mktsegment")).alias("q"))
    rows = B.table(spark, sf, "nation").join(people, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.struct(
            F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"),
            F.struct(F.when(F.col("n") > 60, "long").otherwise("short").alias("length"), (F.col("n") % 2 == 0).alias("include_examples")).alias("content_preferences"),
            F.col("q").alias("example_questions")).alias("p"))
    rows.select(F.to_json(F.struct(F.array("p").alias("profiles"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    out = graph_files.read_profiles(spark, path)
    return out.select("id", "name", "content_preferences.length", "content_preferences.include_examples", F.array_join("example_questions", "|").alias("questions"))


def index_reuse(spark, sf):
    path = work_path(spark, "terms")
    build = lambda: lexical.bm25_index(B.documents(spark, sf)).term_stats.select("term", "df")
    store.ensure_table(spark, path, build)
    table, reused = store.ensure_table(spark, path, build)
    return table.agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings")).withColumn("reused", F.lit(reused))


def metadata_scalar(spark, sf):
    docs = B.tagged_documents(spark, sf).select("doc_id", F.struct("class", F.length("content").alias("chars"), "keywords").alias("metadata"))
    out = store.scalarise_metadata(docs)
    return out.select("doc_id", *[F.col("metadata")[k].alias(k) for k in ("class", "chars", "keywords")])


def variant_filter(spark, sf):
    """Nested metadata of every document, stored as VARIANT and filtered by paths: long or tagged documents of one language family."""
    docs = B.tagged_documents(spark, sf)
    nested = F.to_json(F.struct(F.struct("class", F.col("type").alias("origin")).alias("from"), F.struct(F.length("content").alias("chars")).alias("size"), F.col("keywords").alias("tags")))
    path = work_path(spark, "variant")
    variant_metadata(docs.select("doc_id", nested.alias("metadata"))).write.mode("overwrite").parquet(path)
    kept = where_metadata(spark.read.parquet(path), [("$.from.class", "in", ["en", "fr"]), ("$.size.chars", ">=", 400), ("$.tags[0]", "exists")])
    value = F.col("metadata")
    return kept.select("doc_id", path_value(value, "$.from.origin", "string").alias("origin"), path_value(value, "$.size.chars", "long").alias("chars"),
                       path_value(value, "$.tags[0]", "string").alias("first_tag"))


def uploads(spark, sf):
    """Two documents share an upload id; the later time wins. Spanish ones come as a type not allowed."""
    kind = F.when(F.col("lang") == "en", "text/plain").when(F.col("lang") == "fr", "text/markdown").when(F.col("lang") == "de", "application/json").otherwise("application/pdf")
    return B.table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 2).cast("string").alias("doc_id"), kind.alias("content_type"), F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("uploaded_at"))


def _ingested(spark, sf):
    folder = work_path(spark, "uploads")
    uploads(spark, sf).repartition(4).write.parquet(f"{folder}/in")
    query = ingest.ingest_uploads(ingest.read_uploads(spark, f"{folder}/in", 2), f"{folder}/store", f"{folder}/checkpoint")
    query.awaitTermination()
    return f"{folder}/store"


def upload_ingest(spark, sf):
    stored = _ingested(spark, sf)
    good = ingest.current_documents(spark, stored).select("doc_id", F.length("content").cast("long").alias("chars"), F.lit("stored").alias("state"))
    bad = ingest.quarantined(spark, stored).select("doc_id", F.length("content").cast("long").alias("chars"), F.lit("quarantined").alias("state"))
    return good.unionByName(bad)


def upload_terms(spark, sf):
    """Term statistics of the ingested documents, from the postings the stream kept."""
    postings = ingest.current_postings(spark, _ingested(spark, sf))
    return lexical.index_of_postings(postings).term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


def upload_compacted(spark, sf):
    """Two deliveries with a compaction between them: the second version of each upload id comes after it."""
    folder = work_path(spark, "uploads")
    state = f"{folder}/store"
    for late in (0, 1):
        uploads(spark, sf).where(F.timestamp_diff("SECOND", F.timestamp_seconds(F.lit(1_700_000_000)), "uploaded_at") % 2 == late).repartition(2).write.mode("append").parquet(f"{folder}/in")
        ingest.ingest_uploads(ingest.read_uploads(spark, f"{folder}/in"), state, f"{folder}/checkpoint").awaitTermination()
        if late == 0:
            ingest.compact(spark, state)
    return ingest.current_documents(spark, state).select("doc_id", F.md5(F.col("content").cast("binary")).alias("digest"), F.length("content").cast("long").alias("chars"))


# ---- maintenance ----

def doc_upsert(spark, sf):
    base = B.table(spark, sf, "documents").select("doc_id", "text", "lang")
    delta = B.table(spark, sf, "benchmark").select((F.col("item_id") * 30).alias("doc_id"), "text", F.lit("new").alias("lang"))
    return maintain.upsert_docs(base, delta).select("doc_id", "lang", F.length("text").cast("long").alias("chars"))


def doc_delete(spark, sf):
    forms = F.when(F.col("lang") == "en", F.array(F.lit(".json"), F.lit(".txt"))).when(F.col("lang") == "fr", F.array(F.lit(".md"), F.lit(".json"))).otherwise(F.array(F.lit(".json")))
    files = B.table(spark, sf, "documents").select("doc_id", F.explode(forms).alias("suffix"))
    return maintain.delete_docs(files, B.table(spark, sf, "labels").where("toxic = 1"))


def doc_by_id(spark, sf):
    return maintain.docs_by_id(B.documents(spark, sf), B.table(spark, sf, "labels").where("quality = 1")).select("doc_id", "class", "type")


def doc_by_type(spark, sf):
    labels = B.table(spark, sf, "labels")
    mapping = labels.select(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("type"), "doc_id")
    asked = labels.select(F.concat(F.lit("q"), (F.col("quality") + F.col("toxic")).cast("string")).alias("type"))
    return maintain.docs_by_type(B.documents(spark, sf).drop("type"), mapping, asked).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))


def index_add(spark, sf):
    """The index of the English documents, completed with all documents."""
    docs = B.documents(spark, sf)
    index = maintain.index_add(lexical.bm25_index(docs.where("class = 'en'")), docs)
    return index.term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


def index_segments(spark, sf):
    """English documents as base, all others added, toxic ones removed, questions added, and all of it merged."""
    docs = B.documents(spark, sf)
    index = SegmentedIndex.create(docs.where("class = 'en'"), work_path(spark, "segments"), lexical.buckets_for(docs)).add(docs)
    index, _ = index.remove(B.table(spark, sf, "labels").where("toxic = 1"))
    asked = B.questions(spark, sf).select((F.col("query_id") + 10_000_000).alias("doc_id"), F.col("question").alias("content"))
    return index.add(asked).merge().index().term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


def index_append(spark, sf):
    docs = B.documents(spark, sf).select("doc_id", "content")
    more = B.questions(spark, sf).select(F.col("query_id").alias("doc_id"), F.col("question").alias("content"))
    return maintain.index_append(docs, more).select("doc_id", F.length("content").cast("long").alias("chars"))


def index_remove(spark, sf):
    """Toxic documents and, as ids not found, every benchmark item shifted out of range."""
    gone = B.table(spark, sf, "labels").where("toxic = 1").select("doc_id").unionByName(
        B.table(spark, sf, "benchmark").select((F.col("item_id") + 10_000_000).alias("doc_id")))
    kept, found = maintain.index_remove(B.stored_index(spark, sf), gone)
    rows = found.select("doc_id", F.col("found").cast("string").alias("state"))
    return rows.unionByName(kept.doc_len.select("doc_id", F.lit("kept").alias("state")))


def letter_vectors(todo):
    """A stand-in for a model: counts of five letters, computed in the JVM."""
    counts = F.array(*[F.regexp_count("text", F.lit(c)).cast("float") for c in "aeiou"])
    return todo.select("text_hash", counts.alias("embedding"))


def embed_missing(spark, sf):
    texts = B.table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    known = texts.join(B.table(spark, sf, "labels").select(F.col("doc_id").alias("text_id")), "text_id", "left_semi")
    stored = letter_vectors(known.select(F.sha2("text", 256).alias("text_hash"), "text").dropDuplicates(["text_hash"]))
    out = maintain.embed_missing(texts, stored, letter_vectors)
    return out.select("text_id", "reused", F.array_join(F.transform("embedding", lambda v: v.cast("int").cast("string")), ",").alias("embedding"))


# ---- text scalars ----

def _docs(spark, sf):
    return B.table(spark, sf, "documents")


def _spaced(col="text"):
    return F.replace(F.col(col), F.lit(". "), F.lit(".\n  \t\n "))


def text_clean(spark, sf):
    return _docs(spark, sf).select("doc_id", X.clean_text(_spaced()).alias("content"))


def text_stats(spark, sf):
    return _docs(spark, sf).select("doc_id", X.char_count(F.col("text")).alias("char_count"), X.line_count(F.col("text")).alias("line_count"))


def code_lookup(spark, sf):
    dim = spark.createDataFrame(list(P.CLASS_NAMES.items()), "key string, name string")
    return corpus.lookup_or_self(_docs(spark, sf).select("doc_id", "lang"), dim, "lang").select("doc_id", "lang", "name")


def keyword_tags(spark, sf):
    return B.tagged_documents(spark, sf).select("doc_id", F.array_join("keywords", "|").alias("keywords"))


def excerpt(spark, sf):
    return _docs(spark, sf).select("doc_id", X.excerpt(F.col("text"), 1000).alias("shown"), X.excerpt(F.col("text"), 300, True).alias("cut"))


def reading_time(spark, sf):
    return _docs(spark, sf).select("doc_id", X.reading_time(F.col("text")).alias("minutes"))


def toc_extract(spark, sf):
    profile = F.element_at(F.array(F.lit("curious"), F.lit("learner"), F.lit("researcher")), (F.col("doc_id") % 3 + 1).cast("int"))
    headed = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\n 2 ")), F.lit(" the "), F.lit("\n#"))
    return _docs(spark, sf).select("doc_id", X.add_toc(headed, profile).alias("content"))


def _reply():
    body = F.concat(F.lit('{"intent_analysis": "i'), F.col("doc_id").cast("string"), F.lit('", "required_experts": ["craft_expert"], "complexity": "'), "lang", F.lit('"}'))
    kind = F.col("doc_id") % 6
    return (
        F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone.\n```")))
        .when(kind == 1, F.concat(F.lit("```\n"), body, F.lit("\n```")))
        .when(kind == 2, body)
        .when(kind == 3, F.concat(F.lit("```json\n"), body))
        .when(kind == 4, F.lit('{"intent_analysis": "x", "required_experts": []}'))
        .otherwise(F.concat(F.lit("I think "), "text"))
    )


def fenced_json(spark, sf):
    return _docs(spark, sf).select("doc_id", F.coalesce(X.fenced_json(_reply()), F.lit("<null>")).alias("body"))


def strip_fences(spark, sf):
    return _docs(spark, sf).select("doc_id", X.strip_fences(_reply()).alias("body"))


def reply_parse(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.col("text").alias("question"), _reply().alias("reply"))
    out = classify.parse_analysis(rows, routes=P.ROUTES)
    return out.select("doc_id", "intent_analysis", F.array_join("required_experts", "|").alias("experts"), "reasoning", "complexity", "from_reply")


def reference_extract(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(X.extract_references(F.col("text"), P.REFERENCE_PATTERNS), "|").alias("refs"))


def label_lookup(spark, sf):
    return B.responses(spark, sf).select("question_id", "ord", X.label_of(F.col("agent_name"), AGENT_TYPES, F.lit("未知专家")).alias("label"))


def bibliography(spark, sf):
    """Per document, its languages and sources as two references, one without title or author at times."""
    sources = F.array(
        F.struct(F.when(F.col("lang") != "es", F.col("lang")).alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("author")),
        F.struct(F.col("source").alias("title"), F.lit("").alias("author")))
    return _docs(spark, sf).select("doc_id", X.bibliography(sources).alias("text"))


def usable_responses(spark, sf):
    return filters.usable_responses(B.responses(spark, sf)).select("question_id", "ord", "agent_name")


def profile_validate(spark, sf):
    """Market segments as profile ids."""
    return filters.valid_profile(B.table(spark, sf, "customer").select("c_custkey", F.lower("c_mktsegment").alias("user_profile")),
                                 profiles=["building", "machinery", "household"])


# ---- statistics ----

def corpus_summary(spark, sf):
    return maintain.corpus_summary(B.documents(spark, sf), name="class").withColumn("class", F.coalesce("class", F.lit("*")))


def top_keywords(spark, sf):
    return maintain.top_keywords(B.tagged_documents(spark, sf))


def index_coverage(spark, sf):
    return maintain.index_coverage(B.documents(spark, sf), B.table(spark, sf, "labels"))


def index_clear(spark, sf):
    """Documents in a stored table, after clearing it, and after the next build."""
    path = work_path(spark, "cleared")
    build = lambda: B.documents(spark, sf).select("doc_id", F.length("content").alias("chars"))
    count = F.count(F.lit(1))
    before = store.ensure_table(spark, path, build)[0].agg(count).first()[0]
    store.clear_table(spark, path)
    after = spark.read.parquet(path).agg(count).first()[0]
    table, reused = store.ensure_table(spark, path, build)
    return table.agg(count.alias("rebuilt"), F.sum("chars").alias("chars")).select(
        F.lit(before).cast("long").alias("before"), F.lit(after).cast("long").alias("after"), "rebuilt", "chars", F.lit(reused).alias("reused"))


def index_count(spark, sf):
    return maintain.index_count(B.stored_index(spark, sf))


QUERIES = {f.__name__: f for f in (
    corpus_scan, json_doc_scan, manifest_missing, format_quarantine, profile_dim, index_reuse, metadata_scalar, variant_filter, upload_ingest, upload_terms, upload_compacted,
    doc_upsert, doc_delete, doc_by_id, doc_by_type, index_add, index_segments, index_append, index_remove, embed_missing, text_clean, text_stats, code_lookup,
    keyword_tags, excerpt, reading_time, toc_extract, fenced_json, strip_fences, reply_parse, reference_extract, label_lookup, bibliography,
    usable_responses, profile_validate, corpus_summary, top_keywords, index_coverage, index_clear, index_count)}

NL = "chr(10)"
STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
CLEAN = f"array_to_string(list_filter(list_transform(string_split({{}}, {NL}), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), {NL})"
REPLY = """rp AS (SELECT doc_id, text AS question, CASE doc_id % 6
  WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' || chr(10) || 'Done.' || chr(10) || '```'
  WHEN 1 THEN '```' || chr(10) || body || chr(10) || '```' WHEN 2 THEN body WHEN 3 THEN '```json' || chr(10) || body
  WHEN 4 THEN '{"intent_analysis": "x", "required_experts": []}' ELSE 'I think ' || text END AS reply, body, lang
  FROM (SELECT *, '{"intent_analysis": "i' || doc_id || '", "required_experts": ["craft_expert"], "complexity": "' || lang || '"}' AS body FROM documents))"""
_route_legs = ", ".join(f"CASE WHEN {P.any_of('question', ws)} THEN [{P.text(c)}] ELSE [] END" for c, ws in P.ROUTES)
CATS = f"(CASE WHEN len(flatten([{_route_legs}])) > 0 THEN flatten([{_route_legs}]) ELSE ['craft_expert'] END)"
NAMES = "CASE x WHEN 'craft_expert' THEN '技艺知识Agent' WHEN 'history_expert' THEN '历史文化Agent' WHEN 'heritage_expert' THEN '传承现状Agent' ELSE x END"
UPLOADS = """up AS (SELECT (doc_id // 2)::VARCHAR AS doc_id, doc_id AS ts, text AS content, lang FROM documents),
good AS (SELECT doc_id, arg_max(content, ts) AS content FROM up WHERE lang <> 'es' GROUP BY doc_id)"""


def idf_sql(source: str) -> str:
    """SELECT of term, df, idf for rows (doc_id, content)."""
    return f"""SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * (avg(raw) OVER ()) ELSE raw END, 6) AS idf FROM (
  SELECT term, df, ln((SELECT count(*) FROM {source}) - df + 0.5) - ln(df + 0.5) AS raw FROM (
  SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({B.TOKENS.format('content')}) AS term FROM {source}) GROUP BY term))"""


ORACLES = {
    "corpus_scan": f"""SELECT bucket, content, length(content) - length(replace(content, {NL}, '')) + 1 AS line_count FROM (
  SELECT bucket, {CLEAN.format('t')} AS content FROM (SELECT doc_id // {PER_FILE} AS bucket, string_agg(text, {NL} ORDER BY doc_id) AS t FROM documents GROUP BY 1))""",
    "json_doc_scan": f"SELECT doc_id // {PER_FILE} AS bucket, CASE WHEN any_value(doc_id // {PER_FILE}) % 3 <> 0 THEN string_agg(text, {NL} ORDER BY doc_id) ELSE '' END AS content FROM documents GROUP BY 1",
    "manifest_missing": "SELECT 'doc_' || doc_id || '.txt' AS file_name, lang AS class, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'present' ELSE 'missing' END AS state FROM documents",
    "format_quarantine": "SELECT doc_id, '/in/' || source || '/d.' || doc_id || s AS path, s AS suffix, s IN ('.txt', '.md', '.json') AS accepted FROM (SELECT *, (['.txt', '.md', '.json', '.pdf', '.docx'])[length(text) % 5 + 1] AS s FROM documents)",
    "profile_dim": """SELECT 'p' || n_nationkey AS id, n_name AS name, CASE WHEN n > 60 THEN 'long' ELSE 'short' END AS length, n % 2 = 0 AS include_examples, q AS questions
  FROM nation JOIN (SELECT c_nationkey, count(*) AS n, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS q FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""",
    "index_reuse": f"SELECT count(DISTINCT term) AS terms, count(*) AS postings, true AS reused FROM (SELECT DISTINCT doc_id, unnest({B.TOKENS.format('text')}) AS term FROM documents)",
    "metadata_scalar": f"""WITH {B.DOCS} SELECT doc_id, class, length(content)::VARCHAR AS chars, CASE WHEN len(keywords) = 0 THEN '[]' ELSE '["' || array_to_string(keywords, '","') || '"]' END AS keywords FROM docs""",
    "variant_filter": f"WITH {B.DOCS} SELECT doc_id, type AS origin, length(content) AS chars, keywords[1] AS first_tag FROM docs WHERE class IN ('en', 'fr') AND length(content) >= 400 AND len(keywords) > 0",
    "upload_ingest": f"WITH {UPLOADS} SELECT doc_id, length(content) AS chars, 'stored' AS state FROM good UNION ALL SELECT doc_id, length(content), 'quarantined' FROM up WHERE lang = 'es'",
    "upload_compacted": f"WITH {UPLOADS} SELECT doc_id, md5(content) AS digest, length(content) AS chars FROM good",
    "upload_terms": f"WITH {UPLOADS} {idf_sql('good')}",
    "doc_upsert": """SELECT doc_id, lang, length(text) AS chars FROM documents WHERE doc_id NOT IN (SELECT item_id * 30 FROM benchmark)
UNION ALL SELECT item_id * 30, 'new', length(text) FROM benchmark""",
    "doc_delete": """WITH f AS (SELECT doc_id, unnest(CASE lang WHEN 'en' THEN ['.json', '.txt'] WHEN 'fr' THEN ['.md', '.json'] ELSE ['.json'] END) AS suffix FROM documents),
d AS (SELECT doc_id, arg_min(suffix, list_position(['.txt', '.md', '.json'], suffix)) AS suffix FROM f WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id)
SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = f.doc_id AND d.suffix = f.suffix)""",
    "doc_by_id": "SELECT doc_id, lang AS class, source AS type FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "doc_by_type": """WITH m AS (SELECT 'q' || quality AS type, doc_id FROM labels), a AS (SELECT DISTINCT 'q' || (quality + toxic) AS type FROM labels)
SELECT type, doc_id, 1::BIGINT AS n_docs FROM m JOIN a USING (type) JOIN documents USING (doc_id)
UNION ALL SELECT type, -1, (SELECT count(*) FROM documents) FROM a WHERE type NOT IN (SELECT type FROM m)""",
    "index_add": "WITH d AS (SELECT doc_id, text AS content FROM documents) " + idf_sql("d"),
    "index_segments": """WITH d AS (SELECT doc_id, text AS content FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION ALL SELECT item_id + 10000000, text FROM benchmark) """ + idf_sql("d"),
    "index_append": "SELECT doc_id, length(text) AS chars FROM documents UNION ALL SELECT item_id, length(text) FROM benchmark",
    "index_remove": """WITH g AS (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT item_id + 10000000 FROM benchmark)
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM documents) THEN 'true' ELSE 'false' END AS state FROM g
UNION ALL SELECT doc_id, 'kept' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g)""",
    "embed_missing": """SELECT doc_id AS text_id, text IN (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS reused,
  array_to_string([length(text) - length(replace(text, c, '')) for c in ['a', 'e', 'i', 'o', 'u']], ',') AS embedding FROM documents""",
    "text_clean": f"SELECT doc_id, {CLEAN.format(chr(39) + chr(39) + ' || s')} AS content FROM (SELECT doc_id, replace(text, '. ', '.' || {NL} || '  ' || chr(9) || {NL} || ' ') AS s FROM documents)",
    "text_stats": f"SELECT doc_id, length(text) AS char_count, len(string_split(text, {NL})) AS line_count FROM documents",
    "code_lookup": f"SELECT doc_id, lang, coalesce(name, lang) AS name FROM documents LEFT JOIN {P.values(P.CLASS_NAMES.items())} t(key, name) ON key = lang",
    "keyword_tags": f"WITH {B.DOCS} SELECT doc_id, array_to_string(keywords, '|') AS keywords FROM docs",
    "excerpt": "SELECT doc_id, CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...' ELSE text END AS shown, left(text, 300) || '...' AS cut FROM documents",
    "reading_time": "SELECT doc_id, greatest(1, length(text) // 400) AS minutes FROM documents",
    "toc_extract": f"""WITH t AS (SELECT doc_id, replace(replace(text, '. ', '.' || {NL} || ' 2 '), ' the ', {NL} || '#') AS c FROM documents),
e AS (SELECT doc_id, c, list_transform(list_filter(list_transform(string_split(c, {NL}), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: regexp_matches(x, '^(#|\\p{{Nd}})') AND length(x) > 3), lambda x: '- ' || left(x, 50))[1:10] AS h FROM t)
SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND len(h) > 0 THEN '## 目录' || {NL} || array_to_string(h, {NL}) || {NL} || {NL} || '---' || {NL} || {NL} || c ELSE c END AS content FROM e""",
    "fenced_json": f"WITH {REPLY} SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN body WHEN 1 THEN body WHEN 3 THEN '<null>' ELSE reply END AS body FROM rp",
    "strip_fences": f"""WITH {REPLY} SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Here:' || {NL} || '```json' || {NL} || body || {NL} || '```' || {NL} || 'Done.'
  WHEN 1 THEN body WHEN 3 THEN body ELSE {STRIP.format('reply')} END AS body FROM rp""",
    "reply_parse": f"""WITH {REPLY}, c AS (SELECT *, {CATS} AS cats, doc_id % 6 <= 2 AS ok FROM rp)
SELECT doc_id, CASE WHEN ok THEN 'i' || doc_id ELSE '根据关键词分析，该问题涉及' || array_to_string(list_transform(cats, lambda x: {NAMES}), '、') || '领域' END AS intent_analysis,
  CASE WHEN ok THEN 'craft_expert' ELSE array_to_string(cats, '|') END AS experts,
  CASE WHEN ok THEN '' ELSE '问题中检测到相关领域关键词，因此分配' || len(cats) || '个专家Agent处理' END AS reasoning,
  CASE WHEN ok THEN lang ELSE (['simple', 'medium', 'complex'])[len(cats)] END AS complexity, ok AS from_reply FROM c""",
    "reference_extract": "SELECT doc_id, array_to_string(list_concat(" + ", ".join(
        f"regexp_extract_all(text, {P.text(p).replace(chr(92) + 'n', chr(92) + 'n')}, 1)" for p in P.REFERENCE_PATTERNS) + ")[1:5], '|') AS refs FROM documents",
    "label_lookup": f"WITH {B.RESPONSES} SELECT question_id, ord, CASE agent_name WHEN 'craft_expert' THEN '技艺知识专家' WHEN 'history_expert' THEN '历史文化专家' WHEN 'heritage_expert' THEN '传承现状专家' ELSE '未知专家' END AS label FROM rs",
    "bibliography": f"""SELECT doc_id, '1. ' || CASE WHEN lang <> 'es' THEN lang ELSE '未知来源' END || CASE WHEN doc_id % 2 = 0 THEN ' - ' || source ELSE '' END || {NL} || '2. ' || source AS text FROM documents""",
    "usable_responses": f"WITH {B.RESPONSES} SELECT question_id, ord, agent_name FROM rs WHERE success AND length(content) > 0",
    "profile_validate": "SELECT c_custkey, lower(c_mktsegment) AS user_profile, lower(c_mktsegment) IN ('building', 'machinery', 'household') AS is_valid FROM customer",
    "corpus_summary": "SELECT coalesce(lang, '*') AS class, count(*) AS total_documents, sum(length(text))::BIGINT AS total_characters FROM documents GROUP BY GROUPING SETS ((), (lang))",
    "top_keywords": f"WITH {B.DOCS} SELECT keyword, count(*) AS freq FROM (SELECT unnest(keywords) AS keyword FROM docs) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "index_coverage": "SELECT count(*) AS total_documents, count(l.doc_id) AS indexed_documents, 5::BIGINT AS top_k, 0.7::DOUBLE AS similarity_threshold FROM documents d LEFT JOIN labels l USING (doc_id)",
    "index_clear": "SELECT count(*) AS before, 0::BIGINT AS after, count(*) AS rebuilt, sum(length(text))::BIGINT AS chars, false AS reused FROM documents",
    "index_count": "SELECT count(*) AS document_count FROM documents",
}
