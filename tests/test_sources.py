import json
from datetime import datetime

from pyspark.sql import functions as F

from ragspark.operators import lexical, maintain
from ragspark.sources import corpus, store
from ragspark.streaming import ingest
from tests.conftest import rows


def test_corpus_files_become_cleaned_documents(spark, tmp_path):
    (tmp_path / "suxiu.txt").write_text(" 刺绣 \n\n 丝线 ", encoding="utf-8")
    (tmp_path / "other.md").write_text("# t\nx", encoding="utf-8")
    docs = corpus.document_rows(corpus.read_corpus(spark, str(tmp_path)))
    got = {r.doc_id: (r.content, r.metadata.char_count, r.metadata.line_count, r.metadata.craft_name) for r in docs.collect()}
    assert got == {"suxiu": ("刺绣\n丝线", 5, 2, "苏绣"), "other": ("# t\nx", 5, 2, "other")}


def test_json_documents_default_to_empty_text(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"content": "c\nd"}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"title": "t"}))
    assert rows(corpus.read_json_docs(spark, str(tmp_path)).select("doc_id", "content")) == [("a", "c\nd"), ("b", "")]


def test_manifest_and_formats(spark, tmp_path):
    for name in ("a.txt", "b.pdf", "c.json"):
        (tmp_path / name).write_text("x")
    files = corpus.list_files(spark, str(tmp_path))
    good, bad = corpus.route_by_format(files)
    assert rows(good.select("suffix")) == [(".json",), (".txt",)] and rows(bad.select("suffix")) == [(".pdf",)]
    named = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"))
    present, missing = corpus.join_manifest(named, spark.createDataFrame([("a.txt",), ("z.txt",)], "file_name string"))
    assert rows(present) == [("a.txt",)] and rows(missing) == [("z.txt",)]


def test_keywords_follow_the_class_lexicon(spark):
    docs = spark.createDataFrame([("a", "x", "掐丝与珐琅"), ("b", "y", "掐丝"), ("c", "z", "掐丝")], "doc_id string, class string, content string")
    lexicon = spark.createDataFrame([("x", 1, "珐琅"), ("x", 0, "掐丝"), ("x", 2, "镀金"), ("y", 0, "珐琅")], "class string, ord int, keyword string")
    got = {r.doc_id: r.keywords for r in corpus.tag_keywords(docs, lexicon).collect()}
    assert got == {"a": ["掐丝", "珐琅"], "b": [], "c": []}


def test_upsert_and_delete(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "doc_id string, content string")
    delta = spark.createDataFrame([("b", "3"), ("c", "4")], "doc_id string, content string")
    once = maintain.upsert_docs(base, delta)
    assert rows(once) == [("a", "1"), ("b", "3"), ("c", "4")] and rows(maintain.upsert_docs(once, delta)) == rows(once)
    files = spark.createDataFrame([("a", ".md"), ("a", ".json"), ("b", ".txt")], "doc_id string, suffix string")
    gone = spark.createDataFrame([("a",), ("z",)], "doc_id string")
    assert rows(maintain.delete_docs(files, gone)) == [("a", ".json"), ("b", ".txt")]


def test_unknown_type_returns_all(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    mapping = spark.createDataFrame([("craft", 1)], "type string, doc_id long")
    asked = spark.createDataFrame([("craft",), ("x",)], "type string")
    assert rows(maintain.docs_by_type(docs, mapping, asked)) == [("craft", 1, 1), ("x", None, 2)]


def test_every_input_gets_a_vector_and_copies_are_embedded_once(spark):
    texts = spark.createDataFrame([(i, "copy") for i in range(50)] + [(50, "known"), (51, "new")], "text_id long, text string")
    made = []

    def vectorise(todo):
        made.append(todo.count())
        return todo.select("text_hash", F.array(F.length("text").cast("double")).alias("embedding"))

    known = spark.createDataFrame([("known",)], "text string").select(F.sha2("text", 256).alias("text_hash"), F.array(F.lit(0.5)).alias("embedding"))
    out = maintain.embed_missing(texts, known, vectorise)
    assert out.count() == 52 and out.where("embedding is null").count() == 0 and made == [2]
    assert out.where("reused").select("text_id").collect()[0].text_id == 50


def test_table_is_built_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.ensure_table(spark, path, lambda: spark.range(3))[1] is False
    table, reused = store.ensure_table(spark, path, lambda: spark.range(9))
    assert reused and table.count() == 3
    assert store.ensure_table(spark, path, lambda: spark.range(9), recreate=True)[0].count() == 9
    store.clear_table(spark, path)
    assert store.ensure_table(spark, path, lambda: spark.range(4))[1] is False
    assert spark.read.parquet(path).count() == 4


def test_metadata_scalars(spark):
    frame = spark.createDataFrame([(1, ("x", 3, ["a", "b"], None))], "doc_id long, metadata struct<s:string,n:int,k:array<string>,z:string>")
    assert store.scalarise_metadata(frame).first().metadata == {"s": "x", "n": "3", "k": '["a","b"]', "z": None}


def uploads(spark, path, data, n):
    rows_ = [(i, kind, text, datetime(2024, 1, 1, 0, 0, sec)) for i, kind, text, sec in data]
    spark.createDataFrame(rows_, ingest.UPLOAD_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_stream_ingest_survives_a_replay_and_a_hot_id(spark, tmp_path):
    src, dst, cp = (str(tmp_path / x) for x in ("in", "store", "cp"))
    hot = [("hot", "text/plain", f"v {s} tan", s) for s in range(30)]
    uploads(spark, src, hot + [("a", "text/plain", "red clay", 1), ("x", "image/png", "no", 1)], 1)
    ingest.ingest_uploads(ingest.read_uploads(spark, src), dst, cp).awaitTermination()
    uploads(spark, src, [("a", "text/markdown", "blue clay", 2), ("b", "application/json", "kiln", 2)], 2)
    ingest.ingest_uploads(ingest.read_uploads(spark, src), dst, cp).awaitTermination()
    want = [("a", "blue clay"), ("b", "kiln"), ("hot", "v 29 tan")]
    assert rows(ingest.current_documents(spark, dst).select("doc_id", "content")) == want
    assert rows(ingest.quarantined(spark, dst).select("doc_id")) == [("x",)]
    terms = {r.term: r.df for r in lexical.index_of_postings(ingest.current_postings(spark, dst)).term_stats.collect()}
    assert terms == {"blue": 1, "clay": 1, "kiln": 1, "v": 1, "29": 1, "tan": 1}
    # The same input under a lost checkpoint lands in the same folders and changes nothing.
    ingest.ingest_uploads(ingest.read_uploads(spark, src), dst, cp + "2").awaitTermination()
    assert rows(ingest.current_documents(spark, dst).select("doc_id", "content")) == want


def test_compaction_changes_no_result_and_spares_earlier_batches(spark, tmp_path):
    src, dst, cp = (str(tmp_path / x) for x in ("in", "store", "cp"))
    batches = [
        [("a", "text/plain", "red clay", 5), ("b", "text/plain", "kiln", 5), ("c", "text/plain", "tan", 5)],
        [("a", "text/plain", "late and older", 1), ("b", "text/plain", "new kiln", 6), ("d", "image/png", "no", 6)],
        [("c", "text/plain", "same time again", 5), ("e", "text/plain", "", 7), ("b", "text/plain", "kiln again", 8)],
    ]
    want, seen = {}, {}
    for n, batch in enumerate(batches):
        uploads(spark, src, batch, n)
        ingest.ingest_uploads(ingest.read_uploads(spark, src), dst, cp).awaitTermination()
        for i, kind, text, sec in batch:
            if kind != "image/png" and (sec, n) >= seen.get(i, (-1, -1)):
                seen[i], want[i] = (sec, n), text
        for compacting in (False, True):
            if compacting and n < 2:
                assert ingest.compact(spark, dst) == n == ingest.compacted_upto(spark, dst)
            assert {r.doc_id: r.content for r in ingest.current_documents(spark, dst).collect()} == want
            words = {(r.doc_id, r.term) for r in ingest.current_postings(spark, dst).collect() if r.term is not None}
            assert words == {(i, w) for i, text in want.items() for w in text.split()}
    for part in ("versions", "postings"):  # a file that cannot be read shows that no one opens the folder
        (tmp_path / "store" / part / "batch=0" / "part-x.parquet").write_bytes(b"no parquet")
    assert {r.doc_id: r.content for r in ingest.current_documents(spark, dst).collect()} == want
    assert ingest.current_postings(spark, dst).count() > 0
    assert ingest.compact(spark, str(tmp_path / "none")) == -1
