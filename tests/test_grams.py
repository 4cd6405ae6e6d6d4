"""Containment by grams: the stored index and the way without one, against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from ragspark.functions import grams
from ragspark.operators.gram_index import GramIndex
from tests.conftest import rows


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["clay", "claymore", "red", "reed", "café", "😀😀", "工艺", "景泰蓝工艺", "aaaa", "aaa", "x", "line\nbreak", "%_", "\\d.*"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "ab"), (None, "hidden claymore"), (None, "hidden reed"), (3, "claymore again"), (3, "claymore again"), (63, "aaaa" * 5000 + "needle")]
    return docs


TERMS = ["clay", "claymore", "red reed", "é", "😀", "😀😀", "工艺", "景泰蓝工艺", "蓝工", "aaaa", "aaaaa", "a", "ab", "abc", "needle", "aneedle", "e\nb", "%_", "\\d.*",
         "hidden reed", "never there", "mored", "k x", "clay", "", None]


def brute(docs, terms):
    return {(t, i) for t in terms if t for i, text in docs if text and t in text}


def frames(spark, docs, terms):
    return spark.createDataFrame(docs, "doc_id long, content string"), spark.createDataFrame([(t,) for t in terms], "term string")


@pytest.mark.parametrize("q, picks", [(1, 1), (2, 2), (3, 1), (4, 3), (4, 30)])
def test_index_equals_containment(spark, tmp_path, corpus, q, picks):
    docs, terms = frames(spark, corpus, TERMS)
    index = GramIndex.build(docs.withColumn("text", F.lit("clash")).withColumn("slot", F.lit(1)), str(tmp_path), q=q, slots=16)
    got = [tuple(r) for r in GramIndex.open(spark, str(tmp_path)).hits(terms, picks=picks).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(corpus, TERMS)
    assert index == GramIndex.open(spark, str(tmp_path))


@pytest.mark.parametrize("q", [1, 3, 4])
def test_without_an_index(spark, corpus, q):
    docs, terms = frames(spark, corpus, [t for t in dict.fromkeys(TERMS) if t])
    got = [tuple(r) for r in grams.gram_hits(docs, "doc_id", "content", terms, q).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(corpus, TERMS)


def test_empty_sides(spark, tmp_path, corpus):
    docs, terms = frames(spark, corpus, TERMS)
    assert GramIndex.build(docs, str(tmp_path / "a"), slots=4).hits(terms.limit(0)).count() == 0
    assert GramIndex.build(docs.limit(0), str(tmp_path / "b"), slots=4).hits(terms).count() == 0
    assert grams.gram_hits(docs.limit(0), "doc_id", "content", terms.where("term <> ''").distinct()).count() == 0


def test_a_further_batch_reads_only_texts_with_candidates(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common words and number{i:04d}") for i in range(400)], "doc_id long, content string")
    index = GramIndex.build(docs, str(tmp_path), slots=64)
    terms = spark.createDataFrame([("number0007",), ("number0311",), ("number9999",), ("zzzz",)], "term string")
    found = index.candidates(terms, picks=30)
    assert {tuple(r) for r in found.collect()} == {("number0007", 7), ("number0311", 311)}
    files = index.texts_of(found).select(F.input_file_name()).distinct().count()
    assert files <= 2 and index.texts_of(found).count() <= 40
    assert {tuple(r) for r in index.hits(terms).collect()} == {("number0007", 7), ("number0311", 311)}
    nothing = index.candidates(terms.where("term = 'number9999' OR term = 'zzzz'"), picks=30)
    assert index.texts_of(nothing).inputFiles() == [] or index.texts_of(nothing).count() == 0


def test_short_terms_need_no_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abcd"), (2, "bc"), (3, "xyz")], "doc_id long, content string")
    index = GramIndex.build(docs, str(tmp_path), slots=8)
    got = index.candidates(spark.createDataFrame([("bc",), ("d",), ("z",), ("abcd",)], "term string"))
    assert {tuple(r) for r in got.collect()} == {("bc", 1), ("bc", 2), ("d", 1), ("z", 3), ("abcd", 1)}


def test_tasks_of_the_gram_build_grow_with_the_texts(spark, tmp_path, monkeypatch):
    from ragspark.operators import lexical

    docs = spark.createDataFrame([(i, f"common words and number{i:04d}") for i in range(200)], "doc_id long, content string")
    few = GramIndex.build(docs, str(tmp_path / "few"), slots=2)
    monkeypatch.setattr(lexical, "PART_BYTES", 1_000)
    many = GramIndex.build(docs, str(tmp_path / "many"), slots=2)
    files = lambda name: spark.read.parquet(str(tmp_path / name / "postings")).select(F.input_file_name()).distinct().count()
    assert files("many") > files("few")
    terms = spark.createDataFrame([("common",), ("number0007",), ("er0",)], "term string")
    assert rows(few.hits(terms)) == rows(many.hits(terms)) and few.hits(terms).where("term = 'common'").count() == 200


def test_postings_and_candidates_are_not_shuffled(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common words and number{i:04d}") for i in range(200)], "doc_id long, content string")
    index = GramIndex.build(docs, str(tmp_path), slots=8)
    files = spark.read.parquet(f"{tmp_path}/postings").select(F.input_file_name().alias("f"), F.spark_partition_id().alias("p"), "doc_id")
    assert files.groupBy("doc_id").agg(F.count_distinct("f").alias("n")).agg(F.max("n")).first()[0] == 1  # a document lies in one bucket
    assert files.select("f").distinct().count() <= index.buckets  # and a bucket is one file
    terms = spark.createDataFrame([("common",), ("number0007",), ("er0",), ("s",)], "term string")
    plan = index.candidates(terms)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and "hashpartitioning(gram" not in plan
    assert index.hits(terms).count() == 200 + 1 + 200 + 200
