import pytest
from pyspark.sql import functions as F

from ragspark.functions import text as X
from ragspark.functions.replies import parsed_object
from ragspark.lexicons import REFERENCE_PATTERNS, STOPWORDS


def value(spark, column, **cells):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("v")).first()["v"]


def test_clean_text_strips_lines_and_drops_blank_ones(spark):
    assert value(spark, X.clean_text(F.col("t")), t="  a \n\n\t\n b\r\n　c　\n") == "a\nb\nc"


@pytest.mark.parametrize("chars, minutes", [(5, 1), (400, 1), (799, 1), (800, 2)])
def test_reading_time(spark, chars, minutes):
    assert value(spark, X.reading_time(F.col("t")), t="字" * chars) == minutes


def test_keywords_keep_repeats_and_drop_short_and_stop_words(spark):
    assert value(spark, X.extract_keywords(F.col("t"), STOPWORDS), t=" 制作 a 如何 景泰蓝 制作 ") == ["制作", "景泰蓝", "制作"]


def test_tokenize_cuts_han_runs_into_bigrams(spark):
    assert value(spark, X.tokenize(F.col("t")), t="BM25 景泰蓝，制 x") == ["bm25", "景泰", "泰蓝", "制", "x"]
    assert value(spark, X.tokenize(F.col("t")), t="Plain Words, only") == ["plain", "words", "only"]


@pytest.mark.parametrize("text, term", [("aaaa", "aa"), ("a.b.a.b.a", ".b."), ("x" * 7, "x"), ("abc", "zz"), ("a\\Eb\\Eb", "\\Eb")])
def test_overlapping_occurrences(spark, text, term):
    want = [i for i in range(len(text)) if text.startswith(term, i)]
    assert value(spark, X.occurrence_count(F.col("t"), F.col("k")), t=text, k=term) == len(want)
    assert value(spark, X.first_positions(F.col("t"), F.col("k")), t=text, k=term) == want[:5]


def test_excerpt(spark):
    assert value(spark, X.excerpt(F.col("t"), 3), t="abc") == "abc"
    assert value(spark, X.excerpt(F.col("t"), 3), t="abcd") == "abc..."
    assert value(spark, X.excerpt(F.col("t"), 3, True), t="abc") == "abc..."


def test_contents_only_for_long_profiles(spark):
    text = "## 标题一\n正文\n1. 第一步\n# x"
    assert value(spark, X.add_toc(F.col("t"), F.col("p")), t=text, p="curious") == text
    listed = value(spark, X.add_toc(F.col("t"), F.col("p")), t=text, p="learner")
    assert listed == "## 目录\n- ## 标题一\n- 1. 第一步\n\n---\n\n" + text


@pytest.mark.parametrize("reply, body", [
    ('a ```json\n{"x": 1}\n``` b ```', '{"x": 1}'),
    ('```\n{"x": 2}\n```', '{"x": 2}'),
    ('{"x": 3}', '{"x": 3}'),
    ('```json\n{"x": 4}', None),
])
def test_fenced_json(spark, reply, body):
    assert value(spark, X.fenced_json(F.col("t")), t=reply) == body


@pytest.mark.parametrize("reply, ok", [('{"a": "1"}', True), ('{"a": "1"} x', False), ("[1]", False), ("{", False), ("{}", True), (None, False)])
def test_only_whole_objects_parse(spark, reply, ok):
    assert value(spark, parsed_object(F.col("t"), "a STRING").isNotNull(), t=reply) is ok


def test_references_come_pattern_by_pattern_and_five_at_most(spark):
    text = "参考：丙\n来源: 甲\n出自：乙\n来源：丁\n参考: e\n参考: f\n"
    assert value(spark, X.extract_references(F.col("t"), REFERENCE_PATTERNS), t=text) == ["甲", "丁", "乙", "丙", "e"]
