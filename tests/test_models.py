"""Model slots: loads per task, batch sizes, failures by row."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from ragspark.functions.models import _scored, batched_model
from ragspark.operators import maintain, rerank
from tests.conftest import rows


def loader(folder):
    """A model that leaves a file per load and per call, named by the size of the batch."""
    def load():
        open(f"{folder}/load-{uuid.uuid4().hex}", "w").close()

        def model(values):
            open(f"{folder}/call-{len(values)}-{uuid.uuid4().hex}", "w").close()
            if any(v < 0 for v in values):
                raise RuntimeError("cannot be scored")
            return [float(v) * 2 for v in values]

        return model

    return load


def files(folder, kind):
    return [f for f in os.listdir(folder) if f.startswith(kind)]


def test_one_load_per_task_and_batches_across_arrow_batches(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        double = batched_model(loader(str(tmp_path)), batch=32)
        got = spark.range(0, 200, 1, 2).select("id", double("id").alias("score")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.id, r.score) for r in sorted(got)] == [(i, 2.0 * i) for i in range(200)]
    assert len(files(tmp_path, "load")) == 2
    assert sorted(int(f.split("-")[1]) for f in files(tmp_path, "call")) == [4, 4] + [32] * 6


def test_failures_and_nulls_concern_their_row_only(spark, tmp_path):
    double = batched_model(loader(str(tmp_path)), batch=8)
    data = [(i, None if i % 7 == 0 else -i if i % 5 == 0 else i) for i in range(40)]
    got = spark.createDataFrame(data, "key long, v long").coalesce(1).select("key", double("v").alias("score"))
    assert rows(got) == sorted([(k, None if v is None or v < 0 else 2.0 * v) for k, v in data], key=repr)


def test_empty_input_loads_nothing(spark, tmp_path):
    double = batched_model(loader(str(tmp_path)))
    assert spark.range(0).select(double("id").alias("score")).collect() == []
    assert files(tmp_path, "load") == []


def test_wrong_number_of_results_is_an_error():
    with pytest.raises(ValueError):
        _scored(lambda values: [1.0], [(1,), (2,)])
    with pytest.raises(ValueError):
        batched_model(lambda: None, batch=0)


def test_scorer_and_embedder(spark):
    def load_scorer():
        return lambda given: [float(len(set(q.split()) & set(c.split()))) for q, c in given]

    def load_embedder():
        return lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts]

    q = spark.createDataFrame([(0, "a b"), (1, None)], "query_id long, question string")
    d = spark.createDataFrame([(1, "a c"), (2, "b a"), (3, "")], "doc_id long, content string")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 1)], "query_id long, doc_id long")
    scored = rerank.model_scores(pairs, q, d, batched_model(load_scorer, batch=2))
    assert rows(scored) == [(0, 1, 1.0), (0, 2, 2.0), (0, 3, 0.0), (1, 1, None)]
    embed = batched_model(load_embedder, "array<double>")
    texts = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, "")], "text_id long, text string")
    store = spark.createDataFrame([], "text_hash string, embedding array<double>")
    out = maintain.embed_missing(texts, store, lambda t: t.select("text_hash", embed(F.col("text")).alias("embedding")))
    vectors = out[0] if isinstance(out, tuple) else out
    assert {(r.text_id, tuple(r.embedding)) for r in vectors.collect()} == {(1, (2.0, 2.0)), (2, (1.0, 0.0)), (3, (2.0, 2.0)), (4, (0.0, 0.0))}
