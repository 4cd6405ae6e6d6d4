"""VARIANT metadata and predicates on paths."""

import json

import pytest
from pyspark.sql import functions as F

from ragspark.sources.metadata import path_predicate, variant_metadata, where_metadata

ROWS = {
    1: {"author": {"name": "Qian", "born": 1943}, "tags": ["red", "blue"], "score": 2.5, "open": True},
    2: {"author": {"name": "Zhang", "born": "unknown"}, "tags": [], "score": 2, "open": False},
    3: {"author": None, "tags": "red", "score": "3"},
    4: {"author": {"name": ""}, "born": 9007199254740993, "a b": {"c": 1}},
    5: [1, 2],
}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("meta") / "t")
    data = [(i, json.dumps(v)) for i, v in ROWS.items()] + [(6, None), (7, "{not json"), (8, "")]
    variant_metadata(spark.createDataFrame(data, "doc_id long, metadata string")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("predicates, want", [
    ([("$.author.name", "=", "Qian")], [1]),
    ([("$.author.name", "!=", "Qian")], [2, 4]),
    ([("$.author.born", ">", 1900)], [1]),
    ([("$.tags[0]", "=", "red")], [1]),
    ([("$.tags[1]", "in", ["blue", "green"])], [1]),
    ([("$.tags[1]", "in", [])], []),
    ([("$.score", "=", 2)], [2]),
    ([("$.score", ">", 2)], [1, 3]),
    ([("$.score", "<=", 2.5)], [1, 2]),
    ([("$.open", "=", True)], [1]),
    ([("$.author", "exists")], [1, 2, 4]),
    ([("$.born", "=", 9007199254740993)], [4]),
    ([("$.born", "=", 9007199254740992)], []),
    ([("$['a b'].c", "=", 1)], [4]),
    ([("$[1]", "=", 2)], [5]),
    ([("$.author.name", "exists"), ("$.score", "<", 2.2)], [2]),
    ([], [1, 2, 3, 4, 5, 6, 7, 8]),
])
def test_predicates_on_paths(stored, predicates, want):
    assert sorted(r.doc_id for r in where_metadata(stored, predicates).select("doc_id").collect()) == want


def test_predicates_are_never_null_and_errors_are_named(spark, stored):
    assert stored.where(path_predicate(F.col("metadata"), "$.none.at.all", "<", 1).isNull()).count() == 0
    with pytest.raises(ValueError):
        path_predicate(F.col("metadata"), "$.a", "like", "x")
    with pytest.raises(TypeError):
        path_predicate(F.col("metadata"), "$.a", "=", [1])


def test_structs_and_stored_variants(spark):
    frame = spark.createDataFrame([(1, ("x", {"k": 3}))], "doc_id long, metadata struct<s:string,m:map<string,int>>")
    once = variant_metadata(frame)
    assert where_metadata(variant_metadata(once), [("$.m.k", "=", 3), ("$.s", "=", "x")]).count() == 1
