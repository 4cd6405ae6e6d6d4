"""Segments of an index against rebuilt indexes."""

import random

import pytest
from pyspark.sql import functions as F

from ragspark.operators import lexical
from ragspark.operators.segments import SegmentedIndex
from tests.conftest import rows

SCHEMA = "doc_id long, content string"


def texts(seed, ids):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choices(["red", "blue", "clay", "kiln", "of", f"w{i % 9}"], k=rnd.randint(0, 9)))) for i in ids]


def same(segmented, docs, spark, searched=False):
    """Equal statistics, and if `searched` equal top k, to an index built from `docs`."""
    rebuilt, live = lexical.bm25_index(spark.createDataFrame(docs, SCHEMA)), segmented.index()
    stats = lambda index: rows(index.term_stats.select("term", "df", F.round("idf", 9)))
    assert stats(live) == stats(rebuilt)
    assert rows(live.doc_len) == rows(rebuilt.doc_len)
    if not searched:
        return
    q = spark.createDataFrame([(0, "red clay"), (1, "w3 of kiln"), (2, "nothing")], "query_id long, question string")
    assert rows(lexical.bm25_topk(q, live, 4)) == rows(lexical.bm25_topk(q, rebuilt, 4))
    assert rows(lexical.bm25_candidates(q, live, 4, prune_above=0).select("query_id", "doc_id").where("query_id = 1")) != []


@pytest.fixture
def base(spark, tmp_path):
    docs = texts(1, range(40))
    return docs, SegmentedIndex.create(spark.createDataFrame(docs, SCHEMA), str(tmp_path / "ix"), 4)


def test_additions_removals_and_merges_equal_a_rebuild(spark, base):
    docs, index = base
    more = texts(2, range(30, 60))  # ids 30 to 39 are held already and stay as they are
    index = index.add(spark.createDataFrame(more, SCHEMA))
    held = docs + more[10:]
    index, found = index.remove(spark.createDataFrame([(3,), (3,), (45,), (999,)], "doc_id long"))
    assert rows(found) == [(3, True), (45, True), (999, False)]
    held = [d for d in held if d[0] not in (3, 45)]
    same(index, held, spark)
    back = [(3, "red red clay"), (70, "")]
    index = index.add(spark.createDataFrame(back, SCHEMA))  # a removed id may come back
    held += back
    index = index.replace(spark.createDataFrame([(5, "kiln kiln"), (71, "blue")], SCHEMA))
    held = [d for d in held if d[0] != 5] + [(5, "kiln kiln"), (71, "blue")]
    same(index, held, spark, True)
    merged = index.merge()
    assert len(merged.changes) == 1 and len(index.changes) == 6
    assert SegmentedIndex.open(spark, index.path).changes == merged.changes
    assert merged.vacuum() == 6 and merged.vacuum() == 0
    same(merged, held, spark)


def test_nothing_stored_is_shuffled(spark, base):
    _, index = base
    index = index.add(spark.createDataFrame(texts(2, range(30, 60)), SCHEMA))
    index, _ = index.remove(spark.createDataFrame([(3,)], "doc_id long"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame in (index.index().postings, index.index().doc_len, index.index().postings.groupBy("doc_id").count()):
            assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
        delta = spark.createDataFrame(texts(3, range(50, 80)), SCHEMA)
        plan = index._unknown(delta)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # that of the addition
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_change_without_log_entry_is_not_seen(spark, base, monkeypatch):
    docs, index = base
    monkeypatch.setattr(SegmentedIndex, "_logged", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.add(spark.createDataFrame(texts(2, range(50, 60)), SCHEMA))
    monkeypatch.undo()
    again = SegmentedIndex.open(spark, index.path)
    same(again, docs, spark)
    assert again.vacuum() == 1


def test_empty_base_and_empty_changes(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    index = SegmentedIndex.create(none, str(tmp_path / "none"), 4)
    assert index.index().doc_len.count() == 0
    docs = texts(4, range(12))
    index = index.add(spark.createDataFrame(docs, SCHEMA)).add(none)
    index, found = index.remove(none.select("doc_id"))
    assert rows(found) == []
    same(index, docs, spark)


def test_buckets_grow_with_the_texts_at_a_merge_and_tasks_with_an_addition(spark, tmp_path, monkeypatch):
    from ragspark.operators import segments

    docs = {i: (i, f"alpha beta{i % 7} gamma{i % 5}") for i in range(40)}
    index = SegmentedIndex.create(spark.createDataFrame([docs[i] for i in range(10)], SCHEMA), str(tmp_path / "ix"), 2)
    monkeypatch.setattr(segments, "PART_BYTES", 100)
    monkeypatch.setattr(segments, "PART_TOKENS", 20)
    more = spark.createDataFrame([docs[i] for i in range(10, 40)], SCHEMA)
    assert index._parts_of(more, "content") > 2 and index._parts_of(more, "content") % 2 == 0
    added = index.add(more)
    merged = added.merge()
    assert added.buckets == 2 and merged.buckets == 6  # 120 tokens
    whole = lexical.bm25_index(spark.createDataFrame(list(docs.values()), SCHEMA))
    for found in (added, merged):
        assert rows(found.index().term_stats.select("term", "df")) == rows(whole.term_stats.select("term", "df"))
    assert rows(merged.index().postings.select(*whole.postings.columns)) == rows(whole.postings)
