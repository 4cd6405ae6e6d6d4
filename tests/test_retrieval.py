"""Retrieval against brute force on small tables, the ways beyond the bounds included."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.functions import containment, ranking, sizing
from ragspark.functions.ranking import top_k
from ragspark.operators import cells, dense, filters, fusion, keyword, lexical, maintain, rerank, rewrite, vectorize
from ragspark.operators.vectorize import hashed_tfidf
from ragspark.plans import retrieval as plans
from ragspark.plans.retrieval import retrieve
from tests.conftest import rows
from workload import retrieval

WORDS = ["tan", "tango", "go", "red", "Red", "blue", "kiln", "ln", "clay", "glaze", "fire", "silk", "loom", "of"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 8)) + [f"rare{i}", f"word{i}"][: i % 3])) for i in range(60)]
    docs += [(60 + i, docs[3][1]) for i in range(30)]  # a third of the rows are copies of one text
    questions = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 6)))) for i in range(12)] + [(12, "absent words"), (13, "")]
    return docs, questions


def frames(spark, corpus):
    docs, questions = corpus
    return spark.createDataFrame(docs, "doc_id long, content string"), spark.createDataFrame(questions, "query_id long, question string")


def tokens(text):
    return [t for t in re.split(r"\W+", text.lower()) if t]


def okapi(docs, question):
    counts = {d: Counter(tokens(t)) for d, t in docs}
    n, avg = len(docs), sum(sum(c.values()) for c in counts.values()) / len(docs)
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    scores = {}
    for d, c in counts.items():
        length = sum(c.values())
        scores[d] = sum(idf.get(t, 0) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * length / avg)) for t in tokens(question))
    return scores, floor


def test_bm25_equals_brute_force_with_fillers_and_ties(spark, corpus):
    docs, questions = corpus
    d, q = frames(spark, corpus)
    index = lexical.bm25_index(d)
    got = {}
    for r in lexical.bm25_topk(q, index, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    for qid, text in questions:
        scores, floor = okapi(docs, text)
        assert floor > 0
        want = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:5]
        assert [(a, b) for a, b, _ in sorted(got[qid])] == [(i, x[0]) for i, x in enumerate(want, 1)]
        assert [s for *_, s in sorted(got[qid])] == pytest.approx([s for _, s in want], abs=2e-6)


def test_bm25_without_the_broadcast_bound_gives_the_same(spark, corpus, monkeypatch):
    d, q = frames(spark, corpus)
    index = lexical.bm25_index(d)
    want = rows(lexical.bm25_topk(q, index, 5))
    monkeypatch.setattr(lexical, "fits", lambda *a: False)
    assert rows(lexical.bm25_topk(q, index, 5)) == want


@pytest.mark.parametrize("docs", [
    [(0, "a b"), (1, "a c"), (2, "a")],
    [(i, "aa bb" if i % 2 else f"cc{i}") for i in range(20)],  # idf of aa and bb is 0
    [(i, "aa bb" if i < 15 else f"cc{i}") for i in range(20)],  # negative scores in the lowest ids
])
def test_topk_with_scores_that_are_not_positive(spark, docs):
    d = spark.createDataFrame(docs, "doc_id long, content string")
    index = lexical.bm25_index(d)
    for k in (2, 7, 30):
        asked = ["aa", "a", "cc16", "nothing"]
        q = spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")
        got = {}
        for r in lexical.bm25_topk(q, index, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.rank))
        for i, question in enumerate(asked):
            scores = okapi(docs, question)[0]
            want = sorted((-round(scores.get(n, 0.0), 6) + 0.0, n) for n, _ in docs)[:k]
            assert got[i] == [(n, r) for r, (_, n) in enumerate(want, 1)]


def test_all_scores_account_for_every_document(spark, corpus):
    d, q = frames(spark, corpus)
    total = lexical.bm25_scores(q, lexical.bm25_index(d)).groupBy("query_id").agg(F.sum("n_docs")).collect()
    assert {tuple(r) for r in total} == {(i, 90) for i in range(14)}


def test_all_scores_have_a_row_for_every_query_and_document(spark, tmp_path, monkeypatch):
    docs = [(1, "red clay"), (2, "blue paint"), (3, ""), (4, None), (5, "clay clay wheel"), (None, "red wheel"), (2, "blue paint")]
    asked = [(7, "clay"), (8, "nothing here"), (9, None), (7, "clay"), (None, "wheel")]
    q = spark.createDataFrame(asked, "query_id long, question string")
    index = lexical.bm25_index(spark.createDataFrame(docs, "doc_id long, content string")).save(str(tmp_path / "ix"), 4)
    ids = {1, 2, 3, 4, 5, None}
    found = lexical.bm25_scores(q, index)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan.split("BroadcastExchange")[0]
    got = rows(found)
    pairs = [r[:2] for r in got]
    assert sorted(pairs, key=repr) == sorted(((a, b) for a in (7, 8, 9, None) for b in ids), key=repr)
    assert {r[3] for r in got} == {1} and all(r[2] is not None for r in got)
    positive = {(r.query_id, r.doc_id): r.score for r in lexical.bm25_matches(q, index).collect()}
    assert len(positive) == 4 and {r[:2]: r[2] for r in got if r[2] != 0} == {k: v for k, v in positive.items() if v != 0}
    monkeypatch.setattr(lexical, "fits", lambda df: False)  # too many queries for a broadcast
    assert rows(lexical.bm25_scores(q, index)) == got
    nothing = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, content string")
    assert rows(lexical.bm25_scores(q.where("query_id = 7"), lexical.bm25_index(nothing))) == [(7, 1, 0.0, 1), (7, 2, 0.0, 1)]


def test_stored_index_scores_without_a_shuffle_of_postings(spark, corpus, tmp_path):
    d, q = frames(spark, corpus)
    index = lexical.bm25_index(d)
    stored = index.save(str(tmp_path / "ix"), 4)
    assert rows(lexical.bm25_topk(q, stored, 5)) == rows(lexical.bm25_topk(q, index, 5))
    plan = lexical.bm25_matches(q, stored)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan.split("BroadcastExchange")[0]


def test_loaded_index_keeps_its_placement(spark, corpus, tmp_path):
    d, q = frames(spark, corpus)
    stored = lexical.bm25_index(d).save(str(tmp_path / "ix"), 4)
    want = rows(lexical.bm25_topk(q, stored, 5))
    for buckets in (None, 4):
        assert rows(lexical.bm25_topk(q, lexical.Bm25Index.load(spark, str(tmp_path / "ix"), buckets), 5)) == want


def test_hashed_vectors_are_unit_and_equal_for_copies(spark, corpus):
    d, _ = frames(spark, corpus)
    got = {r.doc_id: np.array(r.embedding) for r in hashed_tfidf(d, 64).collect()}
    assert len(got) == 90 and all(len(v) == 64 for v in got.values())
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 or not v.any() for v in got.values())
    assert all(np.allclose(got[3], got[i]) for i in range(60, 90))


def test_hashed_vectors_from_an_index_equal_those_from_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red clay red"), (2, "Blue paint, 工艺品 paint"), (3, ""), (4, None), (5, "clay"), (5, "clay wheel"), (None, "red wheel"), (2, "Blue paint, 工艺品 paint")],
                                 "doc_id long, content string")
    index = lexical.bm25_index(docs)
    plain = rows(hashed_tfidf(docs, 16))
    monkeypatch.setattr(vectorize, "tokenize", None)  # texts are not cut into tokens again
    assert rows(hashed_tfidf(docs, 16, postings=index.postings)) == plain and len(plain) == 8
    assert rows(vectorize.bucket_idf(docs, 16, postings=index.postings)) != []


@pytest.mark.parametrize("kind", ["long", "string"])
def test_graph_arm_counts_in_blocks_without_a_row_for_every_pair(spark, monkeypatch, kind):
    rng = random.Random(11)
    words = [f"w{i}x" for i in range(12)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(60)] + [(7, "w1x w2x"), (None, "w1x w3x"), (None, "w3x"), (61, None), (62, "")]
    asked = [(i, " ".join(rng.sample(words, 3))) for i in range(9)] + [(20, "none"), (21, None), (None, "w1x w2x")]
    d = spark.createDataFrame(docs, "doc_id long, content string").withColumn("doc_id", F.col("doc_id").cast(kind))
    q = spark.createDataFrame(asked, "query_id long, question string")
    nodes = spark.createDataFrame([(w, w) for w in words], "id string, name string")
    edges = spark.createDataFrame([(a, b) for a in words for b in rng.sample(words, 4)], "source string, target string")
    every = plans.graph_retrieve(q, nodes, edges, d, nodes)
    monkeypatch.setattr(plans, "BLOCK_DOCS", 7)
    monkeypatch.setattr(plans, "BLOCK_QUERIES", 4)
    for k in (1, 5, 200):
        want = top_k(every, ["query_id"], [F.desc("score"), F.asc("doc_id")], k).select("query_id", "doc_id", "score", F.col("rank").cast("long"))
        found = plans.graph_retrieve(q, nodes, edges, d, nodes, k)
        assert rows(found) == rows(want)
        assert "explode(terms" not in found._jdf.queryExecution().executedPlan().toString()
    assert plans.graph_retrieve(q.limit(0), nodes, edges, d, nodes, 5).count() == plans.graph_retrieve(q, nodes, edges, d.limit(0), nodes, 5).count() == 0


def test_index_add_and_remove_equal_a_rebuild(spark, corpus):
    d, _ = frames(spark, corpus)
    half = lexical.bm25_index(d.where("doc_id < 40"))
    whole = rows(lexical.bm25_index(d).term_stats.select("term", "df", F.round("idf", 9)))
    added = maintain.index_add(half, d)
    assert rows(added.term_stats.select("term", "df", F.round("idf", 9))) == whole
    kept, found = maintain.index_remove(added, spark.createDataFrame([(1,), (999,)], "doc_id long"))
    assert rows(found) == [(1, True), (999, False)]
    assert rows(kept.term_stats.select("term", "df")) == rows(lexical.bm25_index(d.where("doc_id <> 1")).term_stats.select("term", "df"))


def brute_keyword(docs, questions, own, stop=()):
    out = set()
    for qid, text in questions:
        kws = [w for w in text.split() if len(w) >= 2 and w not in stop]
        for did, content in docs:
            hits = [k for k in kws if k.lower() in content.lower()]
            mine = [k for k in own.get(did, []) if k.lower() in text.lower()]
            n = len(hits) + 2 * len(mine)
            if n:
                out.add((qid, did, n, round(min(n / max(len(kws), 1) * 0.8, 1.0), 6), tuple(sorted(set(hits + mine)))))
    return out


def keyword_rows(df):
    return {(r.query_id, r.doc_id, r.match_count, r.similarity, tuple(r.matched_keywords)) for r in df.collect()}


@pytest.mark.parametrize("path", ["literal", "automaton", "substrings", "shuffled"])
def test_keyword_search_equals_brute_force(spark, corpus, monkeypatch, path):
    docs, questions = corpus
    own = {i: ["Red", "clay"] for i in range(0, 90, 2)}
    d = spark.createDataFrame([(i, t, own.get(i, [])) for i, t in docs], "doc_id long, content string, keywords array<string>")
    q = spark.createDataFrame(questions, "query_id long, question string")
    if path == "automaton":
        monkeypatch.setattr(containment, "JVM_TERMS", 0)
    if path == "substrings":
        monkeypatch.setattr(containment, "fits", lambda *a: False)
    if path == "shuffled":
        monkeypatch.setattr(keyword, "fits", lambda *a: False)
    got = keyword_rows(keyword.keyword_search(q, d, stopwords=("of",)))
    assert got == brute_keyword(docs, questions, own, ("of",))


def test_keyword_search_top_k_and_scope(spark, corpus):
    docs, questions = corpus
    d = spark.createDataFrame([(i, t, "x" if i % 3 else "y") for i, t in docs], "doc_id long, content string, kind string")
    q = spark.createDataFrame([(i, t, "x") for i, t in questions], "query_id long, question string, kind string")
    everything = brute_keyword([x for x in docs if x[0] % 3], questions, {})
    got = keyword_rows(keyword.keyword_search(q, d, doc_keywords=None, stopwords=(), scope="kind"))
    assert got == everything
    best = keyword.keyword_search(q, d, doc_keywords=None, stopwords=(), scope="kind", k=3).collect()
    for qid, _ in questions:
        want = sorted((-s, did) for a, did, _, s, _ in everything if a == qid)[:3]
        assert sorted((-r.similarity, r.doc_id) for r in best if r.query_id == qid) == want


@pytest.fixture
def join_rows(spark, monkeypatch):
    """Call it after a search: the rows that every join it made returns."""
    frame = type(spark.range(1))
    made, plain = [], frame.join

    def recorded(self, *args, **kwargs):
        made.append(plain(self, *args, **kwargs))
        return made[-1]

    monkeypatch.setattr(frame, "join", recorded)
    return lambda: [joined.count() for joined in list(made)]


def common_corpus():
    """Questions of common words that hold little, and rare ones that decide; a third of the rows are copies."""
    rng = random.Random(9)
    common = [f"com{i}" for i in range(8)]
    docs = [(i, " ".join(rng.sample(common, 5) + [f"odd{i % 50}", f"one{i}"]), ["com1"] if i % 20 == 0 else ["odd3"]) for i in range(400)]
    docs += [(400 + i, docs[5][1], docs[5][2]) for i in range(200)]
    questions = [(q, " ".join(rng.sample(common, 3) + [f"odd{q}", f"one{q}"])) for q in range(20)] + [(20, "absent"), (21, ""), (22, "com1 com2")]
    return docs, questions


@pytest.mark.parametrize("floor", [0.0, 0.5, 0.8])
@pytest.mark.parametrize("above", [0, None])
def test_keyword_floor_equals_brute_force(spark, floor, above):
    docs, questions = common_corpus()
    d = spark.createDataFrame(docs, "doc_id long, content string, keywords array<string>")
    q = spark.createDataFrame(questions, "query_id long, question string")
    want = {r for r in brute_keyword([x[:2] for x in docs], questions, {i: k for i, _, k in docs}) if r[3] >= floor}
    assert keyword_rows(keyword.keyword_search(q, d, stopwords=(), floor=floor, prune_above=above)) == want


def test_keyword_floor_makes_few_rows(spark, join_rows):
    docs, questions = common_corpus()
    d = spark.createDataFrame(docs, "doc_id long, content string, keywords array<string>")
    q = spark.createDataFrame(questions[:20], "query_id long, question string")
    every = len(brute_keyword([x[:2] for x in docs], questions[:20], {i: k for i, _, k in docs}))
    found = keyword.keyword_search(q, d, stopwords=(), floor=0.7, with_matches=False, prune_above=0).collect()
    assert found and every > 10_000
    assert max(join_rows()) <= max(every / 10, len(docs))


@pytest.mark.parametrize(("k", "above"), [(1, 0), (3, 0), (50, 0), (3, None)])
def test_keyword_topk_equals_brute_force(spark, k, above):
    docs, questions = common_corpus()
    d = spark.createDataFrame(docs, "doc_id long, content string, keywords array<string>")
    q = spark.createDataFrame(questions, "query_id long, question string")
    everything = brute_keyword([x[:2] for x in docs], questions, {i: k for i, _, k in docs})
    best = keyword.keyword_search(q, d, stopwords=(), k=k, prune_above=above).collect()
    for qid, _ in questions:
        want = sorted((-s, did, n, m) for a, did, n, s, m in everything if a == qid)[:k]
        assert sorted((-r.similarity, r.doc_id, r.match_count, tuple(r.matched_keywords)) for r in best if r.query_id == qid) == want


def test_keyword_pairs_count_what_was_asked(spark):
    docs, questions = common_corpus()
    d = spark.createDataFrame(docs, "doc_id long, content string, keywords array<string>")
    q = spark.createDataFrame(questions, "query_id long, question string")
    counts = {(a, did): n for a, did, n, *_ in brute_keyword([x[:2] for x in docs], questions, {i: k for i, _, k in docs})}
    pairs = [(a, b) for a in range(23) for b in (0, 5, 401, 77)]
    got = keyword.keyword_pairs(spark.createDataFrame(pairs, "query_id long, doc_id long"), q, d, stopwords=()).collect()
    assert {(r.query_id, r.doc_id): r.match_count for r in got} == {p: counts.get(p, 0) for p in pairs}


def test_substring_search(spark):
    docs = [(0, "Aaaa b"), (1, "nothing"), (2, "xaAx")]
    d = spark.createDataFrame(docs, "doc_id long, content string")
    out = keyword.substring_search(d, spark.createDataFrame([("AA",), ("B",)], "term string"))
    assert rows(out) == rows(spark.createDataFrame([("AA", 0, 3, [0, 1, 2]), ("AA", 2, 1, [1]), ("B", 0, 1, [5])], out.schema))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    docs = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    docs += [(200 + i, docs[7][1]) for i in range(100)]  # copies: ties
    docs += [(300, [0.0] * 8), (301, [1.0, 2.0])]
    return docs, [(i, rng.normal(size=8).tolist()) for i in range(9)] + [(9, docs[7][1]), (10, [0.5, 0.5])]


def cos(a, b):
    if len(a) != len(b) or not any(a) or not any(b):
        return 0.0
    a, b = np.array(a), np.array(b)
    return round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6)


@pytest.mark.parametrize("path", ["one", "chunks", "blocks"])
def test_dense_equals_brute_force(spark, vectors, monkeypatch, path):
    docs, queries = vectors
    if path == "chunks":
        monkeypatch.setattr(dense, "MAX_BYTES", 400)
        monkeypatch.setattr(dense, "fits", lambda *a: False)
    if path == "blocks":
        monkeypatch.setattr(dense, "QUERY_ROWS", 2)
        monkeypatch.setattr(dense, "DOC_ROWS", 7)
    d = spark.createDataFrame(docs, "doc_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    got = {}
    for r in dense.dense_topk(q, d, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    for qid, vec in queries:
        want = sorted(((-cos(vec, e), did) for did, e in docs))[:4]
        assert [(a, b) for a, b, _ in sorted(got[qid])] == [(i, did) for i, (_, did) in enumerate(want, 1)]
        assert [s for *_, s in sorted(got[qid])] == pytest.approx([-s for s, _ in want], abs=2e-6)
    floor = {(r.query_id, r.doc_id) for r in dense.semantic_search(q, d, min_similarity=0.4).collect()}
    assert floor == {(qid, did) for qid, vec in queries for did, e in docs if cos(vec, e) >= 0.4}
    assert dense.semantic_search(q, d).count() == len(docs) * len(queries)


def test_dense_search_keeps_the_query_side_off_the_driver(spark, vectors):
    docs, queries = vectors
    d = spark.createDataFrame(docs, "doc_id long, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    import inspect

    assert not re.search(r"toPandas|toArrow|collect\(\)", inspect.getsource(dense))
    plan = dense.dense_topk(q, d, 4)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange" not in plan.split("BroadcastHashJoin")[1].split("BroadcastExchange")[0]


def test_dense_grid_reads_documents_once_and_skips_rows_without_vector(spark, vectors, monkeypatch):
    docs, queries = vectors
    for name, value in (("fits", lambda *a: False), ("QUERY_ROWS", 3), ("DOC_ROWS", 16), ("MAX_BYTES", 200)):
        monkeypatch.setattr(dense, name, value)
    d = spark.createDataFrame([*docs, (900, None)], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([*queries, (99, None)], "query_id long, embedding array<double>")
    got = {}
    for r in dense.dense_topk(q, d, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
    assert {a: [b for _, b in sorted(v)] for a, v in got.items()} == {
        qid: [did for _, did in sorted((-cos(vec, e), did) for did, e in docs)[:3]] for qid, vec in queries}


def test_retrieve_above_the_keyword_weight_equals_the_merge(spark, vectors):
    from ragspark.plans import retrieval as plans

    texts, questions = common_corpus()
    d = spark.createDataFrame(texts, "doc_id long, content string, keywords array<string>")
    q = spark.createDataFrame(questions, "query_id long, question string")
    rng = np.random.default_rng(4)
    dv = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(0, 500)], "doc_id long, embedding array<double>")
    qv = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(0, 15)], "query_id long, embedding array<double>")
    options = {"doc_keywords": "keywords", "stopwords": ()}
    for floor in (0.45, 0.9):
        want = plans._merge_dense(keyword.keyword_search(q, d, with_matches=False, doc_keywords="keywords", stopwords=()), qv, dv, floor).where(F.col("similarity") >= floor)
        got = plans._merge_above(q, d, qv, dv, floor, options, prune_above=0).where(F.col("similarity") >= floor)
        assert rows(got) == rows(want) and got.count() > 5


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """Vectors around 40 centres, a quarter of the rows copies of one, and vectors that belong to no cell."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16)) * 3
    near = lambda i: (centres[i % 40] + rng.normal(size=16)).tolist()
    docs = [(i, near(i)) for i in range(2000)] + [(3000 + i, centres[3].tolist()) for i in range(700)] + [(5000, [0.0] * 16), (5001, [1.0, 2.0]), (5002, None)]
    queries = [(i, near(i)) for i in range(60)] + [(200, [0.0] * 16), (201, [1.0, 1.0]), (202, None)]
    d = spark.createDataFrame(docs, "doc_id long, embedding array<double>")
    path = str(tmp_path_factory.mktemp("cells"))
    cells.CellIndex.build(d, path, cells=32)
    return d, spark.createDataFrame(queries, "query_id long, embedding array<double>"), path


@pytest.mark.parametrize("path", ["broadcast", "shuffled"])
def test_search_by_cells_is_exact(spark, clustered, monkeypatch, path):
    d, q, stored = clustered
    if path == "shuffled":
        monkeypatch.setattr(cells, "fits", lambda *a: False)
    want = rows(dense.dense_topk(q, d, 5))
    assert rows(cells.cells_topk(q, cells.CellIndex.load(spark, stored), 5, probes=2)) == want


def test_nearest_cells_recall_and_read_little(spark, clustered):
    d, q, stored = clustered
    q = q.where("query_id < 200")
    index = cells.CellIndex.load(spark, stored)
    exact = dense.dense_topk(q, d, 5)
    assert cells.recall(cells.cells_topk(q, index, 5, probes=3, exact=False), exact) >= 0.9
    one = q.where("query_id = 7")
    plan = cells.cells_topk(one, index, 5, probes=2, exact=False)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(lane" in plan  # the other cells' files are not read
    assert index.sizes.count() >= 32 and index.sizes.agg(F.sum("n")).first()[0] == 2702


def test_cells_without_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert rows(cells.cells_topk(q, cells.CellIndex.build(none, str(tmp_path / "none"), cells=4), 3)) == []
    flat = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "doc_id long, embedding array<double>")
    assert rows(cells.cells_topk(q, cells.CellIndex.build(flat, str(tmp_path / "flat"), cells=4), 3)) == [(1, 1, 0.0, 1), (1, 2, 0.0, 2)]


def test_merge_keeps_raw_scores_of_single_sided_hits(spark):
    kw = spark.createDataFrame([(0, 1, 0.8), (0, 2, 0.5)], "query_id long, doc_id long, similarity double")
    sem = spark.createDataFrame([(0, 2, 1.0), (0, 3, 0.3)], "query_id long, doc_id long, similarity double")
    out = fusion.merge_hybrid(kw, sem).select("doc_id", "similarity", "retrieval_type")
    assert rows(out) == [(1, 0.8, "keyword"), (2, 0.8, "hybrid"), (3, 0.3, "semantic")]


def hits(spark, data):
    return spark.createDataFrame(data, "source string, query_id long, doc_id string, score double")


def test_rrf_counts_repeats_and_blank_ids_use_up_a_rank(spark):
    data = [("a", 0, "x", 3.0), ("a", 0, "", 2.0), ("a", 0, "y", 1.0), ("a", 0, "x", 0.5), ("b", 0, "y", 9.0)]
    out = fusion.rrf(hits(spark, data)).select("doc_id", "score", "sources_count", "final_rank")
    x, y = 1 / 60 + 1 / 63, 1 / 62 + 1 / 60
    assert rows(out) == [("x", round(x, 9), 2, 2), ("y", round(y, 9), 2, 1)]


def test_rrf_of_distances_and_the_unbounded_way(spark):
    rng = random.Random(1)
    data = [(s, q, f"d{i}", float(rng.randint(0, 9))) for s in "ab" for q in range(3) for i in range(200 if q == 0 else 5)]
    frame = hits(spark, data)
    bounded = rows(fusion.rrf(frame, ascending=["b"]))
    assert rows(fusion.rrf(frame, ascending=["b"], bounded=False)) == bounded
    lists = {}
    for s, q, d, v in data:
        lists.setdefault((s, q), []).append((v if s == "b" else -v, d))
    want = Counter()
    for (s, q), rows_ in lists.items():
        for rank, (_, d) in enumerate(sorted(rows_)):
            want[q, d] += 1 / (60 + rank)
    assert {(r.query_id, r.doc_id): r.score for r in fusion.rrf(frame, ascending=["b"]).collect()} == pytest.approx(dict(want), abs=2e-9)


def test_rank_rows_equals_row_number_in_a_hot_group(spark):
    frame = spark.range(3000).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 101).alias("v"), "id")
    order = [F.desc("v"), F.asc("id")]
    got = rows(ranking.rank_rows(frame, ["g"], order).select("g", "id", "rank"))
    assert got == rows(frame.select("g", "id", ranking.row_rank(["g"], order).cast("long").alias("rank")))


def test_weighted_rrf_checks_and_scales_weights(spark):
    frame = hits(spark, [("a", 0, "x", 1.0), ("b", 0, "y", 1.0)])
    out = fusion.weighted_rrf(frame, {"a": 1.0, "b": 3.0}, ["a", "b"]).select("doc_id", "score")
    assert rows(out) == [("x", round(0.25 / 60, 9)), ("y", round(0.75 / 60, 9))]
    with pytest.raises(ValueError):
        fusion.weighted_rrf(frame, {"a": 1.0}, ["a", "b"])


def test_normalise_leaves_flat_lists_and_unknown_methods(spark):
    frame = hits(spark, [("a", 0, "x", 1.0), ("a", 0, "y", 3.0), ("b", 0, "x", 2.0), ("b", 0, "y", 2.0), ("c", 0, "z", 5.0)])
    assert rows(fusion.normalize_scores(frame).select("source", "doc_id", "score")) == [
        ("a", "x", 0.0), ("a", "y", 1.0), ("b", "x", 2.0), ("b", "y", 2.0), ("c", "z", 5.0)]
    z = {(r.source, r.doc_id): r.score for r in fusion.normalize_scores(frame, "zscore").collect()}
    assert z[("a", "x")] == pytest.approx(-0.707107) and z[("b", "x")] == 2.0 and z[("c", "z")] == 0.0
    assert fusion.normalize_scores(frame, "other") is frame


def test_filter_keeps_everything_when_nothing_matches(spark):
    docs = spark.createDataFrame([(1, "craft"), (2, "history")], "doc_id long, type string")
    asked = spark.createDataFrame([("craft",), ("none",), (None,), ("2",)], "type_filter string")
    assert rows(filters.filter_or_all(docs, asked)) == [("2", 2, 1), ("craft", 1, 1), ("none", None, 2)]


def test_missing_similarity_counts_as_one(spark):
    frame = spark.createDataFrame([(1, 0.69), (2, 0.7), (3, None)], "doc_id long, similarity double")
    assert [r.doc_id for r in filters.min_similarity(frame).orderBy("doc_id").collect()] == [2, 3]


def test_expansion_is_distinct_ordered_and_limited(spark):
    q = spark.createDataFrame([(0, " 制作 历史 材料 "), (1, "历史"), (2, "  "), (3, "plain")], "query_id long, question string")
    got = {r.query_id: r.expanded_queries for r in rewrite.expand_queries(q).collect()}
    assert got == {0: ["制作 历史 材料", "制作", "制作技艺", "历史", "起源"], 1: ["历史", "起源"], 2: [], 3: ["plain"]}


def test_rerank_falls_back_to_input_order(spark):
    cand = spark.createDataFrame([(0, 1, 9.0, 1), (0, 2, 8.0, 2), (1, 3, 7.0, 1), (1, 4, 6.0, 2)], "query_id long, doc_id long, score double, rank long")
    scored = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.9), (1, 3, 0.1), (1, 4, None)], "query_id long, doc_id long, score double")
    assert rows(rerank.rerank(cand, scored, 2)) == [(0, 1, 0.1, 2), (0, 2, 0.9, 1), (1, 3, 7.0, 1), (1, 4, 6.0, 2)]
    assert rows(rerank.pair_scores(scored)) == [(0, 1, 0.1), (0, 2, 0.9), (1, 3, 0.0), (1, 4, 0.0)]


def test_a_pandas_udf_serves_as_scorer(spark):
    import pandas as pd

    @F.pandas_udf("double")
    def shared(question: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([float(len(set(a.split()) & set(b.split()))) for a, b in zip(question, content)])

    q = spark.createDataFrame([(0, "red clay")], "query_id long, question string")
    d = spark.createDataFrame([(1, "red"), (2, "red clay"), (3, "x")], "doc_id long, content string")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "query_id long, doc_id long")
    assert rows(rerank.model_scores(pairs, q, d, shared)) == [(0, 1, 1.0), (0, 2, 2.0), (0, 3, 0.0)]


def test_basic_retrieve_with_and_without_vectors(spark):
    d = spark.createDataFrame([(1, "red clay kiln", ["clay"]), (2, "blue silk", []), (3, "far", [])], "doc_id long, content string, keywords array<string>")
    q = spark.createDataFrame([(0, "red clay")], "query_id long, question string")
    assert [tuple(r)[:3] for r in retrieve(q, d).collect()] == [(0, 1, 1.0)]
    qv = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    dv = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0])], "doc_id long, embedding array<double>")
    got = [tuple(r) for r in retrieve(q, d, threshold=0.4, query_vectors=qv, doc_vectors=dv).orderBy("rank").collect()]
    assert got == [(0, 2, pytest.approx(0.995037), "semantic", 1), (0, 1, 0.4, "hybrid", 2)]


def test_size_check_stops_broadcasts(spark):
    frame = spark.range(100)
    assert sizing.fits(frame, 100) and not sizing.fits(frame, 99) and not sizing.fits(frame, 1000, 100)


def test_pruned_candidates_hold_the_best_and_leave_common_words_out(spark):
    import random

    rnd = random.Random(5)
    # "the" is in four of ten documents and adds little; the rare words decide.
    texts = [(i, " ".join((["the"] if i % 5 < 2 else []) + [f"w{rnd.randrange(40)}" for _ in range(8)] + ([f"rare{i % 6}"] * 3 if i < 60 else [])))
             for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, content string")
    asked = spark.createDataFrame([(q, f"the rare{q} w{q}") for q in range(6)] + [(9, "the")], "query_id long, question string")
    index = lexical.bm25_index(docs)
    order = [F.desc("score"), F.asc("doc_id")]
    every = lexical.bm25_matches(asked, index)
    pruned = lexical.bm25_candidates(asked, index, 5, prune_above=0).persist()
    best = lambda frame: rows(ranking.top_k(frame, ["query_id"], order, 5))
    assert best(pruned) == best(every)
    assert pruned.where("query_id < 9").count() < every.where("query_id < 9").count() / 2


def test_pruning_makes_no_row_for_pairs_of_common_words(spark, join_rows):
    rnd = random.Random(6)
    # Two words are in a third of 3,000 documents each and in every question; each question also has a rare word.
    texts = [(i, " ".join((["the"] if i % 3 == 0 else []) + (["of"] if i % 3 == 1 else []) + [f"w{rnd.randrange(300)}" for _ in range(8)]
                          + ([f"rare{i % 40}"] * 3 if i < 800 else []))) for i in range(3000)]
    docs = spark.createDataFrame(texts, "doc_id long, content string")
    asked = spark.createDataFrame([(q, f"the of rare{q}") for q in range(40)], "query_id long, question string")
    index = lexical.bm25_index(docs)
    order = [F.desc("score"), F.asc("doc_id")]
    want = rows(ranking.top_k(lexical.bm25_matches(asked, index), ["query_id"], order, 5))
    before = len(join_rows())
    assert rows(ranking.top_k(lexical.bm25_candidates(asked, index, 5, prune_above=0), ["query_id"], order, 5)) == want
    # 40 questions times 2,000 documents with a common word would be 80,000 pairs; candidates are 40 times 20.
    assert max(join_rows()[before:]) < 8_000


def test_length_classes_without_heavy_terms_are_skipped(spark):
    texts = [(i, " ".join(["red"] * (3 if i < 20 else 1) + ["x"] * (2 if i < 20 else 400))) for i in range(60)]
    texts += [(60 + i, f"y{i}") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, content string")
    index = lexical.bm25_index(docs)
    asked = spark.createDataFrame([(0, "red")], "query_id long, question string")
    found = lexical.bm25_candidates(asked, index, 5, prune_above=0)
    assert found.count() == 20  # the long documents' class is not met
    order = [F.desc("score"), F.asc("doc_id")]
    assert rows(ranking.top_k(found, ["query_id"], order, 5)) == rows(ranking.top_k(lexical.bm25_matches(asked, index), ["query_id"], order, 5))


def test_tasks_of_the_index_build_hold_bounded_text(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 7} gamma{i % 5} " * 10) for i in range(60)] + [(60, None)], "doc_id long, content string")
    asked = spark.createDataFrame([(1, "beta3 gamma2")], "query_id long, question string")
    whole = rows(lexical.bm25_matches(asked, lexical.bm25_index(docs).save(str(tmp_path / "few"))))
    monkeypatch.setattr(lexical, "PART_BYTES", 1_000)
    size = sum(len(r["content"]) for r in docs.where("content IS NOT NULL").collect())
    assert lexical.token_rows(docs).rdd.getNumPartitions() == -(-size // 1_000) > 4
    stored = lexical.bm25_index(docs).save(str(tmp_path / "many"))
    assert spark.read.parquet(str(tmp_path / "many/layout")).first()["buckets"] == -(-size // 1_000)
    assert rows(lexical.bm25_matches(asked, stored)) == whole


@pytest.mark.parametrize("keep", [False, True])
def test_texts_are_scanned_a_few_at_a_time(spark, monkeypatch, keep):
    from ragspark.functions import containment

    texts = spark.createDataFrame([(i, f"word{i} and word{i + 1}") for i in range(70)] + [(70, None), (71, "")], "doc_id long, c string")
    terms = spark.createDataFrame([(f"word{i}",) for i in range(60)], "term string")
    plain = rows(containment._gram_join(texts.withColumnRenamed("c", "_text"), "doc_id", terms))
    monkeypatch.setattr(containment, "SCAN_ROWS", 4)
    found = containment.term_hits(texts, "doc_id", "c", terms, keep=keep)
    assert found.columns == ["doc_id", "terms", *(["c"] if keep else [])]
    assert rows(found.select("doc_id", "terms")) == plain
    assert not keep or rows(found.select("doc_id", "c")) == rows(texts)


def test_keyword_lists_hold_more_words_than_bits_without_collecting_them(spark, monkeypatch):
    monkeypatch.setattr(keyword, "TASK_PAIRS", 2)
    long = " ".join(f"w{i:03d}" for i in range(150))
    docs = spark.createDataFrame([(1, long, ["W000", "w149"]), (2, "w003 w070 w140", ["Clay", "clay"]), (3, None, None), (4, "red", []), (5, "w149", [])],
                                 "doc_id long, content string, keywords array<string>")
    asked = spark.createDataFrame([(1, long + " CLAY W000"), (2, "Red red"), (3, None), (4, "absent")], "query_id long, question string")
    found = keyword.keyword_search(asked, docs, stopwords=())
    assert "collect_set" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.rdd.getNumPartitions() >= 10  # 20 pairs, two for a task
    got = {(r["query_id"], r["doc_id"]): (r["match_count"], r["matched_keywords"]) for r in found.collect()}
    words = long.split()
    assert got == {(1, 1): (155, sorted([*words, "W000"])), (1, 2): (7, sorted(["w003", "w070", "w140", "Clay", "clay"])), (1, 5): (1, ["w149"]), (2, 4): (2, ["Red", "red"])}


def test_keyword_floor_that_most_pairs_reach_counts_no_pair_by_itself(spark, corpus, monkeypatch):
    d, q = frames(spark, corpus)
    d = d.withColumn("keywords", F.array().cast("array<string>"))
    want = rows(keyword.keyword_search(q, d, stopwords=(), floor=0.1, with_matches=False))
    monkeypatch.setattr(keyword, "PRUNE_ABOVE", 0)

    def refused(*_):
        raise AssertionError("pairs are counted one by one")

    monkeypatch.setattr(keyword, "_pair_rows", refused)
    assert rows(keyword.keyword_search(q, d, stopwords=(), floor=0.1, with_matches=False)) == want


def test_candidates_are_summed_in_place_where_few_pairs_could_be_left_out(spark, tmp_path, monkeypatch):
    docs = [(i, f"alpha{i % 3} beta{i % 5} " * (1 + i % 4) + f"only{i}") for i in range(60)]
    asked = spark.createDataFrame([(1, "alpha1 beta2 only7"), (2, "alpha2 beta4 only9")], "query_id long, question string")
    index = lexical.bm25_index(spark.createDataFrame(docs, "doc_id long, content string")).save(str(tmp_path / "index"))
    assert lexical.term_weights(asked, index).agg(F.min("weight")).first()[0] > 0
    every = rows(lexical.bm25_matches(asked, index))
    assert len(lexical.bm25_candidates(asked, index, 1, prune_above=0).collect()) < len(every)
    monkeypatch.setattr(lexical, "PRUNE_ABOVE", 0)
    monkeypatch.setattr(lexical, "PAIR_COST", 10**9)
    assert rows(lexical.bm25_candidates(asked, index, 1)) == every
    monkeypatch.setattr(lexical, "PAIR_COST", 0)
    assert len(lexical.bm25_candidates(asked, index, 1).collect()) < len(every)


def test_terms_of_a_stored_index_are_dealt_over_as_many_tasks_as_it_has_buckets(spark, corpus, tmp_path):
    d, _ = frames(spark, corpus)
    plain = lexical.bm25_index(d)
    key, partitions = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, "false")  # otherwise few rows go back into one task
    try:
        index = plain.save(str(tmp_path / "index"), buckets=40)
    finally:
        spark.conf.set(key, "true")
    for got, want in ((index.term_stats, plain.term_stats), (index.caps, plain.caps)):
        assert len(got.inputFiles()) > 4 * int(partitions)  # a few of 40 may have no term
        got, want = rows(got), rows(want)
        assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2:] for r in got] == [pytest.approx(r[2:]) for r in want]
    assert spark.conf.get("spark.sql.shuffle.partitions") == partitions
    with pytest.raises(RuntimeError), sizing.shuffled_over(spark, 99):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "99"
        raise RuntimeError
    assert spark.conf.get("spark.sql.shuffle.partitions") == partitions


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def without_automatic_broadcasts(spark, make):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = make()
        return plan_of(df), rows(df)
    finally:
        spark.conf.set(key, before)


def test_idf_of_query_terms_does_not_move_the_terms_of_the_index(spark, corpus, tmp_path):
    docs, questions = corpus
    d, q = frames(spark, corpus)
    index = lexical.bm25_index(d).save(str(tmp_path / "index"))
    plan, got = without_automatic_broadcasts(spark, lambda: rerank.query_idf(q, index))
    assert "SortMergeJoin" not in plan and "LeftSemi" in plan
    idf = {r.term: r.idf for r in index.term_stats.collect()}
    want = sorted(((i, t, idf.get(t, 0.0)) for i, text in questions for t in set(tokens(text))), key=repr)
    assert got == want
    held = {i: set(tokens(t)) for i, t in docs}
    pairs = [(i, n) for i, _ in questions for n in (0, 7, 61)] + [(0, 999), (77, 1)]
    scored = rows(rerank.coverage_scores(spark.createDataFrame(pairs, "query_id long, doc_id long"), q, index))
    for qid, doc, score in scored:
        asked = set(tokens(dict(questions).get(qid, "")))
        found, mass = asked & held.get(doc, set()), sum(idf.get(t, 0) for t in asked)
        share = sum(idf[t] for t in found) / mass if mass else 0
        assert score == pytest.approx(len(found) / len(asked) + share if asked else 0, abs=2e-6)
    assert [s[:2] for s in scored] == sorted(pairs, key=repr)


def test_only_documents_that_were_hit_move_to_their_hits(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(3, "again"), (None, "none")], "doc_id long, content string")
    found = spark.createDataFrame([("a", 0, 3, 1.0), ("b", 0, 3, 2.0), ("a", 1, 99, 3.0), ("b", 1, None, 4.0), ("b", 2, 7, 5.0)],
                                  "source string, query_id long, doc_id long, score double")
    plan, got = without_automatic_broadcasts(spark, lambda: fusion.with_payload(found, docs))
    assert re.search(r"BroadcastHashJoin .*LeftSemi", plan) and plan.index("LeftOuter") < plan.index("Exchange") < plan.index("LeftSemi")
    assert got == rows(found.join(docs, "doc_id", "left"))


def test_common_words_are_looked_up_only_where_lookups_are_far_fewer_than_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "PRUNE_ABOVE", 0)
    rnd = random.Random(8)
    common = [f"c{i}" for i in range(10)]  # each in two of five documents: light words that every pair would look up
    texts = [[c for c in common if rnd.random() < 0.4] + [f"only{i}"] for i in range(600)]
    many = [(i, " ".join(t + ["rare"] * 3 * (i < 25) + ["scarce"] * 3 * (25 <= i < 29))) for i, t in enumerate(texts)]
    index = lexical.bm25_index(spark.createDataFrame(many, "doc_id long, content string")).save(str(tmp_path / "index"))
    order = [F.desc("score"), F.asc("doc_id")]

    def candidates(word):
        asked = spark.createDataFrame([(1, " ".join([word, *common]))], "query_id long, question string")
        every = lexical.bm25_matches(asked, index)
        found = lexical.bm25_candidates(asked, index, 2)
        assert rows(ranking.top_k(found, ["query_id"], order, 2)) == rows(ranking.top_k(every, ["query_id"], order, 2))
        return found.count(), every.count(), lexical.term_weights(asked, index).agg(F.sum("df")).first()[0]

    found, every, load = candidates("scarce")
    assert found == 4 < every
    found, every, load = candidates("rare")
    assert 25 * lexical.PAIR_COST < load < 25 * len(common) * lexical.PAIR_COST  # few pairs, but many words to look up
    assert found == every


@pytest.mark.parametrize("query", [retrieval.score_minmax, retrieval.score_zscore])
def test_lists_are_searched_once_before_their_scores_are_normalised(spark, corpus, tmp_path, query):
    docs, questions = corpus
    rnd = random.Random(9)
    vectors = [(i, [rnd.random() for _ in range(4)], i % 3) for i in range(40)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in docs], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(questions, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = query(spark, str(tmp_path))
    assert "MapInArrow" not in plan_of(got) and "PythonMapInArrow" not in plan_of(got)
    hits = retrieval._lists(spark, str(tmp_path)).toPandas()
    assert "MapInArrow" in plan_of(retrieval._lists(spark, str(tmp_path)))
    want = []
    for (source, asked), rows_of in hits.groupby(["source", "query_id"]):
        score = rows_of["score"]
        base, spread = (score.min(), score.max() - score.min()) if query is retrieval.score_minmax else (score.mean(), score.std() if len(score) > 1 else 1.0)
        want += [(source, asked, d, s if spread == 0 else (s - base) / spread) for d, s in zip(rows_of["doc_id"], score)]
    scored = {tuple(r[:3]): r[3] for r in got.select("source", "query_id", "doc_id", "score").collect()}
    assert len(scored) == got.count() == len(hits) and {w[:3] for w in want} == set(scored)
    assert all(scored[w[:3]] == pytest.approx(w[3], abs=2e-6) for w in want)
