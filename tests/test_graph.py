import random

import pytest
from pyspark.sql import functions as F

from ragspark.operators import graph as G
from ragspark.sources.graph_files import read_graph, write_graph
from ragspark.sources.store import ensure_graph
from tests.conftest import rows

NODE = "id string, name string, type string, properties map<string,string>, ord long"
EDGE = "source string, target string, relation string, properties map<string,string>, ord long"


def make(spark, nodes, edges):
    n = spark.createDataFrame([(i, name, kind, {}, o) for o, (i, name, kind) in enumerate(nodes)], NODE)
    e = spark.createDataFrame([(s, t, r, {}, o) for o, (s, t, r) in enumerate(edges)], EDGE)
    return n, e


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


@pytest.fixture(scope="module")
def small(spark):
    return make(
        spark,
        [("jingtailan", "景泰蓝", "craft"), ("tongsi", "铜丝", "material"), ("falang", "珐琅", "material"), ("hanqiang", "焊枪", "tool"),
         ("qian", "钱美华", "inheritor"), ("zhang", "张禄祺", "inheritor"), ("alone", "景泰蓝", "craft")],
        [("jingtailan", "tongsi", "uses_material"), ("jingtailan", "falang", "uses_material"), ("jingtailan", "hanqiang", "uses_tool"),
         ("qian", "jingtailan", "mastered_by"), ("zhang", "jingtailan", "mastered_by"), ("jingtailan", "han", "originated_in"), ("tongsi", "hanqiang", "related_to")],
    )


def test_typed_lookups_forward_and_reverse(spark, small):
    n, e = small
    assert rows(G.related_names(ids(spark, "jingtailan"), n, e, "uses_material")) == [("jingtailan", "珐琅"), ("jingtailan", "铜丝")]
    assert rows(G.related_names(ids(spark, "qian"), n, e, "mastered_by")) == [("qian", "景泰蓝")]
    assert [r.name for r in G.reverse_names(ids(spark, "jingtailan"), n, e, "inheritor", "mastered_by").orderBy("source_id").collect()] == ["钱美华", "张禄祺"]
    assert rows(G.related_pairs(ids(spark, "jingtailan"), n, e, "originated_in")) == [("jingtailan", "han", "originated_in")]
    assert rows(G.neighbors(ids(spark, "nowhere"), n, e)) == []


def test_names_resolve_to_the_first_inserted_node(spark, small):
    n, e = small
    names = spark.createDataFrame([("景泰蓝",), ("alone",), ("missing",)], "entity string")
    assert rows(G.resolve_entities(names, n)) == [("alone", "alone"), ("景泰蓝", "jingtailan")]
    assert G.related_entities(names, n, e, "uses_material").count() == 2


def test_upserts_are_idempotent_and_the_last_write_wins(spark, small):
    n, e = small
    delta = spark.createDataFrame([("qian", None, "person", {"a": "1"}, 0), ("qian", "Q", "master", {}, 1)], NODE)
    once = G.upsert_nodes(n, delta)
    assert [tuple(r) for r in once.where("id = 'qian'").select("name", "type", "ord").collect()] == [("Q", "master", 4)]
    assert rows(G.upsert_nodes(once, delta).select("id", "name", "type")) == rows(once.select("id", "name", "type"))
    again = G.upsert_edges(e, spark.createDataFrame([("jingtailan", "tongsi", None, {}, 0)], EDGE))
    assert again.count() == e.count() and again.where("source = 'jingtailan' and target = 'tongsi'").first().relation == "related_to"


def test_validation_and_implicit_nodes(spark, small):
    n, e = small
    assert rows(G.implicit_nodes(n, e)) == [("han", "han", "unknown")]
    assert rows(G.validate_graph(n, e)) == [("duplicate_name", "alone", "jingtailan"), ("isolated", "alone", ""), ("undeclared_end", "jingtailan", "han")]


def test_statistics_degree_and_search(spark, small):
    n, e = small
    stats = {(r.kind, r.label): r.n for r in G.graph_stats(n, e).collect()}
    assert stats[("node", None)] == 7 and stats[("edge", None)] == 7 and stats[("edge", "mastered_by")] == 2
    degree = {r.id: (r.degree, r.size) for r in G.node_degree(n, e).collect()}
    assert degree["jingtailan"] == (6, 27) and degree["alone"] == (0, 15) and degree["hanqiang"] == (2, 19)
    terms = spark.createDataFrame([("景泰",), ("QIAN",)], "term string")
    assert [(r.term, r.id) for r in G.search_nodes(n, terms).orderBy("term", "id").collect()] == [("QIAN", "hanqiang"), ("QIAN", "qian"), ("景泰", "alone"), ("景泰", "jingtailan")]


def brute_paths(edges, s, t, n):
    found, stack = set(), [(s,)]
    while stack:
        path = stack.pop()
        for a, b in edges:
            if a == path[-1] and b not in path and len(path) <= n:
                if b == t:
                    found.add(path + (b,))
                else:
                    stack.append(path + (b,))
    return {p for p in found if len(p) - 1 <= n}


@pytest.mark.parametrize("length, bound", [(1, 0), (2, 0), (3, 0), (3, 10**9), (4, 10**9), (5, 0)])
def test_paths_equal_brute_force(spark, length, bound):
    rng = random.Random(length)
    names = [f"n{i}" for i in range(9)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(26)})
    n, e = make(spark, [(x, x, "t") for x in names], [(a, b, "r") for a, b in edges])
    pairs = [(a, b) for a in names[:4] for b in names[4:]] + [("n0", "n0"), ("n0", "missing"), ("missing", "n1")]
    got = {tuple(r.path) for r in G.find_paths(spark.createDataFrame(pairs, "source string, target string"), n, e, length, bound).collect()}
    want = set()
    for a, b in pairs:
        if a != b and "missing" not in (a, b):
            want |= brute_paths(edges, a, b, length)
    assert got == want


@pytest.mark.parametrize("length", [1, 2, 3, 4])
def test_paths_of_few_targets_follow_steps_back_that_do_not_shuffle_the_edges(spark, monkeypatch, length):
    rng = random.Random(length + 7)
    names = [f"n{i}" for i in range(9)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(26)})
    n, e = make(spark, [(x, x, "t") for x in names], [(a, b, "r") for a, b in edges] + [("n0", "n5", "r"), ("n0", "n5", "r")])
    asked = [(a, b) for a in names[:4] for b in names[4:6]] + [("n0", "n0"), ("n0", "missing"), ("missing", "n5")]
    pairs = spark.createDataFrame(asked, "source string, target string")
    want = sorted(p for p in (p for a, b in asked if a != b and "missing" not in (a, b) for p in brute_paths(set(edges) | {("n0", "n5")}, a, b, length)))
    times = lambda p: 2 + (("n0", "n5") in edges) if ("n0", "n5") in zip(p, p[1:]) else 1
    monkeypatch.setattr(G, "TWO_SIDED_ABOVE", 0)
    two_sided = sorted(tuple(r.path) for r in G.find_paths(pairs, n, e, length, 0).collect())
    monkeypatch.setattr(G, "path_fronts", None)  # not needed where the steps back are small
    monkeypatch.setattr(G, "_cost", None)
    monkeypatch.setattr(G, "_steps_back", lambda targets, links, m, f=G._steps_back: f(targets, links.unionByName(spark.range(99).select(F.lit("x").alias("_from"), F.lit("y").alias("_to"))), m))
    got = sorted(tuple(r.path) for r in G.find_paths(pairs, n, e, length).collect())
    assert got == two_sided == sorted(p for p in want for _ in range(times(p)))
    links = e.select(F.col("source").alias("_from"), F.col("target").alias("_to"))
    there = pairs.where("source <> target AND source <> 'missing' AND target <> 'missing'")
    back = G._steps_back(there.select("target").distinct(), links, length)
    monkeypatch.setattr(G, "fits", lambda df: False)  # nodes that reach a target are too many: ends without a link to them go first
    assert back is not None and sorted(tuple(r.path) for r in G._paths_along(there, links, length, *back).collect()) == got
    assert G._steps_back(there.select("target").distinct(), links, length) is None


@pytest.mark.parametrize("hub_at_source", [True, False])
def test_paths_step_on_the_side_of_fewer_rows(spark, hub_at_source):
    """A hub with dead ends on one side is never stepped through, and half paths keep to the nodes that lead to a meeting."""
    dead = [("s", f"d{i}") for i in range(300)] + [(f"d{i}", f"e{i}") for i in range(300)]
    way = [("s", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "t"), ("a", "c"), ("b", "d")]
    edges = dead + way if hub_at_source else [(b, a) for a, b in dead + way]
    names = sorted({x for edge in edges for x in edge})
    n, e = make(spark, [(x, x, "x") for x in names], [(a, b, "r") for a, b in edges])
    a, b = ("s", "t") if hub_at_source else ("t", "s")
    pairs = spark.createDataFrame([(a, b)], "source string, target string")
    ahead, behind = G.path_fronts(pairs, e.select(F.col("source").alias("_from"), F.col("target").alias("_to")), 5)
    assert len(ahead) + len(behind) == 7
    assert sum(f.count() for f in ahead + behind) < 20
    got = sorted(tuple(r.path) for r in G.find_paths(pairs, n, e, 5, 0).collect())
    assert set(got) == brute_paths(sorted(set(edges)), a, b, 5) and len(got) == 3


@pytest.mark.parametrize("depth", [0, 1, 2, 4])
def test_ego_subgraph_equals_breadth_first_search(spark, depth):
    rng = random.Random(depth)
    names = [f"n{i}" for i in range(20)]
    edges = sorted({("n0", x) for x in names[1:15]} | {(rng.choice(names), rng.choice(names)) for _ in range(25)})  # n0 is a hub
    n, e = make(spark, [(x, x, "t") for x in names], [(a, b, "r") for a, b in edges])
    members = G.ego_nodes(ids(spark, "n0", "n7", "n19", "gone"), n, e, depth)
    want = set()
    for c in ("n0", "n7", "n19"):
        seen = front = {c}
        for _ in range(depth):
            front = {b for a, b in edges if a in front}
            seen = seen | front
        want |= {(c, x) for x in seen}
    assert {tuple(r) for r in members.collect()} == want
    inner = {(r.centre, r.source, r.target) for r in G.ego_edges(members, e).collect()}
    assert inner == {(c, a, b) for c in ("n0", "n7", "n19") for a, b in edges if (c, a) in want and (c, b) in want}


def test_merge_keeps_the_first_graph(spark, small):
    n, e = small
    other_n, other_e = make(spark, [("qian", "other", "x"), ("new", "new", "x")], [("jingtailan", "tongsi", "x"), ("new", "qian", "y")])
    nodes, edges = G.merge_graphs(n, e, other_n, other_e)
    assert nodes.count() == 8 and nodes.where("id = 'qian'").first().name == "钱美华"
    assert edges.count() == 8 and edges.where("source = 'jingtailan' and target = 'tongsi'").first().relation == "uses_material"


def test_type_filter_keeps_edges_with_either_end(spark, small):
    n, e = small
    kept, edges = G.filter_graph_by_type(n, e, "material")
    assert kept.count() == 2
    assert [r[:2] for r in rows(edges)] == [("jingtailan", "falang"), ("jingtailan", "tongsi"), ("tongsi", "hanqiang")]


def test_views(spark, small):
    n, e = small
    n = n.withColumn("properties", F.when(F.col("id") == "tongsi", F.expr("map('a','1','b','2','c','3','d','4')")).otherwise(F.col("properties")))
    view = {r.id: r for r in G.graph_view_nodes(n, e).collect()}
    assert view["tongsi"].title == "<b>铜丝</b><br>类型: 材料<br>a: 1<br>b: 2<br>c: 3<br>" and view["tongsi"].color == "#2E7D32"
    edge = {(r.source, r.target): r for r in G.graph_view_edges(n, e).collect()}
    assert edge[("qian", "jingtailan")].title == "钱美华 → 传承人掌握 → 景泰蓝" and edge[("qian", "jingtailan")].color == "#EF6C00"
    assert edge[("jingtailan", "han")].color == "#9E9E9E"


def test_files_round_trip_and_defaults(spark, small, tmp_path):
    n, e = small
    write_graph(n, e, str(tmp_path / "g"), shard_bytes=200)
    assert len(list((tmp_path / "g").glob("*.txt"))) > 1
    nodes, edges = read_graph(spark, str(tmp_path / "g"))
    assert rows(nodes.select("id", "name", "type", "ord")) == rows(n.select("id", "name", "type", "ord"))
    assert rows(edges.select("source", "target", "relation", "ord")) == rows(e.select("source", "target", "relation", "ord"))
    (tmp_path / "one.json").write_text('{"nodes": [{"id": "a"}, {"id": "b", "name": "B", "type": "t"}],\n "edges": [{"source": "a", "target": "b"}]}')
    nodes, edges = read_graph(spark, str(tmp_path / "one.json"))
    assert rows(nodes.select("id", "name", "type", "ord")) == [("a", "a", "unknown", 0), ("b", "B", "t", 1)]
    assert rows(edges.select("source", "target", "relation")) == [("a", "b", "related_to")]


def test_build_once_then_reuse(spark, small, tmp_path):
    built = []

    def build():
        built.append(1)
        return small

    first = ensure_graph(spark, str(tmp_path / "s"), build)
    second = ensure_graph(spark, str(tmp_path / "s"), build)
    assert (first[2], second[2], len(built)) == (False, True, 1)
    ensure_graph(spark, str(tmp_path / "s"), build, recreate=True)
    assert len(built) == 2


def test_entities_come_from_the_last_document(spark):
    docs = spark.createDataFrame([(1, "景泰蓝与苏绣"), (2, "苏绣"), (3, "none")], "doc_id long, content string")
    names = spark.createDataFrame([("景泰蓝",), ("苏绣",), ("蜀锦",)], "name string")
    assert rows(G.extract_entities(docs, names).select("id", "source_doc")) == [("景泰蓝", "1"), ("苏绣", "2")]


def test_first_inserted_wins_after_a_reload(spark, tmp_path):
    n = spark.range(500).select(
        F.concat(F.lit("n"), "id").alias("id"), F.when(F.col("id") % 10 == 7, "same").otherwise(F.concat(F.lit("name"), "id")).alias("name"),
        F.lit("t").alias("type"), F.create_map(F.lit("k"), F.lit("v")).alias("properties"), F.col("id").alias("ord"))
    e = spark.createDataFrame([("n1", "n2", "r", {}, 0)], "source string, target string, relation string, properties map<string,string>, ord long")
    asked = spark.createDataFrame([("same",)], "entity string")
    write_graph(n, e, str(tmp_path / "g"), shard_bytes=2_000)
    nodes, _ = read_graph(spark, str(tmp_path / "g"))
    assert rows(G.resolve_entities(asked, nodes)) == rows(G.resolve_entities(asked, n))
    assert "n7" in str(rows(G.resolve_entities(asked, nodes)))
