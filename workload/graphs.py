"""Knowledge-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.operators import graph as G
from ragspark.session import work_path
from ragspark.sources.graph_files import GRAPH_SCHEMA, graph_documents, graph_rows, read_graph, write_graph
from ragspark.sources.store import ensure_graph
from workload import bindings as B


def _of_type(nodes, kind):
    return nodes.where(F.col("type") == kind).select("id")


def _written(spark, df, name):
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def _delta_nodes(spark, sf):
    """A second version of every supplier, and a new node per region without a name."""
    table = B.table(spark, sf, "supplier")
    old = G.node_family(table, B._key("S:", "s_suppkey"), F.concat(F.lit("new "), "s_name"), "vendor", {"v": F.lit(2)}, F.col("s_suppkey"))
    new = G.node_family(B.table(spark, sf, "region"), B._key("X:", "r_regionkey"), F.lit(None).cast("string"), "extra", {}, F.col("r_regionkey") + F.lit(1_000_000))
    return old.unionByName(new)


def node_upsert(spark, sf):
    nodes, _ = B.stored_graph(spark, sf)
    out = G.upsert_nodes(nodes, _delta_nodes(spark, sf))
    return out.select("id", "name", "type", "ord")


def edge_upsert(spark, sf):
    """Returned lines turn `supplies` into `returned_to`; suppliers also point to a region."""
    _, edges = B.stored_graph(spark, sf)
    returned = B.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_suppkey", "l_partkey").distinct()
    delta = G.edge_family(returned, B._key("S:", "l_suppkey"), B._key("P:", "l_partkey"), "returned_to", F.col("l_partkey"))
    extra = G.edge_family(B.table(spark, sf, "supplier"), B._key("S:", "s_suppkey"), F.concat(F.lit("R:"), (F.col("s_suppkey") % 5).cast("string")), "serves", F.col("s_suppkey"))
    return G.upsert_edges(edges, delta.unionByName(extra)).select("source", "target", "relation")


def implicit_nodes(spark, sf):
    """Edges of the whole graph against declared nodes without customers and regions."""
    nodes, edges = B.stored_graph(spark, sf)
    return G.implicit_nodes(nodes.where("type not in ('customer', 'region')"), edges)


def node_lookup(spark, sf):
    nodes, _ = B.stored_graph(spark, sf)
    ids = B.table(spark, sf, "orders").select(F.concat(F.lit("C:"), (F.col("o_custkey") * 2).cast("string")).alias("id")).distinct()
    return G.get_nodes(ids, nodes).select("id", F.coalesce("name", F.lit("-")).alias("name"), F.coalesce("type", F.lit("-")).alias("type"))


def neighbors(spark, sf):
    nodes, edges = B.stored_graph(spark, sf)
    return G.neighbors(nodes.select("id"), nodes, edges)


def typed_neighbors(spark, sf):
    nodes, edges = B.stored_graph(spark, sf)
    return G.related_names(_of_type(nodes, "supplier"), nodes, edges, "supplies")


def typed_pairs(spark, sf):
    nodes, edges = B.stored_graph(spark, sf)
    return G.related_pairs(_of_type(nodes, "nation"), nodes, edges, "part_of")


def forward_lookup(spark, sf):
    nodes, edges = B.stored_graph(spark, sf)
    return G.related_names(_of_type(nodes, "customer"), nodes, edges, "located_in")


def reverse_lookup(spark, sf):
    nodes, edges = B.stored_graph(spark, sf)
    return G.reverse_names(_of_type(nodes, "nation"), nodes, edges, "supplier", "located_in")


def simple_paths(spark, sf):
    """Each customer to a region, over suppliers, nations and regions, in at most three edges."""
    nodes, edges = B.stored_graph(spark, sf)
    pairs = B.table(spark, sf, "customer").select(
        B._key("C:", "c_custkey").alias("source"), F.concat(F.lit("R:"), (F.col("c_custkey") % 5).cast("string")).alias("target"))
    # The search reads the edges once per step, so those that are not stored yet are stored first.
    bought = _written(spark, B.bought_edges(spark, sf).sortWithinPartitions("source", "target"), "trade")
    out = G.find_paths(pairs, nodes, edges.unionByName(bought), 3)
    return out.select("source", "target", F.array_join("path", ">").alias("path"))


def ego_nodes(spark, sf):
    nodes, edges = B.stored_graph(spark, sf)
    return G.ego_nodes(nodes.where("type in ('supplier', 'customer')").select("id"), nodes, edges, 2)


def ego_edges(spark, sf):
    nodes, edges = B.stored_graph(spark, sf)
    return G.ego_edges(G.ego_nodes(nodes.where("type in ('supplier', 'customer')").select("id"), nodes, edges, 2), edges)


def graph_stats(spark, sf):
    nodes, edges = B.stored_graph(spark, sf)
    return G.graph_stats(nodes, edges).withColumn("label", F.coalesce("label", F.lit("*")))


def _terms(spark, sf):
    """Search terms: every part brand's first word of the names, that is every distinct name word."""
    words = B.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("term"))
    return words.select(F.upper("term").alias("term")).distinct()


def node_search(spark, sf):
    nodes, _ = B.stored_graph(spark, sf)
    return G.search_nodes(nodes, _terms(spark, sf))


def _entities(spark, sf):
    names = B.table(spark, sf, "part").select(F.col("p_name").alias("entity"))
    return names.unionByName(B.table(spark, sf, "supplier").select(F.col("s_name").alias("entity"))).unionByName(
        B.table(spark, sf, "nation").select(B._key("N:", "n_nationkey").alias("entity")))


def entity_resolve(spark, sf):
    nodes, edges = B.stored_graph(spark, sf)
    return G.related_entities(_entities(spark, sf), nodes, edges)


def node_degree(spark, sf):
    nodes, edges = B.stored_graph(spark, sf)
    return G.node_degree(nodes, edges)


def graph_view_nodes(spark, sf):
    nodes, edges = B.stored_graph(spark, sf)
    return G.graph_view_nodes(nodes, edges, {"part": "#2E7D32", "nation": "#7B1FA2", "unknown": "#757575"}, {"part": "Part", "nation": "Nation"})


def graph_view_edges(spark, sf):
    nodes, edges = B.stored_graph(spark, sf)
    shown = edges.withColumn("relation", F.when(F.col("relation") == "supplies", "uses_material").otherwise(F.col("relation")))
    return G.graph_view_edges(nodes, shown, {"uses_material": "uses", "part_of": "within"})


def graph_type_filter(spark, sf):
    nodes, edges = B.stored_graph(spark, sf)
    _, kept = G.filter_graph_by_type(nodes, edges, "supplier")
    return kept


def compare_subgraph(spark, sf):
    nodes, edges = B.stored_graph(spark, sf)
    shown, inner = G.compare_nodes(_of_type(nodes, "supplier"), nodes, edges)
    rows = shown.select(F.lit("node").alias("kind"), "id", F.col("name").alias("other"), F.col("is_selected").cast("string").alias("info"))
    return rows.unionByName(inner.select(F.lit("edge").alias("kind"), F.col("source").alias("id"), F.col("target").alias("other"), F.col("relation").alias("info")))


def graph_validate(spark, sf):
    nodes, edges = B.stored_graph(spark, sf)
    return G.validate_graph(nodes.where("type <> 'region'"), edges)


def graph_merge(spark, sf):
    nodes, edges = B.stored_graph(spark, sf)
    more_nodes, more_edges = G.merge_graphs(nodes, edges, _delta_nodes(spark, sf), B.trade_edges(spark, sf).withColumn("relation", F.lit("other")))
    return more_nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.col("type").alias("label")).unionByName(
        more_edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("relation").alias("label")))


def entity_nodes(spark, sf):
    """Every word of the part names, and the lexicon words, looked for in every document."""
    names = _terms(spark, sf).select(F.lower("term").alias("name")).unionByName(B.lexicon(spark).select(F.col("keyword").alias("name")))
    return G.extract_entities(B.documents(spark, sf), names)


def graph_build(spark, sf):
    """The seed graph from the dimension tables; nations are declared twice, the later wins."""
    t = lambda name: B.table(spark, sf, name)
    nodes, edges = G.seed_graph(
        [
            G.node_family(t("region"), B._key("R:", "r_regionkey"), F.col("r_name"), "region", {}, F.col("r_regionkey")),
            G.node_family(t("nation"), B._key("N:", "n_nationkey"), F.col("n_name"), "unknown", {}, F.col("n_nationkey")),
            G.node_family(t("supplier"), B._key("S:", "s_suppkey"), F.col("s_name"), "supplier", {"nation": F.col("s_nationkey")}, F.col("s_suppkey")),
            G.node_family(t("nation"), B._key("N:", "n_nationkey"), F.col("n_name"), "nation", {"region": F.col("n_regionkey")}, F.col("n_nationkey")),
            G.node_family(t("customer"), B._key("C:", "c_custkey"), F.col("c_name"), "customer", {"segment": F.col("c_mktsegment")}, F.col("c_custkey")),
        ],
        [
            G.edge_family(t("supplier"), B._key("S:", "s_suppkey"), B._key("N:", "s_nationkey"), "located_in", F.col("s_suppkey")),
            G.edge_family(t("customer"), B._key("C:", "c_custkey"), B._key("N:", "c_nationkey"), "located_in", F.col("c_custkey")),
            G.edge_family(t("nation"), B._key("N:", "n_nationkey"), B._key("R:", "n_regionkey"), "part_of", F.col("n_nationkey")),
        ],
    )
    props = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), props.alias("b"), F.col("type").alias("label")).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("relation").alias("label")))


def graph_query(spark, sf):
    """A request per supplier (by id or name), and per name word a search, over one relation or all."""
    supplier = B.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("request_id"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(B._key("S:", "s_suppkey")).alias("entity"),
        F.when(F.col("s_suppkey") % 3 == 0, "located_in").alias("relation"),
        F.lit(None).cast("string").alias("term"),
    )
    nation = B.table(spark, sf, "nation").select(
        (F.col("n_nationkey") + F.lit(1_000_000).cast("long")).alias("request_id"), F.lit(None).cast("string").alias("entity"),
        F.lit(None).cast("string").alias("relation"), F.lower("n_name").alias("term"))
    nodes, edges = B.stored_graph(spark, sf)
    return G.graph_query(supplier.unionByName(nation), nodes, edges)


def _stored_form(spark, sf):
    """The graph with the fields removed that loading fills in."""
    nodes, edges = B.graph(spark, sf)
    nodes = nodes.withColumn("name", F.when(F.col("type") != "region", F.col("name"))).withColumn(
        "type", F.when(F.col("type") != "customer", F.col("type")))
    edges = edges.withColumn("relation", F.when(F.col("relation") != "part_of", F.col("relation")))
    return nodes, edges


def _listed(nodes, edges):
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("name").alias("b"), F.col("type").alias("label"), "ord").unionByName(
        edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("relation").alias("label"), "ord"))


def graph_load(spark, sf):
    path = work_path(spark, "graph")
    nodes, edges = _stored_form(spark, sf)
    write_graph(nodes, edges, path)
    return _listed(*read_graph(spark, path))


def graph_export(spark, sf):
    """The rows the documents hold, and the counts they state as rows of kind `count`."""
    docs = graph_documents(*B.graph(spark, sf)).select(F.from_json("document", GRAPH_SCHEMA).alias("g")).select("g.*")
    stated = docs.agg(F.sum("metadata.node_count").alias("node"), F.sum("metadata.edge_count").alias("edge"))
    counts = stated.select(F.explode(F.create_map(F.lit("node"), "node", F.lit("edge"), "edge")).alias("a", "ord")).select(
        F.lit("count").alias("kind"), "a", F.lit("").alias("b"), F.lit("").alias("label"), "ord")
    return _listed(*graph_rows(docs)).unionByName(counts)


def graph_reuse(spark, sf):
    """Build and store the graph, then load it again instead of building."""
    path = work_path(spark, "graph-tables")
    ensure_graph(spark, path, lambda: B.graph(spark, sf))
    nodes, edges, reused = ensure_graph(spark, path, lambda: B.graph(spark, sf))
    return G.graph_stats(nodes, edges).withColumn("label", F.coalesce("label", F.lit("*"))).withColumn("reused", F.lit(reused))


QUERIES = {f.__name__: f for f in (
    node_upsert, edge_upsert, implicit_nodes, node_lookup, neighbors, typed_neighbors, typed_pairs, forward_lookup, reverse_lookup,
    simple_paths, ego_nodes, ego_edges, graph_stats, node_search, entity_resolve, node_degree, graph_view_nodes, graph_view_edges,
    graph_type_filter, compare_subgraph, graph_validate, graph_merge, entity_nodes, graph_build, graph_query, graph_load,
    graph_export, graph_reuse)}

W = "WITH " + B.GRAPH
_FROM, _TO = "split_part(source, ':', 2)::BIGINT", "split_part(target, ':', 2)::BIGINT"
PLACED = f"""placed AS (SELECT *, CASE WHEN relation = 'supplies' THEN {_FROM} * 1000000 + {_TO} WHEN source LIKE 'S:%' THEN {_FROM} + 100000000000000
  WHEN source LIKE 'C:%' THEN {_FROM} + 200000000000000 ELSE {_FROM} + 300000000000000 END AS ord FROM edges)"""
NEIGHBORS = """nb AS (SELECT e.source AS id, e.target AS neighbor_id, coalesce(n.name, e.target) AS neighbor_name, coalesce(n.type, 'unknown') AS neighbor_type, e.relation
  FROM edges e LEFT JOIN nodes n ON n.id = e.target)"""
TRADE = """trade AS (SELECT source, target, relation FROM edges UNION ALL SELECT DISTINCT 'C:' || o_custkey, 'S:' || l_suppkey, 'buys_from' FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""
EGO = """ego0 AS (SELECT id AS centre, id FROM nodes WHERE type IN ('supplier', 'customer')),
ego1 AS (SELECT centre, target AS id FROM ego0 JOIN edges ON source = id UNION SELECT * FROM ego0),
ego AS (SELECT centre, target AS id FROM ego1 JOIN edges ON source = id UNION SELECT * FROM ego1)"""
WORDS = "words AS (SELECT DISTINCT upper(w) AS term FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))"
ENTS = """asked AS (SELECT DISTINCT entity FROM (SELECT p_name AS entity FROM part UNION ALL SELECT s_name FROM supplier UNION ALL SELECT 'N:' || n_nationkey FROM nation))"""
RESOLVED = """res AS (SELECT entity, arg_min(id, ord) AS id FROM (SELECT a.entity, n.id, n.ord FROM asked a JOIN nodes n ON n.name = a.entity UNION ALL SELECT a.entity, n.id, n.ord FROM asked a JOIN nodes n ON n.id = a.entity) GROUP BY entity)"""
STATS = """SELECT kind, coalesce(label, '*') AS label, count(*) AS n{} FROM (SELECT 'node' AS kind, type AS label FROM nodes UNION ALL SELECT 'edge', relation FROM edges) GROUP BY GROUPING SETS ((kind), (kind, label))"""
DEGREE = """deg AS (SELECT n.id, coalesce(d.degree, 0) AS degree FROM nodes n LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id) d USING (id))"""
PROPS = """props AS (SELECT 'P:' || p_partkey AS id, 'brand: ' || p_brand || '<br>kind: ' || p_type || '<br>size: ' || p_size || '<br>' AS facts FROM part
  UNION ALL SELECT 'S:' || s_suppkey, 'nation: ' || s_nationkey || '<br>' FROM supplier UNION ALL SELECT 'C:' || c_custkey, 'segment: ' || c_mktsegment || '<br>' FROM customer)"""

ORACLES = {
    "node_upsert": f"""{W} SELECT id, CASE WHEN type = 'supplier' THEN 'new ' || name ELSE name END AS name, CASE WHEN type = 'supplier' THEN 'vendor' ELSE type END AS type, ord FROM nodes
UNION ALL SELECT 'X:' || r_regionkey, 'X:' || r_regionkey, 'extra', r_regionkey + 1000000 FROM region""",
    "edge_upsert": f"""{W}, back AS (SELECT DISTINCT 'S:' || l_suppkey AS source, 'P:' || l_partkey AS target FROM lineitem WHERE l_returnflag = 'R')
SELECT e.source, e.target, CASE WHEN b.source IS NOT NULL THEN 'returned_to' ELSE relation END AS relation FROM edges e LEFT JOIN back b USING (source, target)
UNION ALL SELECT 'S:' || s_suppkey, 'R:' || (s_suppkey % 5), 'serves' FROM supplier""",
    "implicit_nodes": f"""{W} SELECT DISTINCT id, id AS name, 'unknown' AS type FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges)
WHERE id NOT IN (SELECT id FROM nodes WHERE type NOT IN ('customer', 'region'))""",
    "node_lookup": f"""{W} SELECT i.id, coalesce(name, '-') AS name, coalesce(type, '-') AS type FROM (SELECT DISTINCT 'C:' || (o_custkey * 2) AS id FROM orders) i LEFT JOIN nodes USING (id)""",
    "neighbors": f"{W}, {NEIGHBORS} SELECT * FROM nb",
    "typed_neighbors": f"{W}, {NEIGHBORS} SELECT id, neighbor_name AS name FROM nb WHERE relation = 'supplies'",
    "typed_pairs": f"{W}, {NEIGHBORS} SELECT id, neighbor_name AS name, relation FROM nb WHERE relation = 'part_of'",
    "forward_lookup": f"{W}, {NEIGHBORS} SELECT id, neighbor_name AS name FROM nb WHERE relation = 'located_in' AND id LIKE 'C:%'",
    "reverse_lookup": f"{W} SELECT e.target AS id, n.id AS source_id, n.name FROM edges e JOIN nodes n ON n.id = e.source WHERE n.type = 'supplier' AND e.relation = 'located_in'",
    "simple_paths": f"""{W}, {TRADE}, pairs AS (SELECT 'C:' || c_custkey AS source, 'R:' || (c_custkey % 5) AS target FROM customer),
l1 AS (SELECT p.source, p.target, e.target AS node, [p.source, e.target] AS path FROM pairs p JOIN trade e ON e.source = p.source),
l2 AS (SELECT l.source, l.target, e.target AS node, list_append(l.path, e.target) AS path FROM l1 l JOIN trade e ON e.source = l.node WHERE l.node <> l.target AND NOT list_contains(l.path, e.target)),
l3 AS (SELECT l.source, l.target, e.target AS node, list_append(l.path, e.target) AS path FROM l2 l JOIN trade e ON e.source = l.node WHERE l.node <> l.target AND NOT list_contains(l.path, e.target))
SELECT source, target, array_to_string(path, '>') AS path FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) WHERE node = target""",
    "ego_nodes": f"{W}, {EGO} SELECT centre, id FROM ego",
    "ego_edges": f"{W}, {EGO} SELECT a.centre, e.source, e.target, e.relation FROM edges e JOIN ego a ON a.id = e.source JOIN ego b ON b.centre = a.centre AND b.id = e.target",
    "graph_stats": f"{W} " + STATS.format(""),
    "node_search": f"{W}, {WORDS} SELECT term, id, name, type FROM words JOIN nodes ON contains(lower(name), lower(term)) OR contains(lower(id), lower(term))",
    "entity_resolve": f"{W}, {NEIGHBORS}, {ENTS}, {RESOLVED} SELECT r.entity, r.id, nb.neighbor_id, nb.neighbor_name, nb.neighbor_type, nb.relation FROM res r JOIN nb USING (id)",
    "node_degree": f"{W}, {DEGREE} SELECT id, degree, 15 + least(degree * 2, 25) AS size FROM deg",
    "graph_view_nodes": f"""{W}, {DEGREE}, {PROPS} SELECT n.id, n.name AS label,
  '<b>' || n.name || '</b><br>类型: ' || CASE n.type WHEN 'part' THEN 'Part' WHEN 'nation' THEN 'Nation' ELSE '未知' END || '<br>' || coalesce(p.facts, '') AS title,
  CASE n.type WHEN 'part' THEN '#2E7D32' WHEN 'nation' THEN '#7B1FA2' ELSE '#757575' END AS color, 15 + least(degree * 2, 25) AS size FROM nodes n JOIN deg USING (id) LEFT JOIN props p USING (id)""",
    "graph_view_edges": f"""{W}, shown AS (SELECT source, target, CASE relation WHEN 'supplies' THEN 'uses' WHEN 'part_of' THEN 'within' ELSE relation END AS label, relation FROM edges)
SELECT s.source, s.target, a.name || ' → ' || label || ' → ' || b.name AS title, label, CASE WHEN relation = 'supplies' THEN '#2E7D32' ELSE '#9E9E9E' END AS color
  FROM shown s JOIN nodes a ON a.id = s.source JOIN nodes b ON b.id = s.target""",
    "graph_type_filter": f"{W} SELECT e.source, e.target, e.relation FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE a.type = 'supplier' OR b.type = 'supplier'",
    "compare_subgraph": f"""{W}, sel AS (SELECT id FROM nodes WHERE type = 'supplier'), mem AS (SELECT id FROM sel UNION SELECT target FROM edges JOIN sel ON source = id)
SELECT 'node' AS kind, id, name AS other, CASE WHEN id IN (SELECT id FROM sel) THEN 'true' ELSE 'false' END AS info FROM mem JOIN nodes USING (id)
UNION ALL SELECT 'edge', source, target, relation FROM edges WHERE source IN (SELECT id FROM mem) AND target IN (SELECT id FROM mem)""",
    "graph_validate": f"""{W}, d AS (SELECT * FROM nodes WHERE type <> 'region'), ends AS (SELECT source AS id FROM edges UNION SELECT target FROM edges)
SELECT 'isolated' AS issue, id AS subject, '' AS detail FROM d WHERE id NOT IN (SELECT id FROM ends)
UNION ALL SELECT 'duplicate_name', id, prev FROM (SELECT id, lag(id) OVER (PARTITION BY name ORDER BY ord, id) AS prev FROM d) WHERE prev IS NOT NULL
UNION ALL SELECT 'undeclared_end', source, target FROM edges WHERE source NOT IN (SELECT id FROM d) OR target NOT IN (SELECT id FROM d)""",
    "graph_merge": f"""{W}, {TRADE} SELECT 'node' AS kind, id AS a, '' AS b, type AS label FROM nodes UNION ALL SELECT 'node', 'X:' || r_regionkey, '', 'extra' FROM region
UNION ALL SELECT 'edge', source, target, CASE WHEN relation = 'buys_from' THEN 'other' ELSE relation END FROM trade""",
    "entity_nodes": f"""WITH {B.DOCS}, {WORDS}, names AS (SELECT DISTINCT name FROM (SELECT lower(term) AS name FROM words UNION ALL SELECT keyword FROM lex))
SELECT name AS id, name, 'craft' AS type, max(doc_id)::VARCHAR AS source_doc FROM names JOIN docs ON contains(content, name) GROUP BY name""",
    "graph_build": """SELECT 'node' AS kind, 'R:' || r_regionkey AS a, '' AS b, 'region' AS label FROM region
UNION ALL SELECT 'node', 'N:' || n_nationkey, 'region=' || n_regionkey, 'nation' FROM nation
UNION ALL SELECT 'node', 'S:' || s_suppkey, 'nation=' || s_nationkey, 'supplier' FROM supplier
UNION ALL SELECT 'node', 'C:' || c_custkey, 'segment=' || c_mktsegment, 'customer' FROM customer
UNION ALL SELECT 'edge', 'S:' || s_suppkey, 'N:' || s_nationkey, 'located_in' FROM supplier
UNION ALL SELECT 'edge', 'C:' || c_custkey, 'N:' || c_nationkey, 'located_in' FROM customer
UNION ALL SELECT 'edge', 'N:' || n_nationkey, 'R:' || n_regionkey, 'part_of' FROM nation""",
    "graph_query": f"""{W}, {NEIGHBORS}, rq AS (SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'S:' || s_suppkey END AS entity, CASE WHEN s_suppkey % 3 = 0 THEN 'located_in' END AS relation FROM supplier),
asked AS (SELECT DISTINCT entity FROM rq), {RESOLVED},
starts AS (SELECT request_id, rq.relation AS want, res.id FROM rq JOIN res USING (entity)
  UNION SELECT n_nationkey + 1000000, NULL, nodes.id FROM nation JOIN nodes ON contains(lower(nodes.name), lower(n_name)) OR contains(lower(nodes.id), lower(n_name)))
SELECT s.request_id, nb.id, nb.neighbor_id, nb.neighbor_name, nb.neighbor_type, nb.relation FROM starts s JOIN nb USING (id) WHERE want IS NULL OR want = nb.relation""",
    "graph_load": f"""{W}, {PLACED} SELECT 'node' AS kind, id AS a, CASE WHEN type = 'region' THEN id ELSE name END AS b, CASE WHEN type = 'customer' THEN 'unknown' ELSE type END AS label, ord FROM nodes
UNION ALL SELECT 'edge', source, target, CASE WHEN relation = 'part_of' THEN 'related_to' ELSE relation END, ord FROM placed""",
    "graph_export": f"""{W}, {PLACED} SELECT 'node' AS kind, id AS a, name AS b, type AS label, ord FROM nodes UNION ALL SELECT 'edge', source, target, relation, ord FROM placed
UNION ALL SELECT 'count', 'node', '', '', count(*) FROM nodes UNION ALL SELECT 'count', 'edge', '', '', count(*) FROM edges""",
    "graph_reuse": f"{W} " + STATS.format(", true AS reused"),
}
