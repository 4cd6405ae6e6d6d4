"""The typed graph as two tables.

nodes: id, name, type, properties MAP<STRING,STRING>, ord BIGINT (insertion order)
edges: source, target, relation, properties, ord; at most one edge per (source, target)
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.containment import term_hits
from ragspark.functions.ranking import rank_rows
from ragspark.functions.sizing import broadcast_if_small, fits, settled, stored
from ragspark.functions.text import label_of
from ragspark.lexicons import (
    NODE_COLORS,
    NODE_TYPE_NAMES,
    OTHER_RELATION_COLOR,
    RELATION_COLORS,
    RELATION_NAMES,
)
from ragspark.session import checkpoint_root

NODE_DEFAULTS = {"type": "unknown"}
RELATION_DEFAULT = "related_to"
ROUNDS_BEFORE_CHECKPOINT = 2
TWO_SIDED_ABOVE = 20_000_000


def _latest(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The attributes written last, at the position of the first write."""
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.struct("_version", "ord")).alias("_v"),
        F.min_by("ord", F.struct("_version", "ord")).alias("ord"),
    ).select(*keys, "_v.*", "ord")


def upsert_nodes(base: DataFrame, delta: DataFrame) -> DataFrame:
    """New attributes win; a node without a name is called by its id."""
    both = base.withColumn("_version", F.lit(0)).unionByName(delta.withColumn("_version", F.lit(1)))
    named = both.withColumn("name", F.coalesce("name", "id")).withColumn(
        "type", F.coalesce("type", F.lit(NODE_DEFAULTS["type"])))
    return _latest(named, ["id"], ["name", "type", "properties"])


def upsert_edges(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Keyed on (source, target): a later relation replaces the earlier one."""
    both = base.withColumn("_version", F.lit(0)).unionByName(delta.withColumn("_version", F.lit(1)))
    filled = both.withColumn("relation", F.coalesce("relation", F.lit(RELATION_DEFAULT)))
    return _latest(filled, ["source", "target"], ["relation", "properties"])


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("id"))


def implicit_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Endpoints nobody declared, named by their id, of type `unknown`."""
    missing = endpoints(edges).distinct().join(nodes.select("id"), "id", "left_anti")
    return missing.select("id", F.col("id").alias("name"), F.lit(NODE_DEFAULTS["type"]).alias("type"))


def get_nodes(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per requested id; the attributes are null for an unknown one."""
    return ids.join(nodes.select("id", "name", "type"), "id", "left")


def neighbors(ids: DataFrame, nodes: DataFrame, edges: DataFrame, relation: str | None = None) -> DataFrame:
    """(id, neighbor_id, neighbor_name, neighbor_type, relation) over out-edges, a row per neighbour.

    Rows, not lists: a hub's neighbours never have to fit one record.
    """
    kept = edges if relation is None else edges.where(F.col("relation") == relation)
    out = kept.select(F.col("source").alias("id"), F.col("target").alias("neighbor_id"), "relation").join(
        broadcast_if_small(ids.select("id").distinct()), "id", "left_semi")
    known = nodes.select(F.col("id").alias("neighbor_id"), F.col("name").alias("_name"), F.col("type").alias("_type"))
    return out.join(known, "neighbor_id", "left").select(
        "id",
        "neighbor_id",
        F.coalesce("_name", "neighbor_id").alias("neighbor_name"),
        F.coalesce("_type", F.lit(NODE_DEFAULTS["type"])).alias("neighbor_type"),
        "relation",
    )


def related_names(ids: DataFrame, nodes: DataFrame, edges: DataFrame, relation: str) -> DataFrame:
    """(id, name) of the neighbours over one relation: materials, tools, regions, a person's crafts."""
    return neighbors(ids, nodes, edges, relation).select("id", F.col("neighbor_name").alias("name"))


def related_pairs(ids: DataFrame, nodes: DataFrame, edges: DataFrame, relation: str) -> DataFrame:
    """(id, name, relation) of the neighbours over one relation."""
    return neighbors(ids, nodes, edges, relation).select("id", F.col("neighbor_name").alias("name"), "relation")


def reverse_names(ids: DataFrame, nodes: DataFrame, edges: DataFrame, node_type: str, relation: str) -> DataFrame:
    """(id, source_id, name): nodes of a type that point to the id over a relation."""
    incoming = edges.where(F.col("relation") == relation).select(F.col("target").alias("id"), F.col("source").alias("source_id"))
    typed = nodes.where(F.col("type") == node_type).select(F.col("id").alias("source_id"), "name")
    return incoming.join(broadcast_if_small(ids.select("id").distinct()), "id", "left_semi").join(typed, "source_id")


def _stepped(front: DataFrame, key: str, links: DataFrame, near: str, far: str) -> DataFrame:
    """(key, _node) one link further; a return to the start is on no simple path."""
    step = links.join(front.withColumnRenamed("_node", near), near).select(key, F.col(far).alias("_node"))
    return step.where(F.col("_node") != F.col(key)).distinct()


def _cost(front: DataFrame, links: DataFrame, near: str) -> int:
    """Rows that the next step makes: the links at the nodes of the front."""
    degree = links.groupBy(F.col(near).alias("_node")).agg(F.count(F.lit(1)).alias("_n"))
    return front.groupBy("_node").agg(F.count(F.lit(1)).alias("_m")).join(degree, "_node").agg(F.coalesce(F.sum(F.col("_m") * F.col("_n")), F.lit(0))).first()[0]


def path_fronts(pairs: DataFrame, links: DataFrame, max_length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(ahead, behind): ahead[i] (source, _node) with walks of i links from a source, behind[j] (target, _node) with walks of j links to a target.

    There are `max_length` steps in all, and each is made on the side where it makes fewer rows.
    """
    sides = {"source": ("_from", "_to"), "target": ("_to", "_from")}
    fronts = {key: [pairs.select(key, F.col(key).alias("_node")).distinct()] for key in sides}
    cost = {key: _cost(fronts[key][-1], links, near) for key, (near, _) in sides.items()}
    for step in range(max_length):
        key = min(cost, key=cost.get)
        near, far = sides[key]
        fronts[key].append(settled(_stepped(fronts[key][-1], key, links, near, far)))
        if step < max_length - 1:
            cost[key] = _cost(fronts[key][-1], links, near)
    return fronts["source"], fronts["target"]


def _half_paths(fronts: list[DataFrame], meets: DataFrame, key: str, depth: str, links: DataFrame, near: str, far: str) -> DataFrame:
    """(key, _node, _walk, depth): simple walks of `depth` links from the key whose every node leads on to a meeting; _walk runs outwards from the key."""
    met = lambda k: meets.where(F.col(depth) == k).select(key, "_node")
    last = len(fronts) - 1
    needed = {last: met(last).distinct()}
    for k in range(last - 1, 0, -1):
        leads = links.join(needed[k + 1].withColumnRenamed("_node", far), far).select(key, F.col(near).alias("_node"))
        needed[k] = settled(leads.join(fronts[k], [key, "_node"], "left_semi").unionByName(met(k)).distinct())
    halves = [fronts[0].select(key, "_node", F.array("_node").alias("_walk"))]
    for k in range(1, last + 1):
        # Links into needed nodes only: joining these expands nothing in vain.
        useful = links.join(needed[k].withColumnRenamed("_node", far), far)
        step = halves[-1].withColumnRenamed("_node", near).join(useful, [key, near])
        halves.append(settled(step.where(~F.array_contains("_walk", F.col(far))).select(
            key, F.col(far).alias("_node"), F.concat("_walk", F.array(far)).alias("_walk"))))
    return reduce(DataFrame.unionByName, [half.withColumn(depth, F.lit(k)) for k, half in enumerate(halves)])


def _paths_to_targets(pairs: DataFrame, links: DataFrame, max_length: int) -> DataFrame:
    """The paths by one plan: partial paths go on while their last node can still reach the pair's target in the edges left."""
    # reach[r]: (node, target) with a walk of exactly r edges from node to target.
    targets = pairs.select("target").distinct()
    within: list[DataFrame] = []
    step = links.join(broadcast_if_small(targets.withColumnRenamed("target", "_to")), "_to", "left_semi").select(
        F.col("_from").alias("_node"), F.col("_to").alias("target"))
    for left in range(1, max_length):
        within.append(step if left == 1 else within[-1].unionByName(step).distinct())
        if left < max_length - 1:
            step = links.join(step.withColumnRenamed("_node", "_to"), "_to").select(
                F.col("_from").alias("_node"), "target").distinct()
    front = pairs.select("source", "target", F.col("source").alias("_node"), F.array("source").alias("path"))
    closing = links.select(F.col("_from").alias("_node"), F.col("_to").alias("target"))
    found = front.join(closing, ["_node", "target"])
    result = found.select("source", "target", F.concat("path", F.array("target")).alias("path"))
    for used in range(1, max_length):
        ahead = within[max_length - used - 1].withColumnRenamed("_node", "_to")
        # Edges whose end still reaches the target, per target: joining these expands nothing in vain.
        useful = links.join(ahead, "_to").select(F.col("_from").alias("_node"), "target", "_to")
        front = (
            front.join(useful, ["_node", "target"])
            .where((F.col("_to") != F.col("target")) & ~F.array_contains("path", F.col("_to")))
            .select("source", "target", F.col("_to").alias("_node"), F.concat("path", F.array("_to")).alias("path"))
        )
        found = front.join(closing, ["_node", "target"])
        result = result.unionByName(found.select("source", "target", F.concat("path", F.array("target")).alias("path")))
    return result


def _steps_back(targets: DataFrame, links: DataFrame, max_length: int) -> tuple[DataFrame, list[DataFrame]] | None:
    """(closing, walks): closing (_node, target) are the links into targets, walks[r] (_node, target) the nodes with a walk of r + 1 links to a target, up to one link less than `max_length`.

    Links are only read for it, not shuffled. None where that does not go: a front is too large for a broadcast, or a step makes more rows than there are links.
    """
    if not fits(targets):
        return None
    into = links.join(F.broadcast(targets.withColumnRenamed("target", "_to")), "_to", "left_semi")
    closing = settled(into.select(F.col("_from").alias("_node"), F.col("_to").alias("target")))
    walks, total = [closing.distinct()], links.count()
    while len(walks) < max_length - 1:
        if not fits(walks[-1]):
            return None
        front = F.broadcast(walks[-1].withColumnRenamed("_node", "_to"))
        each = F.broadcast(walks[-1].groupBy(F.col("_node").alias("_to")).agg(F.count(F.lit(1)).alias("_n")))
        if (links.join(each, "_to").agg(F.sum("_n")).first()[0] or 0) > total:
            return None
        step = links.join(front, "_to").select(F.col("_from").alias("_node"), "target")
        walks.append(settled(step.where(F.col("_node") != F.col("target")).distinct()))
    return closing, walks


def _paths_along(pairs: DataFrame, links: DataFrame, max_length: int, closing: DataFrame, walks: list[DataFrame]) -> DataFrame:
    """The paths by steps from the sources into nodes that can still reach the pair's target, by `_steps_back`.

    Where those nodes are few enough, links lose the others by a broadcast and only what is left is shuffled, to meet the partial paths.
    Many of them may be ends that no link leads to (sources, mostly); those are taken out first.
    """
    closing = broadcast_if_small(closing)
    front = pairs.select("source", "target", F.col("source").alias("_node"), F.array("source").alias("path"))
    result = []
    for left in range(max_length - 1, -1, -1):
        found = front.join(closing, ["_node", "target"])
        result.append(found.select("source", "target", F.concat("path", F.array("target")).alias("path")))
        if not left:
            break
        ahead = reduce(DataFrame.unionByName, walks[:left]).distinct().withColumnRenamed("_node", "_to")
        if not fits(ahead):
            ahead = settled(ahead.join(links.select("_to").distinct(), "_to", "left_semi"))
        useful = links.join(broadcast_if_small(ahead), "_to").select(F.col("_from").alias("_node"), "target", "_to")
        front = (
            front.join(useful, ["_node", "target"])
            .where((F.col("_to") != F.col("target")) & ~F.array_contains("path", F.col("_to")))
            .select("source", "target", F.col("_to").alias("_node"), F.concat("path", F.array("_to")).alias("path"))
        )
        if left > 1:  # closed, and taken a step further
            front = stored(front, "front")
    return reduce(DataFrame.unionByName, result)


def find_paths(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, max_length: int = 3, two_sided_above: int | None = None) -> DataFrame:
    """All simple directed paths of at most `max_length` edges, (source, target, path).

    Walks start from the sources and from the targets and meet in a node; a path is put together from two halves, whose nodes all lie
    on the way to a meeting of a wanted pair. Up to `two_sided_above` edges times targets, which bounds the rows of a step back from the
    targets, one plan without stored steps is faster and gives the same. Where the bound is not given, TWO_SIDED_ABOVE is, and beyond it the steps back are tried
    first: while their fronts fit a broadcast they need no shuffle of the edges, and steps from the sources then go only where a target can be
    reached. Pairs with an unknown end, or with equal ends, have no path.
    """
    ids = nodes.select("id")
    links = edges.select(F.col("source").alias("_from"), F.col("target").alias("_to"))
    pairs = settled(
        pairs.select("source", "target").distinct().where(F.col("source") != F.col("target"))
        .join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    )
    targets = pairs.select("target").distinct()
    if links.count() * targets.count() <= (TWO_SIDED_ABOVE if two_sided_above is None else two_sided_above):
        return _paths_to_targets(pairs, links, max_length)
    if two_sided_above is None and (back := _steps_back(targets, links, max_length)) is not None:
        return _paths_along(pairs, links, max_length, *back)
    ahead, behind = path_fronts(pairs, links, max_length)
    lengths = {n: max(0, n - len(behind) + 1) for n in range(1, max_length + 1)}  # edges before the meeting, by edges in all
    met = []
    for n, before in lengths.items():
        near = ahead[before].join(behind[n - before].select("_node").distinct(), "_node", "left_semi")
        met.append(pairs.join(near, "source").join(behind[n - before], ["target", "_node"]).select(
            "source", "target", "_node", F.lit(before).alias("_before"), F.lit(n - before).alias("_after")))
    meets = settled(reduce(DataFrame.unionByName, met))
    heads = _half_paths(ahead, meets, "source", "_before", links, "_from", "_to")
    tails = _half_paths(behind, meets, "target", "_after", links, "_to", "_from")
    whole = meets.join(heads.withColumnRenamed("_walk", "_head"), ["source", "_node", "_before"]).join(tails, ["target", "_node", "_after"])
    whole = whole.where(F.size(F.array_intersect("_head", "_walk")) == 1)  # the meeting itself
    return whole.select("source", "target", F.concat("_head", F.reverse(F.slice("_walk", F.lit(1), F.col("_after")))).alias("path"))


def ego_nodes(centres: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """(centre, id): nodes reachable from each existing centre in at most `depth` out-edges."""
    links = edges.select(F.col("source").alias("_from"), F.col("target").alias("_to"))
    seen = centres.select(F.col("id").alias("centre"), "id").distinct().join(nodes.select("id"), "id", "left_semi").select("centre", "id")
    front = seen
    for done in range(1, depth + 1):
        reached = front.join(links, front["id"] == links["_from"]).select("centre", F.col("_to").alias("id")).distinct()
        front = reached.join(seen, ["centre", "id"], "left_anti")
        if done > ROUNDS_BEFORE_CHECKPOINT and done < depth:
            checkpoint_root(front.sparkSession)
            front = front.checkpoint()
        seen = seen.unionByName(front)
    return seen


def ego_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(centre, source, target, relation): edges with both ends among the centre's nodes."""
    members = settled(members)
    starts = members.withColumnRenamed("id", "source")
    ends = members.withColumnRenamed("id", "target")
    return starts.join(edges.select("source", "target", "relation"), "source").join(ends, ["centre", "target"]).select(
        "centre", "source", "target", "relation")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, label, n): totals (null label) and counts per node type and relation, in one pass."""
    rows = nodes.select(F.lit("node").alias("kind"), F.col("type").alias("label")).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.col("relation").alias("label")))
    return rows.groupingSets([["kind"], ["kind", "label"]], "kind", "label").agg(F.count(F.lit(1)).alias("n"))


def search_nodes(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, id, name, type): nodes whose name or id contains the term, ignoring case."""
    text = F.concat_ws("\u0000", F.lower("name"), F.lower("id"))
    asked = terms.select("term", F.lower("term").alias("needle")).distinct()
    hits = term_hits(nodes.select("id", text.alias("_t")), "id", "_t", asked, "needle")
    named = hits.select("id", F.explode("terms").alias("needle")).join(broadcast_if_small(asked), "needle")
    return named.join(nodes.select("id", "name", "type"), "id").select("term", "id", "name", "type")


def resolve_entities(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(entity, id): the node inserted first whose name or id is the entity."""
    by_name = nodes.select(F.col("name").alias("entity"), "id", "ord")
    by_id = nodes.select(F.col("id").alias("entity"), "id", "ord")
    asked = names.select("entity").distinct()
    return by_name.unionByName(by_id).join(broadcast_if_small(asked), "entity", "left_semi").groupBy("entity").agg(
        F.min_by("id", F.struct("ord", "id")).alias("id"))


def related_entities(names: DataFrame, nodes: DataFrame, edges: DataFrame, relation: str | None = None) -> DataFrame:
    """(entity, id, neighbor_id, neighbor_name, neighbor_type, relation)."""
    resolved = resolve_entities(names, nodes)
    return resolved.join(neighbors(resolved.select("id"), nodes, edges, relation), "id")


def graph_query(requests: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Requests (request_id, entity, relation, term): resolve the entity by name or id and the free-text
    term by search, then list the neighbours over the relation (any, when null)."""
    named = requests.join(resolve_entities(requests.where("entity is not null"), nodes), "entity")
    searched = requests.join(search_nodes(nodes, requests.where("term is not null").select("term")).select("term", "id"), "term")
    starts = named.select("request_id", F.col("relation").alias("_want"), "id").unionByName(
        searched.select("request_id", F.col("relation").alias("_want"), "id")).distinct()
    return starts.join(neighbors(starts.select("id"), nodes, edges), "id").where(
        F.col("_want").isNull() | (F.col("_want") == F.col("relation"))
    ).select("request_id", "id", "neighbor_id", "neighbor_name", "neighbor_type", "relation")


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, size): in- plus out-degree, and the display size 15 + min(2 * degree, 25)."""
    counts = endpoints(edges).groupBy("id").agg(F.count(F.lit(1)).alias("_d"))
    degree = F.coalesce("_d", F.lit(0)).cast("long")
    return nodes.select("id").join(counts, "id", "left").select(
        "id", degree.alias("degree"), (F.lit(15) + F.least(degree * 2, F.lit(25))).cast("long").alias("size"))


def graph_view_nodes(nodes: DataFrame, edges: DataFrame, colors: dict[str, str] = NODE_COLORS,
                     type_names: dict[str, str] = NODE_TYPE_NAMES) -> DataFrame:
    """(id, label, title, color, size): what a display shows for a node."""
    entries = F.slice(F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>"))), 1, 3)
    facts = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("<br>"))), "")
    kind = label_of(F.col("type"), type_names, F.lit("未知"))
    return nodes.join(node_degree(nodes, edges), "id").select(
        "id",
        F.col("name").alias("label"),
        F.concat(F.lit("<b>"), "name", F.lit("</b><br>类型: "), kind, F.lit("<br>"), facts).alias("title"),
        label_of(F.col("type"), colors, F.lit(colors["unknown"])).alias("color"),
        "size",
    )


def relation_color(relation: Column) -> Column:
    color = F.lit(OTHER_RELATION_COLOR)
    for word, value in reversed(RELATION_COLORS):
        color = F.when(F.contains(relation, F.lit(word)), value).otherwise(color)
    return color


def graph_view_edges(nodes: DataFrame, edges: DataFrame, relation_names: dict[str, str] = RELATION_NAMES) -> DataFrame:
    """(source, target, title, label, color): what a display shows for an edge."""
    names = nodes.select("id", "name")
    label = label_of(F.col("relation"), relation_names)
    return (
        edges.join(names.select(F.col("id").alias("source"), F.col("name").alias("_s")), "source", "left")
        .join(names.select(F.col("id").alias("target"), F.col("name").alias("_t")), "target", "left")
        .select(
            "source",
            "target",
            F.concat(F.coalesce("_s", "source"), F.lit(" → "), label, F.lit(" → "), F.coalesce("_t", "target")).alias("title"),
            label.alias("label"),
            relation_color(F.col("relation")).alias("color"),
        )
    )


def filter_graph_by_type(nodes: DataFrame, edges: DataFrame, node_type: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of the type, and edges with at least one end of the type."""
    kept = nodes.where(F.col("type") == node_type)
    ids = kept.select("id")
    starts = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    rest = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
    ends = rest.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    columns = ["source", "target", "relation"]
    return kept, starts.select(*columns).unionByName(ends.select(*columns))


def compare_nodes(ids: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chosen existing nodes with their out-neighbours (`is_selected`), and the edges among them."""
    chosen = ids.select("id").distinct().join(nodes.select("id"), "id", "left_semi")
    around = edges.join(broadcast_if_small(chosen.withColumnRenamed("id", "source")), "source", "left_semi").select(
        F.col("target").alias("id"), F.lit(False).alias("_sel"))
    members = chosen.withColumn("_sel", F.lit(True)).unionByName(around).groupBy("id").agg(F.max("_sel").alias("is_selected"))
    inner = edges.select("source", "target", "relation").join(
        members.select(F.col("id").alias("source")), "source", "left_semi").join(
        members.select(F.col("id").alias("target")), "target", "left_semi")
    shown = members.join(nodes.select("id", "name", "type"), "id", "left")
    return shown, inner


def validate_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(issue, subject, detail): isolated nodes, nodes sharing a name with an earlier one (the previous
    holder is the detail), and edges with an undeclared end."""
    ids = nodes.select("id")
    isolated = ids.join(endpoints(edges).distinct(), "id", "left_anti").select(
        F.lit("isolated").alias("issue"), F.col("id").alias("subject"), F.lit("").alias("detail"))
    # Holders of one name are numbered without gathering them, then each meets its predecessor.
    numbered = rank_rows(nodes.select("id", "name", "ord"), ["name"], [F.asc("ord"), F.asc("id")], "_n")
    previous = numbered.select("name", (F.col("_n") + 1).alias("_n"), F.col("id").alias("detail"))
    repeated = numbered.join(previous, ["name", "_n"]).select(
        F.lit("duplicate_name").alias("issue"), F.col("id").alias("subject"), "detail")
    open_ends = []
    for side in ("source", "target"):
        open_ends.append(edges.join(ids.withColumnRenamed("id", side), side, "left_anti").select("source", "target"))
    invalid = open_ends[0].unionByName(open_ends[1]).distinct().select(
        F.lit("undeclared_end").alias("issue"), F.col("source").alias("subject"), F.col("target").alias("detail"))
    return isolated.unionByName(repeated).unionByName(invalid)


def merge_graphs(nodes: DataFrame, edges: DataFrame, other_nodes: DataFrame,
                 other_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of two graphs; nodes and edges of the first win."""
    new_nodes = other_nodes.join(nodes.select("id"), "id", "left_anti")
    new_edges = other_edges.join(edges.select("source", "target"), ["source", "target"], "left_anti")
    return nodes.unionByName(new_nodes), edges.unionByName(new_edges)


def extract_entities(docs: DataFrame, names: DataFrame, content: str = "content", order: str = "doc_id",
                     node_type: str = "craft") -> DataFrame:
    """(id, name, type, source_doc): names that occur in documents; the last document in order is kept."""
    hits = term_hits(docs.select("doc_id", F.col(content).alias("_c")), "doc_id", "_c", names, "name")
    placed = hits if order == "doc_id" else hits.join(docs.select("doc_id", F.col(order).alias("_o")), "doc_id")
    by = F.col("doc_id") if order == "doc_id" else F.struct("_o", "doc_id")
    return (
        placed.select("*", F.explode("terms").alias("id"))
        .groupBy("id")
        .agg(F.max_by("doc_id", by).alias("source_doc"))
        .select("id", F.col("id").alias("name"), F.lit(node_type).alias("type"), F.col("source_doc").cast("string").alias("source_doc"))
    )


def node_family(df: DataFrame, id: Column, name: Column, node_type: str, properties: dict[str, Column], ord: Column) -> DataFrame:
    """One family of nodes projected out of a dimension table."""
    pairs = [x for key, value in properties.items() for x in (F.lit(key), value.cast("string"))]
    return df.select(
        id.alias("id"),
        name.alias("name"),
        F.lit(node_type).alias("type"),
        (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("properties"),
        ord.cast("long").alias("ord"),
    )


def edge_family(df: DataFrame, source: Column, target: Column, relation: str, ord: Column) -> DataFrame:
    """One family of edges projected out of a dimension or fact table."""
    return df.select(
        source.alias("source"),
        target.alias("target"),
        F.lit(relation).alias("relation"),
        F.create_map().cast("map<string,string>").alias("properties"),
        ord.cast("long").alias("ord"),
    )


def seed_graph(node_families: Sequence[DataFrame], edge_families: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Families put together in order; a key repeated in a later family replaces the earlier attributes."""
    def stack(families: Sequence[DataFrame]) -> DataFrame:
        out = families[0].withColumn("_version", F.lit(0))
        for i, family in enumerate(families[1:], 1):
            out = out.unionByName(family.withColumn("_version", F.lit(i)))
        return out

    nodes = _latest(stack(node_families), ["id"], ["name", "type", "properties"])
    edges = _latest(stack(edge_families), ["source", "target"], ["relation", "properties"])
    return nodes, edges
