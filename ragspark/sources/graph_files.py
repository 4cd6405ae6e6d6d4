"""Graph and profile files.

A graph is a folder of JSON documents, each with `nodes` and `edges` arrays; a single document is the
one-file case. Shards keep every document small, so no task holds a whole graph. Every node and edge carries its
insertion order `ord`, so "first inserted wins" holds after a reload too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.operators.graph import NODE_DEFAULTS, RELATION_DEFAULT

GRAPH_SCHEMA = (
    "nodes ARRAY<STRUCT<id: STRING, name: STRING, type: STRING, properties: MAP<STRING, STRING>, ord: BIGINT>>, "
    "edges ARRAY<STRUCT<source: STRING, target: STRING, relation: STRING, properties: MAP<STRING, STRING>, ord: BIGINT>>, "
    "metadata STRUCT<shard: BIGINT, node_count: BIGINT, edge_count: BIGINT>"
)
SHARD_BYTES = 32 * 1024 * 1024


def graph_rows(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed documents, with defaults: name = id, type = unknown, relation = related_to, no properties.

    Rows without `ord`, as in files written elsewhere, take their place in the document.
    """
    shard = F.coalesce("metadata.shard", F.lit(0)) * F.lit(1 << 32)
    none = F.create_map().cast("map<string,string>")
    nodes = documents.select(shard.alias("_s"), F.posexplode("nodes").alias("_p", "n")).select(
        F.col("n.id").alias("id"),
        F.coalesce("n.name", "n.id").alias("name"),
        F.coalesce("n.type", F.lit(NODE_DEFAULTS["type"])).alias("type"),
        F.coalesce("n.properties", none).alias("properties"),
        F.coalesce("n.ord", F.col("_s") + F.col("_p")).alias("ord"),
    )
    edges = documents.select(shard.alias("_s"), F.posexplode("edges").alias("_p", "e")).select(
        F.col("e.source").alias("source"),
        F.col("e.target").alias("target"),
        F.coalesce("e.relation", F.lit(RELATION_DEFAULT)).alias("relation"),
        F.coalesce("e.properties", none).alias("properties"),
        F.coalesce("e.ord", F.col("_s") + F.col("_p")).alias("ord"),
    )
    return nodes, edges


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return graph_rows(spark.read.schema(GRAPH_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").json(path))


def graph_documents(nodes: DataFrame, edges: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, document): JSON documents of about `shard_bytes` with recomputed counts, in the order of `ord` each.

    The number of shards follows the bytes of all rows, and a hash of the key spreads the rows over them.
    """
    node = F.struct("id", "name", "type", "properties", F.col("ord").cast("long").alias("ord"))
    edge = F.struct("source", "target", "relation", "properties", F.col("ord").cast("long").alias("ord"))
    size = lambda df, row: df.agg(F.sum(F.octet_length(F.to_json(row)).cast("long"))).first()[0] or 0
    shards = (size(nodes, node) + size(edges, edge)) // shard_bytes + 1
    slot_n = F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard")
    slot_e = F.pmod(F.xxhash64("source", "target"), F.lit(shards)).alias("shard")
    rows = nodes.select(slot_n, node.alias("n"), F.lit(None).cast(edges.select(edge.alias("e")).schema["e"].dataType).alias("e")).unionByName(
        edges.select(slot_e, F.lit(None).cast(nodes.select(node.alias("n")).schema["n"].dataType).alias("n"), edge.alias("e")))
    in_order = lambda c: F.array_sort(F.collect_list(c), lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))
    packed = rows.groupBy("shard").agg(in_order("n").alias("nodes"), in_order("e").alias("edges"))
    counts = F.struct(F.col("shard"), F.size("nodes").cast("long").alias("node_count"), F.size("edges").cast("long").alias("edge_count"))
    return packed.select("shard", F.to_json(F.struct("nodes", "edges", counts.alias("metadata"))).alias("document"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the shards as JSON files, one document per line and one line per file."""
    docs = graph_documents(nodes, edges, shard_bytes)
    docs.repartition("shard").select(F.col("document").alias("value")).write.option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """A row per user profile of a profile file, with whatever nested fields it has."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode("profiles").alias("p")).select("p.*")
