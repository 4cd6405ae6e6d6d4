"""A BM25 index kept in segments: a base, later additions and removals, merged when there are many.

Below its path lie, per segment, postings and document lengths bucketed on doc_id with the same number of buckets, the document
frequencies and contribution caps of the segment, and a log with one row per change. An addition writes a segment of its own and
neither shuffles nor rewrites the others; a removal writes the removed ids, in the same buckets, and the frequencies they took along.
Statistics are sums over those counts. A reader sees the changes that are in the log, so a change that failed half-way is not seen.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions.sizing import broadcast_if_small, settled, shuffled_over
from ragspark.operators.lexical import (
    PART_BYTES, Bm25Index, buckets_for, document_frequency, lengths_of, postings_of, read_bucketed, statistics_of_counts, store_bucketed, term_caps,
    text_bytes, token_rows)

PART_TOKENS = 3_000_000  # about those of PART_BYTES of text; a merge makes more buckets where they would hold more

LOG = "version long, kind string, folder string, buckets int, key string, n_docs long"
PARTS = {"postings": "doc_id {key}, doc_len bigint, term string, tf bigint", "doc_len": "doc_id {key}, doc_len bigint", "ids": "doc_id {key}"}


@dataclass(frozen=True)
class SegmentedIndex:
    """The index below `path` as its log stands at `version`."""

    spark: SparkSession
    path: str
    changes: tuple[tuple[str, str], ...]  # (kind, folder): "add" or "remove", in order, from the last merge on
    buckets: int
    key: str  # type of doc_id
    version: int

    @staticmethod
    def create(docs: DataFrame, path: str, buckets: int | None = None, text: str = "content", mode: str = "mixed") -> SegmentedIndex:
        """A new index of docs (doc_id, content), whose base is its first segment. Choose `buckets` for the texts that are expected; the default suits the base."""
        spark = docs.sparkSession
        buckets = buckets or buckets_for(docs, text)
        empty = SegmentedIndex(spark, path, (), buckets, docs.schema["doc_id"].dataType.simpleString(), 0)
        return empty._written("merge", postings_of(token_rows(docs, text, mode, empty._parts_of(docs, text))))

    @staticmethod
    def open(spark: SparkSession, path: str) -> SegmentedIndex:
        log = spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{path}/log").orderBy("version").collect()  # a row per change
        start = max(r["version"] for r in log if r["kind"] == "merge")
        live = [r for r in log if r["version"] >= start]
        changes = tuple(("remove" if r["kind"] == "remove" else "add", r["folder"]) for r in live)
        return SegmentedIndex(spark, path, changes, live[0]["buckets"], live[0]["key"], live[-1]["version"])

    def _logged(self, kind: str, folder: str, n_docs: int) -> SegmentedIndex:
        version = self.version + 1
        self.spark.createDataFrame([(version, kind, folder, self.buckets, self.key, n_docs)], LOG).coalesce(1).write.parquet(f"{self.path}/log/{version}")
        return SegmentedIndex.open(self.spark, self.path)

    def _written(self, kind: str, postings: DataFrame) -> SegmentedIndex:
        folder = f"{self.path}/segments/{uuid.uuid4().hex}"
        stored = store_bucketed(postings, f"{folder}/postings", self.buckets)
        lengths = store_bucketed(lengths_of(stored), f"{folder}/doc_len", self.buckets)
        with shuffled_over(self.spark, self.buckets):
            document_frequency(stored).write.parquet(f"{folder}/df")
            term_caps(stored).write.parquet(f"{folder}/caps")
        return self._logged(kind, folder, lengths.count())

    def _parts_of(self, docs: DataFrame, text: str) -> int:
        """Tasks that count the postings of an addition: a multiple of the buckets, so each writes to one bucket."""
        return self.buckets * max(1, -(-text_bytes(docs, text) // (self.buckets * PART_BYTES)))

    def _read(self, folder: str, part: str) -> DataFrame:
        return read_bucketed(self.spark, f"{folder}/{part}", self.buckets, schema=PARTS[part].format(key=self.key))

    def _parts(self, part: str) -> list[DataFrame]:
        """A part of each segment without rows removed later. All tables lie in the same buckets, so nothing is shuffled."""
        tables = []
        for n, (kind, folder) in enumerate(self.changes):
            if kind != "add":
                continue
            rows = self._read(folder, part)
            for later, gone in self.changes[n + 1:]:
                if later == "remove":
                    rows = rows.join(self._read(gone, "ids").hint("merge"), "doc_id", "left_anti")
            tables.append(rows)
        return tables

    def _live(self, part: str) -> DataFrame:
        """The part of all segments. Aggregates by doc_id take their common placement as it is; a join by doc_id does so per segment."""
        return reduce(DataFrame.unionByName, self._parts(part))

    def _counts(self) -> DataFrame:
        """(term, df): the sum of what segments added and removals took."""
        parts = [self.spark.read.parquet(f"{folder}/df") for _, folder in self.changes]
        signed = [p if kind == "add" else p.withColumn("df", -F.col("df")) for p, (kind, _) in zip(parts, self.changes, strict=True)]
        return reduce(DataFrame.unionByName, signed).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def index(self) -> Bm25Index:
        """The live documents as an index; caps may be those of removed documents too, which keeps them bounds."""
        postings, doc_len = self._live("postings"), self._live("doc_len")
        caps = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{folder}/caps") for kind, folder in self.changes if kind == "add"])
        caps = caps.groupBy("term", "len_class").agg(F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
        return Bm25Index(postings, doc_len, statistics_of_counts(self._counts(), doc_len), caps)

    def add(self, delta: DataFrame, text: str = "content", mode: str = "mixed") -> SegmentedIndex:
        """The index with those documents of `delta` whose id it does not hold."""
        return self._written("add", postings_of(token_rows(self._unknown(delta), text, mode, self._parts_of(delta, text))))

    def _unknown(self, delta: DataFrame) -> DataFrame:
        """Documents whose id no segment holds: the addition is placed once and meets each segment where that lies."""
        fresh = delta.repartition(self.buckets, "doc_id")
        for held in self._parts("doc_len"):
            fresh = fresh.join(held.select("doc_id"), "doc_id", "left_anti")
        return fresh

    def remove(self, ids: DataFrame) -> tuple[SegmentedIndex, DataFrame]:
        """The index without the documents, and (doc_id, found) for every requested id."""
        asked = settled(ids.select("doc_id").distinct())
        placed = asked.repartition(self.buckets, "doc_id")
        gone = reduce(DataFrame.unionByName, [held.select("doc_id").join(placed, "doc_id", "left_semi") for held in self._parts("doc_len")])
        folder = f"{self.path}/segments/{uuid.uuid4().hex}"
        stored = store_bucketed(gone, f"{folder}/ids", self.buckets)
        took = [document_frequency(rows.join(stored, "doc_id", "left_semi")) for rows in self._parts("postings")]
        with shuffled_over(self.spark, self.buckets):
            reduce(DataFrame.unionByName, took).groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{folder}/df")
        known = broadcast_if_small(stored.withColumn("found", F.lit(True)))
        found = settled(asked.join(known, "doc_id", "left").withColumn("found", F.coalesce("found", F.lit(False))))
        return self._logged("remove", folder, stored.count()), found

    def replace(self, delta: DataFrame, text: str = "content", mode: str = "mixed") -> SegmentedIndex:
        """The index with all documents of `delta`, in place of those it holds under their ids."""
        delta = settled(delta)
        return self.remove(delta)[0].add(delta, text, mode)

    def merge(self) -> SegmentedIndex:
        """The same index in one segment. Earlier folders stay until `vacuum`, for readers that opened them."""
        tokens = self._live("doc_len").agg(F.coalesce(F.sum("doc_len"), F.lit(0))).first()[0]
        buckets, postings = max(self.buckets, -(-tokens // PART_TOKENS)), self._live("postings")
        grown = postings if buckets == self.buckets else postings.repartition(buckets, "doc_id")
        return replace(self, buckets=buckets)._written("merge", grown)

    def vacuum(self) -> int:
        """Delete the folders that the log no longer leads to; returns how many."""
        spark, kept = self.spark, {folder.rsplit("/", 1)[1] for _, folder in self.changes}
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments")
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        old = [f.getPath() for f in files.listStatus(root) if f.getPath().getName() not in kept]
        for folder in old:
            files.delete(folder, True)
        return len(old)
