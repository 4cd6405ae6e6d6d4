"""A stored index of character grams: which documents contain a term, read from posting lists instead of the texts.

Below its path lie texts/ (doc_id, text) and postings/ (gram, doc_id), both in buckets of doc_id, and dictionary/ (gram, df) in folders by a hash of
the gram. Texts are placed by doc_id once; a task then cuts the texts of a bucket into grams and stores them sorted by gram, so postings are
never shuffled and a gram that every document holds fills a piece of every bucket. What a search counts per (term, document), and the texts it
reads for them, lie in the same buckets too, and are met there. A search reads the parts of the postings that hold its grams, then the buckets with a
candidate, if a term needs its text to be seen at all.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions.grams import PICKS, Q, holders, long_term_grams, pick_grams, text_grams, verified
from ragspark.functions.sizing import broadcast_if_small, settled, shuffled_over, task_per_bucket
from ragspark.operators.lexical import buckets_for, read_bucketed, store_bucketed
from ragspark.session import work_path

SLOTS = 256  # folders of the dictionary, and buckets at least
GRAM_PARTS = 4  # buckets for PART_BYTES of text: a task sorts the postings of one
NAMED = 1_000  # grams or documents up to which a search names them to the files' statistics and buckets
NAMED_AT_ONCE = 10  # values of a filter that Parquet compares one by one; of longer ones it takes the least and the greatest
META = "q int, slots int, buckets int"
ZSTD = {"compression": "zstd"}


def _slot(column: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class GramIndex:
    spark: SparkSession
    path: str
    q: int
    slots: int
    buckets: int

    @staticmethod
    def build(docs: DataFrame, path: str, text: str = "content", q: int = Q, slots: int = SLOTS) -> GramIndex:
        """The index of docs (doc_id, text), stored below `path`. Null and empty texts hold no term; rows without or with the same id are searched together."""
        spark = docs.sparkSession
        rows = docs.select("doc_id", F.col(text).alias("text")).where(F.length("text") > 0)
        buckets = max(slots, GRAM_PARTS * buckets_for(rows, "text"))
        texts = store_bucketed(rows.repartition(buckets, "doc_id"), f"{path}/texts", buckets, **ZSTD)
        grams = texts.select("doc_id", F.explode(text_grams(F.col("text"), q)).alias("gram"))
        with task_per_bucket(spark):  # so that a task sorts the postings of one bucket
            postings = store_bucketed(grams, f"{path}/postings", buckets, sort=("gram", "doc_id"), **ZSTD)
        with shuffled_over(spark, buckets):  # grams grow with the texts where these are not made of the same words
            counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).withColumn("slot", _slot("gram", slots))
            counts.repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(f"{path}/dictionary")
        spark.createDataFrame([(q, slots, buckets)], META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        rows.limit(0).write.mode("overwrite").parquet(f"{path}/shape")
        return GramIndex(spark, path, q, slots, buckets)

    @staticmethod
    def open(spark: SparkSession, path: str) -> GramIndex:
        meta = spark.read.schema(META).parquet(f"{path}/meta").first()
        return GramIndex(spark, path, meta["q"], meta["slots"], meta["buckets"])

    def _read(self, part: str) -> DataFrame:
        if part == "dictionary":
            return self.spark.read.schema("gram string, df long, slot int").parquet(f"{self.path}/dictionary")
        key = self.spark.read.parquet(f"{self.path}/shape").schema["doc_id"].dataType.simpleString()
        columns = {"postings": f"doc_id {key}, gram string", "texts": f"doc_id {key}, text string"}[part]
        return read_bucketed(self.spark, f"{self.path}/{part}", self.buckets, schema=columns)

    def _counts(self, wanted: DataFrame) -> DataFrame:
        """(gram, df) of the folders that the grams lie in; their numbers are at most `slots`."""
        numbers = [r["s"] for r in wanted.select(_slot("gram", self.slots).alias("s")).distinct().collect()]
        return self._read("dictionary").where(F.col("slot").isin(numbers)).drop("slot")

    def _postings(self, picked: DataFrame) -> DataFrame:
        """The postings; where the grams are few, of the parts of the files that may hold one."""
        rows, named = self._read("postings"), _few(picked, "gram")
        if named is None:
            return rows
        parts = [F.col("gram").isin(named[at:at + NAMED_AT_ONCE]) for at in range(0, len(named), NAMED_AT_ONCE)]
        return rows.where(reduce(or_, parts, F.lit(False)))

    def picked(self, terms: DataFrame, picks: int = PICKS) -> DataFrame:
        """(gram, term, bit, all_bits): the grams a document must hold, or, for a term shorter than a gram, any of which it must hold."""
        wanted = settled(long_term_grams(terms, self.q))
        long = pick_grams(wanted, self._counts(wanted), picks)
        short = settled(terms.where(F.length("term") < self.q))
        lengths = [r["n"] for r in short.select(F.length("term").alias("n")).distinct().collect()]  # fewer than q
        if not lengths:
            return long
        starts = F.array_distinct(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.substring(F.col("gram"), F.lit(1), n)))
        begun = self._read("dictionary").select("gram", F.explode(starts).alias("term")).join(broadcast_if_small(short), "term")
        return long.unionByName(begun.select("gram", "term", F.lit(1).alias("bit"), F.lit(1).alias("all_bits")))

    def candidates(self, terms: DataFrame, picks: int = PICKS) -> DataFrame:
        """(term, doc_id): documents that hold the picked grams of a term; for terms of at most q characters these are the hits."""
        picked = settled(self.picked(terms.select("term").where(F.length("term") > 0).distinct(), picks))
        return holders(picked, self._postings(picked), "doc_id")

    def texts_of(self, candidates: DataFrame) -> DataFrame:
        """(doc_id, text) of the buckets that hold a candidate; all of them where the candidates are many."""
        texts, named = self._read("texts"), _few(candidates, "doc_id")
        if named is None:
            return texts
        known = F.col("doc_id").isin([i for i in named if i is not None])
        return texts.where(known | F.col("doc_id").isNull() if None in named else known)

    def hits(self, terms: DataFrame, term: str = "term", picks: int = PICKS) -> DataFrame:
        """(term, doc_id), once each, for every document that contains the term. Null and empty terms have no hits."""
        found = self.candidates(terms.select(F.col(term).alias("term")), picks).select("doc_id", "term")
        found = store_bucketed(found, work_path(self.spark, "candidates"), self.buckets, sort=("term", "doc_id"), **ZSTD)
        sure, doubtful = found.where(F.length("term") <= self.q), found.where(F.length("term") > self.q)
        texts = self.texts_of(doubtful)
        # Candidates and texts lie in the same buckets. Rows without an id are few, and are met apart.
        held = texts.join(doubtful, "doc_id").where(F.contains("text", "term")).select("term", "doc_id").distinct()
        blank = verified(doubtful.where("doc_id IS NULL"), texts.where("doc_id IS NULL"), "doc_id", "text")
        return sure.select("term", "doc_id").unionByName(held).unionByName(blank)


def _few(rows: DataFrame, column: str) -> list | None:
    """The distinct values of a column in order, null last, if they are at most NAMED."""
    values = [r[0] for r in rows.select(column).distinct().limit(NAMED + 1).collect()]
    return sorted(values, key=lambda v: (v is None, v or 0 if not isinstance(v, str) else v)) if len(values) <= NAMED else None
