"""BM25 index and scoring.

The index is laid out by document: texts are hash-partitioned on `doc_id` once (or read from a table
bucketed on it), and counting terms, scoring and summing per (query, document) then all happen inside that
partitioning without a further shuffle. Frequent terms are therefore no hot keys. Only the k best rows
per query and task leave it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragspark.functions.ranking import DECIMALS, top_k
from ragspark.functions.sizing import broadcast_if_small, fits, settled, settled_broadcast, shuffled_over
from ragspark.functions.text import tokenize

PRUNE_ABOVE = 20_000_000  # rows before the sums of a batch, above which common words are left out where they cannot matter
PAIR_COST = 16  # looking up a common word of a pair, or a pair without any, is taken to cost as much as so many rows of a word in a document
PART_BYTES = 16 << 20  # of text whose postings a task counts; a bucket of an index holds those of as much
MARK = " all "  # what every document is taken to hold where all of them are scored; terms have no blanks

# The usual Okapi parameters.
K1 = 1.5
B = 0.75
EPSILON = 0.25


@dataclass(frozen=True)
class Bm25Index:
    """The tables of an index.

    postings (doc_id, doc_len, term, tf): a document without tokens has one row with a null term.
    doc_len (doc_id, doc_len): one row per document.
    term_stats (term, df, raw_idf, idf).
    caps (term, len_class, max_tf, min_len): what bounds a term's contribution to documents of a class of lengths.
    parts: the buckets to store it in, where the texts were measured.
    """

    postings: DataFrame
    doc_len: DataFrame
    term_stats: DataFrame
    caps: DataFrame
    parts: int | None = None

    def save(self, path: str, buckets: int | None = None) -> Bm25Index:
        """Store the index below `path` and return it as read back.

        Postings and lengths are bucketed on doc_id, so scoring later reads them without a shuffle. Choose
        `buckets` so that one bucket of postings fits a task; the default is what `buckets_for` gave for the texts, and for an
        index that was not made of texts the shuffle partition count.
        """
        spark = self.postings.sparkSession
        buckets = buckets or self.parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        postings = store_bucketed(self.postings, f"{path}/postings", buckets)
        doc_len = store_bucketed(lengths_of(postings), f"{path}/doc_len", buckets)
        stats = term_statistics(postings, doc_len)
        with shuffled_over(spark, buckets):  # terms and their classes grow with the texts, as the buckets do
            for part, rows in (("term_stats", stats), ("caps", term_caps(postings)), ("layout", spark.range(1).select(F.lit(buckets).alias("buckets")))):
                rows.write.mode("overwrite").parquet(f"{path}/{part}")
        return Bm25Index(postings, doc_len, spark.read.parquet(f"{path}/term_stats"), spark.read.parquet(f"{path}/caps"))

    @staticmethod
    def load(spark: SparkSession, path: str, buckets: int | None = None) -> Bm25Index:
        """A stored index in a new session; the bucket count stored with it, if none is given, makes its placement by doc_id known again."""
        buckets = buckets or spark.read.parquet(f"{path}/layout").first()["buckets"]
        postings, doc_len = (read_bucketed(spark, f"{path}/{part}", buckets) for part in ("postings", "doc_len"))
        return Bm25Index(postings, doc_len, spark.read.parquet(f"{path}/term_stats"), spark.read.parquet(f"{path}/caps"))


def read_bucketed(spark: SparkSession, path: str, buckets: int, key: str = "doc_id", schema: str | None = None) -> DataFrame:
    """Files written in buckets of `key`, as a table that knows it; `schema` serves where there may be no file."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        columns = schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _table_name(path: str) -> str:
    return "ragspark_" + hashlib.md5(path.encode()).hexdigest()


def store_bucketed(df: DataFrame, path: str, buckets: int, key: str = "doc_id", sort: tuple[str, ...] = (), **options: str) -> DataFrame:
    """The rows as files in buckets of `key`, each sorted by `sort`, and as a table that knows it; `options` are those of the writer."""
    name = _table_name(path)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.write.mode("overwrite").options(path=path, **options).bucketBy(buckets, key)
    (writer.sortBy(*sort) if sort else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def text_bytes(docs: DataFrame, text: str = "content") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def buckets_for(docs: DataFrame, text: str = "content") -> int:
    """The shuffle partition count, or more, so that a bucket holds the postings of PART_BYTES of text whatever the size of the input."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs, text) // PART_BYTES))


def token_rows(docs: DataFrame, text: str = "content", mode: str = "mixed", parts: int | None = None) -> DataFrame:
    """(doc_id, tokens), placed by doc_id before tokenising, so the work is spread evenly.

    A task takes PART_BYTES of text on average: the texts are measured, unless `parts` says how many tasks share them.
    """
    placed = docs.select("doc_id", F.col(text).alias("_text")).repartition(parts or buckets_for(docs, text), "doc_id")
    return placed.select("doc_id", tokenize(F.col("_text"), mode).alias("tokens"))


def postings_of(tokens: DataFrame) -> DataFrame:
    return (
        tokens.withColumn("doc_len", F.size("tokens").cast("long"))
        .select("doc_id", "doc_len", F.explode_outer("tokens").alias("term"))
        .groupBy("doc_id", "doc_len", "term")
        .agg(F.count("term").alias("tf"))
    )


def lengths_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("doc_id", "doc_len").agg(F.count(F.lit(1)).alias("_terms")).drop("_terms")


def document_frequency(postings: DataFrame) -> DataFrame:
    """Terms are counted map-side first, so a term held by every document costs one row per task."""
    return postings.where(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_statistics(postings: DataFrame, doc_len: DataFrame) -> DataFrame:
    return statistics_of_counts(document_frequency(postings), doc_len)


def statistics_of_counts(frequency: DataFrame, doc_len: DataFrame) -> DataFrame:
    """(term, df, raw_idf, idf) of (term, df). Negative idf becomes EPSILON times the mean idf, negatives included.

    Terms with the same df share one idf, so the mean is taken over the few distinct df values.
    """
    n_docs = doc_len.agg(F.count(F.lit(1))).scalar()
    by_df = frequency.groupBy("df").agg(F.count(F.lit(1)).alias("terms"))
    floor = by_df.agg(
        F.lit(EPSILON) * F.sum(raw_idf(n_docs, F.col("df")) * F.col("terms")) / F.sum("terms")
    ).scalar()
    return frequency.withColumn("raw_idf", raw_idf(n_docs, F.col("df"))).withColumn(
        "idf", F.when(F.col("raw_idf") < 0, floor).otherwise(F.col("raw_idf"))
    )


def bm25_index(docs: DataFrame, text: str = "content", mode: str = "mixed") -> Bm25Index:
    """The index as lazy plans; `save` it when more than one query batch will use it."""
    parts = buckets_for(docs, text)
    return index_of_postings(postings_of(token_rows(docs, text, mode, parts)), parts)


def index_of_postings(postings: DataFrame, parts: int | None = None) -> Bm25Index:
    doc_len = lengths_of(postings)
    return Bm25Index(postings, doc_len, term_statistics(postings, doc_len), term_caps(postings), parts)


def len_class(doc_len: Column | str) -> Column:
    """Documents of like lengths share a class; lengths of a class differ by under a fifth."""
    return F.floor(F.log2(F.col(doc_len) + 1 if isinstance(doc_len, str) else doc_len + 1) * 4).cast("int")


def term_caps(postings: DataFrame) -> DataFrame:
    """Per term and length class the most occurrences in a document and the least length: no contribution there exceeds theirs together."""
    held = postings.where(F.col("term").isNotNull()).withColumn("len_class", len_class("doc_len"))
    return held.groupBy("term", "len_class").agg(F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"))


def raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def corpus_stats(index: Bm25Index) -> DataFrame:
    """One row (n_docs, avg_len)."""
    return index.doc_len.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def query_terms(queries: DataFrame, text: str = "question", mode: str = "mixed") -> DataFrame:
    """(query_id, term, qtf): repeated query tokens count each time."""
    return (
        queries.select("query_id", F.explode(tokenize(F.col(text), mode)).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def bm25_matches(queries: DataFrame, index: Bm25Index, text: str = "question", mode: str = "mixed",
                 decimals: int | None = DECIMALS) -> DataFrame:
    """(query_id, doc_id, score) for every pair that shares a term."""
    return _summed(index.postings, term_weights(queries, index, text, mode), index, ["term"], decimals)


def term_weights(queries: DataFrame, index: Bm25Index, text: str = "question", mode: str = "mixed") -> DataFrame:
    """(query_id, term, weight, df) of the query terms that documents hold, hinted for a broadcast where they are few."""
    terms = query_terms(queries, text, mode)
    small = fits(terms)  # the weights have at most one row per row of `terms`
    weights = (F.broadcast(terms) if small else terms).join(index.term_stats.select("term", "idf", "df"), "term").select(
        "query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "df"
    )
    return F.broadcast(weights) if small else weights


def _part(index: Bm25Index, tf: str = "tf", doc_len: str = "doc_len") -> Column:
    avg_len = index.doc_len.agg(F.avg("doc_len")).scalar()
    return F.col("weight") * (F.col(tf) * (K1 + 1)) / (F.col(tf) + K1 * (1 - B + B * F.col(doc_len) / avg_len))


def _summed(postings: DataFrame, weights: DataFrame, index: Bm25Index, on: list[str], decimals: int | None = DECIMALS) -> DataFrame:
    score = F.sum(_part(index))
    return postings.join(weights, on).groupBy("query_id", "doc_id").agg(
        (score if decimals is None else F.round(score, decimals)).alias("score"))


def bm25_candidates(queries: DataFrame, index: Bm25Index, k: int, text: str = "question", mode: str = "mixed",
                    prune_above: int | None = None) -> DataFrame:
    """(query_id, doc_id, score): matches that include the k best of every query, without a row for every pair that shares a common word.

    The rarest terms of a query are scored first; their k-th best sum is a lower bound of the k-th best score. The index bounds what a term
    adds to documents of a class of lengths. Where the terms of least bound sum to less than the k-th score in a class, they cannot lift a
    document of that class into the k best by themselves: only the other terms make pairs there, none if there are none. Of those pairs,
    the ones that the light terms can still lift are looked up by document. Up to `prune_above` expected
    (term, query, document) rows the single pass over all pairs is cheaper and gives the same k best. Where it is not given, that pass is also
    made beyond PRUNE_ABOVE if the lookups, bounded by the rows that the other terms have in the index, are too many to pay: it sums in place, bucket
    by bucket. Lookups are sorted, so their number is also what bounds the memory and the spill of this form.
    """
    weights = settled(term_weights(queries, index, text, mode))
    load = weights.agg(F.sum("df").alias("rows"), F.min("weight").alias("least")).first()
    if (load["rows"] or 0) <= (PRUNE_ABOVE if prune_above is None else prune_above) or load["least"] < 0:  # negative weights: sums are no lower bounds
        return _summed(index.postings, broadcast_if_small(weights), index, ["term"])
    # Windows over the terms of one query, as long as the query is.
    rarest = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    first = weights.withColumn("_seen", F.coalesce(F.sum("df").over(rarest), F.lit(0))).where(F.col("_seen") < 4 * k).drop("_seen")
    sums = top_k(_summed(index.postings, broadcast_if_small(first), index, ["term"]), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
    low = sums.groupBy("query_id").agg((F.min("score") - 2 * 10.0**-DECIMALS).alias("low"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k)
    split = settled(_light_and_heavy(weights.drop("df"), low.drop("_n"), index))
    if prune_above is None and _lookups_of(split, index) * PAIR_COST > load["rows"]:
        return _summed(index.postings, broadcast_if_small(weights), index, ["term"])
    heavy, light = [broadcast_if_small(split.where(c).drop("light", "low", "rest")) for c in ("NOT light", "light")]
    spare = split.groupBy("query_id", "len_class").agg(F.first("low").alias("low"), F.first("rest").alias("rest"))
    postings = index.postings.withColumn("len_class", len_class("doc_len"))
    found = postings.join(heavy, ["term", "len_class"]).groupBy("query_id", "doc_id", "len_class").agg(F.sum(_part(index)).alias("score"))
    found = found.join(broadcast_if_small(spare), ["query_id", "len_class"]).where(F.col("low").isNull() | (F.col("score") + F.col("rest") >= F.col("low")))
    wanted = found.join(light.select("query_id", "len_class", F.col("term").alias("_term"), "weight"), ["query_id", "len_class"], "left")
    # Both sides lie by doc_id. The terms are compared without being join keys, so that this placement serves and neither side is shuffled.
    some = index.postings.join(broadcast_if_small(split.where("light").select("term").distinct()), "term", "left_semi")
    some = some.select(F.col("doc_id").alias("_doc"), "term", "tf", "doc_len")
    same = (F.col("doc_id") == F.col("_doc")) & F.nullif(F.col("_term"), F.col("term")).isNull() & F.col("_term").isNotNull()
    return wanted.join(some, same, "left").groupBy("query_id", "doc_id").agg(
        F.round(F.first("score") + F.coalesce(F.sum(_part(index)), F.lit(0.0)), DECIMALS).alias("score"))


def _lookups_of(split: DataFrame, index: Bm25Index) -> int:
    """At most so many lookups follow the heavy terms: each row they meet in the index can make a pair, and that one for each light term of its class."""
    light = F.sum(F.col("light").cast("long")).over(Window.partitionBy("query_id", "len_class"))
    heavy = split.withColumn("_n", F.greatest(light, F.lit(1))).where("NOT light")
    asked = heavy.groupBy("term", "len_class").agg(F.sum("_n").alias("_n"))
    met = index.postings.select("term", len_class("doc_len").alias("len_class")).join(broadcast_if_small(asked), ["term", "len_class"])
    return met.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]


def _light_and_heavy(weights: DataFrame, low: DataFrame, index: Bm25Index) -> DataFrame:
    """(query_id, len_class, term, weight, light, low, rest): the light terms of a class sum to less than `low`, and at most to `rest`."""
    capped = index.caps.join(broadcast_if_small(weights), "term").withColumn("cap", _part(index, "max_tf", "min_len"))
    capped = capped.join(broadcast_if_small(settled(low)), "query_id", "left")
    lightest = Window.partitionBy("query_id", "len_class").orderBy("cap", "term").rowsBetween(Window.unboundedPreceding, 0)
    light = F.coalesce(F.sum("cap").over(lightest) < F.col("low"), F.lit(False))
    whole = Window.partitionBy("query_id", "len_class")
    return capped.withColumn("light", light).withColumn("rest", F.sum(F.when(F.col("light"), F.col("cap")).otherwise(0.0)).over(whole)).select(
        "query_id", "len_class", "term", "weight", "light", "low", "rest")


def bm25_topk(queries: DataFrame, index: Bm25Index, k: int = 5, text: str = "question", mode: str = "mixed",
              fill: bool = True) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of every query.

    With `fill`, a query with fewer than k positive scores is completed: documents that score zero come next, in id order,
    whether they match (a term held by half of the documents has idf 0) or not, and then negative scores. Zeros are drawn from the lowest ids,
    as many of them as leave k after the matches that do not score zero; nothing is read of other queries.
    """
    order = [F.desc("score"), F.asc("doc_id")]
    best = top_k(bm25_candidates(queries, index, k, text, mode), ["query_id"], order, k)
    kept = ["query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank")]
    if not fill:
        return best.select(*kept)
    good = settled(best.where("score > 0").select(*kept))
    enough = good.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = settled(queries.join(broadcast_if_small(enough), "query_id", "left_anti"))
    if short.isEmpty():
        return good
    nonzero = settled(bm25_matches(short, index, text, mode).where("score <> 0"))
    lowest, total, depth = index.doc_len.select("doc_id"), index.doc_len.count(), 2 * k
    while True:
        ids = [r["doc_id"] for r in lowest.orderBy("doc_id").limit(depth).collect()]  # `depth` ids, whatever the table holds
        if depth >= total:
            break
        taken = nonzero.where(F.col("doc_id") <= ids[-1]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        if depth - (taken.agg(F.max("n")).first()[0] or 0) >= k:
            break
        depth *= 4
    low = F.array(*map(F.lit, ids)).cast(f"array<{lowest.schema['doc_id'].dataType.simpleString()}>")
    zeros = short.select("query_id", F.explode(low).alias("doc_id")).distinct()
    zeros = zeros.join(nonzero.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    filled = top_k(zeros.unionByName(nonzero.select("query_id", "doc_id", "score")), ["query_id"], order, k).select(*kept)
    return good.join(broadcast_if_small(short.select("query_id").distinct()), "query_id", "left_anti").unionByName(filled)


def bm25_scores(queries: DataFrame, index: Bm25Index, text: str = "question", mode: str = "mixed") -> DataFrame:
    """Scores for all documents, (query_id, doc_id, score, n_docs): a row for every query and document, zeros included, n_docs being 1.

    Every document holds a mark that is no word, and every query asks for it with weight 0: the pairs without a common word then come out of the
    same join and the same sums as the others, bucket by bucket, without a product and without a shuffle of the pairs. Where the queries are
    too many for a broadcast there are several marks, each of a share of the documents, so that no mark is a key of all documents.
    """
    weights, asked = term_weights(queries, index, text, mode).select("query_id", "term", "weight"), queries.select("query_id").distinct()
    small = fits(weights) and fits(asked)
    marks = 1 if small else int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = asked.select("query_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(marks - 1)), _mark)).alias("term"), F.lit(0.0).alias("weight"))
    weights = weights.unionByName(every)
    marked = index.doc_len.select("doc_id", "doc_len", _mark(F.pmod(F.xxhash64("doc_id"), F.lit(marks))).alias("term"), F.lit(1).cast("long").alias("tf"))
    held = index.postings.select("doc_id", "doc_len", "term", "tf").unionByName(marked)
    part = F.when(F.startswith("term", F.lit(MARK)), 0.0).otherwise(_part(index))
    return held.join(F.broadcast(weights) if small else weights, "term").groupBy("query_id", "doc_id").agg(
        F.round(F.sum(part), DECIMALS).alias("score")).withColumn("n_docs", F.lit(1).cast("long"))


def _mark(number: Column) -> Column:
    return F.concat(F.lit(MARK), number.cast("string"))


def bm25_pair_scores(pairs: DataFrame, queries: DataFrame, index: Bm25Index, text: str = "question",
                     mode: str = "mixed") -> DataFrame:
    """Scores of given (query_id, doc_id) pairs, zeros included. Only the asked pairs are scored."""
    wanted = pairs.select("query_id", "doc_id").distinct()
    scores = _summed(index.postings.join(broadcast_if_small(wanted), "doc_id"), term_weights(queries, index, text, mode), index, ["query_id", "term"])
    return pairs.join(scores, ["query_id", "doc_id"], "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )


def bm25_filtered(queries: DataFrame, index: Bm25Index, allowed: DataFrame, k: int = 5, stage: str = "post",
                  text: str = "question", mode: str = "mixed") -> DataFrame:
    """Top k with a document filter. `post` filters the k ranked rows, so fewer may return; `pre` filters
    before ranking. Statistics come from the whole index in both cases."""
    if stage == "post":
        ranked = bm25_topk(queries, index, k, text, mode)
        # The hits are the small side (k rows per query), the allow-list may be any size.
        return allowed.select("doc_id").join(settled_broadcast(ranked), "doc_id").select(
            "query_id", "doc_id", "score", "rank")
    if stage != "pre":
        raise ValueError(f"unknown stage {stage!r}")
    ids = allowed.select("doc_id").distinct()
    kept = index.postings.join(ids, "doc_id", "left_semi")
    scores = bm25_matches(queries, Bm25Index(kept, index.doc_len, index.term_stats, index.caps), text, mode)
    return top_k(scores, ["query_id"], [F.desc("score"), F.asc("doc_id")], k).select(
        "query_id", "doc_id", "score", F.col("rank").cast("long"))
