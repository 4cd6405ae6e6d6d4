"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

A source's documents are shuffled by a hash of the id. The virtual finish time of a document is the words its source has
queued up to it, divided by the source's target; a source whose target exceeds its size queues its documents again, up to
`repeats` times. All entries are sorted by finish time over the whole table and cut off at the total budget. Running sums are taken bucket by
bucket (a bucket holds bounded rows, whatever the size of the source) on top of the sums of the buckets before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.llm.tables import settle, small_side

BUCKET_ROWS = 5_000


def word_count(text: str) -> Column:
    """Number of runs of characters other than space and 0x09 to 0x0D; 0 for null."""
    gaps = F.regexp_replace(F.col(text), r"[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.length(F.regexp_replace(gaps, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """`name`: the sum of `value` inside the group up to and with the row, by bucket and then by `order`."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_inside", F.sum(value).over(inside))
    return rows.join(small_side(before), [*group, bucket]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """source, source_size, target for (source, source_size), a row per source.

    Weights go round in code point order of the sources, null last. The level is the one at which min(level * weight, repeats * size) sums to
    all sizes: sources are taken in the order in which they fill up, and the first that does not fill sets the level.
    The table has a row per source, and one task sorts it.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(place) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * repeats)
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.select(
        "*",
        F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
        F.sum("source_size").over(Window.partitionBy()).alias("total"))
    rows = rows.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    rows = rows.withColumn("reached", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(
        (F.col("cap") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(Window.partitionBy())["level"])
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("reached") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: str = "mix",
                row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for each row of (doc_id, text, source), and the column `row` if one is named.

    size counts the words; taken is size times copies, the times the mix takes the document (0 to `repeats`). Every source's
    taken words end within a document of its target, and all of them within a document of the budget, the words of all sources.
    Null and wordless texts have size 0 and are taken 0 times. A null source is a source. Rows repeated in full, and documents whose
    shuffle hash is equal, come in order of doc_id and size and then of `row`, which should tell rows apart; without it, equal ones are interchangeable. Other columns
    are not read. An empty table gives an empty result. The order depends on doc_id and `seed` alone, so runs agree.
    """
    own = [row] if row else []
    rows = settle(docs.select("doc_id", *own, "source", word_count("text").alias("size"),
                              F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("order")))
    n = rows.count()
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = settle(source_targets(sizes, weights, repeats).withColumn("key", F.coalesce("source", F.lit("")))
                     .withColumn("none", F.col("source").isNull()))
    keyed = rows.withColumn("key", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
    keyed = keyed.join(small_side(targets.drop("source")), ["key", "none"])
    digits = 1
    while 16 ** digits * BUCKET_ROWS < n:
        digits += 1
    queued = running(keyed.withColumn("bucket", F.left("order", F.lit(digits))), ["key", "none"], "bucket", ["order", "doc_id", "size", *own], "size", "queued")
    queued = settle(queued.drop("bucket"))
    rounds = F.least(F.lit(repeats), F.floor(F.col("target") / F.col("source_size")) + 1).cast("int")
    entries = queued.where("size > 0 AND target > 0").withColumn("round", F.explode(F.sequence(F.lit(1), rounds)))
    finish = ((F.col("round") - 1) * F.col("source_size") + F.col("queued")) / F.col("target")
    entries = entries.select("doc_id", "key", "none", "size", "order", "queued", "round", finish.alias("finish"))
    slices = max(1, n // BUCKET_ROWS)
    sent = running(entries.withColumn("all", F.lit(0)).withColumn("slice", F.floor(F.col("finish") * slices)),
                   ["all"], "slice", ["finish", "order", "key", "round", "doc_id", "size"], "size", "sent")
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    # A document with words is known by the words queued up to it, which no other one of its source shares.
    place = ["key", "none", "queued", "size"]
    copies = sent.where(F.col("sent") <= budget).groupBy(*place).agg(F.count(F.lit(1)).alias("times"))
    times = F.coalesce("times", F.lit(0))
    return queued.join(copies, place, "left").select(
        "doc_id", *own, "source", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), times.cast("int").alias("copies"))
