"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes of UTF-8, so that its tables stay joinable and its n-grams are exact 40-bit numbers: counts of the highest order are
gathered from all trusted text, lower orders count distinct left neighbours, the three discounts of an order come from its counts of
counts, and every level is a join of count tables by n-gram, by context and by suffix. Documents are scored shard by shard: a shard holds the
n-grams whose context ends in some of the 256 bytes, at most SHARD_ROWS rows of them, and is sent to the tasks once it is measured;
the partial sums of the shards are added per document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.tables import settle, small_side
from ragspark.llm.wordhash import chunks, mix

ORDER = 5
START, STOP = 2, 3
SHARD_ROWS = 4_000_000
CHUNK = 1 << 19  # bytes of text handled at once; a task holds about a hundred times that
CONTEXT = 16  # added to the order in the key of a context
SHORT = 3  # length classes of short texts, each of half the bytes of the one before


def gram_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, code) of the highest order's n-gram that ends at each byte and at the stop after each text."""
    sizes = np.diff(offsets)
    n = len(sizes)
    pad = ORDER - 1
    starts = offsets[:-1] + np.arange(n) * (pad + 1)  # where a padded text begins
    text = np.full(int(offsets[-1]) + n * (pad + 1), START, dtype=np.uint64)
    doc = np.repeat(np.arange(n), sizes)
    text[np.arange(int(offsets[-1])) + (doc + 1) * pad + doc] = data
    text[starts + pad + sizes] = STOP
    owner = np.repeat(np.arange(n), sizes + 1)
    at = np.arange(len(owner)) + (owner + 1) * pad
    code = np.zeros(len(at), dtype=np.uint64)
    for k in range(ORDER):
        code |= text[at - k] << np.uint64(8 * k)
    return owner, code.astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of a chunk; Spark adds them up."""
    for _, data, offsets in chunks(batches, most=CHUNK):
        codes, counts = np.unique(gram_codes(data, offsets)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts.astype(np.int64))], names=["gram", "n"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and above, from counts of counts; half a count where one of them is missing."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.0
    found = [k - (k + 1) * y * more / less if y and less and more else 0.5 for k, less, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.0), float(k)) for k, d in zip((1, 2, 3), found, strict=True))


def train(trusted: DataFrame) -> DataFrame:
    """order, gram, value: log probabilities of the n-grams of every order, and under order + CONTEXT the log weights of contexts."""
    counts = settle(trusted.select("text").mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        orders[k] = settle(orders[k + 1].groupBy(suffix.alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    found: list[DataFrame] = []
    lower: DataFrame | None = None
    for k in range(1, ORDER + 1):
        table = orders[k]
        of = table.agg(*[F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)]).first()
        d1, d2, d3 = discounts(*of)
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        table = table.withColumn("context", F.shiftright("gram", 8))
        contexts = table.groupBy("context").agg(F.sum("n").alias("total"), F.sum(off).alias("off"))
        contexts = contexts.select("context", "total", (F.col("off") / F.col("total")).alias("weight"))
        table = table.join(contexts, "context")
        own = (F.col("n") - off) / F.col("total")
        if lower is None:
            table = table.withColumn("p", own + F.col("weight") / 256)
        else:
            short = lower.select(F.col("gram").alias("short"), F.col("p").alias("q"))
            table = table.join(short, F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)) == F.col("short"))
            table = table.withColumn("p", own + F.col("weight") * F.col("q"))
        lower = settle(table.select("gram", "p"))
        found += [lower.select(F.lit(k).alias("order"), "gram", F.log("p").alias("value")),
                  contexts.select(F.lit(k + CONTEXT).alias("order"), F.col("context").alias("gram"), F.log("weight").alias("value"))]
    model = found[0]
    for one in found[1:]:
        model = model.unionByName(one)
    return settle(model.where("value IS NOT NULL"))


class Table:
    """A hash table from keys to values in two arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, (2 * len(keys) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.float32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            put = left[free][first]
            self.keys[slots], self.values[slots] = keys[put], values[put]
            stays = self.keys[at] != keys[left]
            left, at = left[stays], (at[stays] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value)."""
        found, value = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.float32)
        left, at = np.arange(len(keys)), self._slot(keys)
        wanted = keys
        while len(left):
            there = self.keys[at]
            hit = there == wanted
            found[left[hit]] = True
            value[left[hit]] = self.values[at[hit]]
            go = ~hit & (there >= 0)
            left, at, wanted = left[go], (at[go] + 1) & ((1 << self.bits) - 1), wanted[go]
        return found, value


def log_probabilities(codes: np.ndarray, table: Table) -> np.ndarray:
    """Log probability of the last byte of each n-gram: that of the longest known one, with the weights of the contexts above it."""
    out = np.zeros(len(codes))
    left = np.arange(len(codes))
    for k in range(ORDER, 0, -1):
        grams = codes[left] & ((1 << 8 * k) - 1)
        found, value = table.get((k << 40) | grams)
        out[left[found]] += value[found]
        left, grams = left[~found], grams[~found]
        if not len(left):
            break
        out[left] += table.get(((k + CONTEXT) << 40) | (grams >> 8))[1]
    out[left] += math.log(1 / 256)
    return out


def shard_of(order: Column, gram: Column, shards: int) -> Column:
    """An n-gram goes by the byte before its last, a context by its last byte; single bytes and the empty context go everywhere (null)."""
    byte = F.when(order > CONTEXT, gram).otherwise(F.shiftright(gram, 8)).bitwiseAND(F.lit(255))
    return F.when(order.isin(1, 1 + CONTEXT), None).otherwise(F.pmod(byte, F.lit(shards)))


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The columns of `docs` but text, with n_bytes and perplexity by byte."""
    spark = docs.sparkSession
    shards = max(1, -(-model.count() // SHARD_ROWS))
    named = docs.withColumn("_row", F.monotonically_increasing_id())
    placed = model.withColumn("shard", shard_of(F.col("order"), F.col("gram"), shards))
    parts = None
    for s in range(shards):
        rows = placed.where((F.col("shard") == s) | F.col("shard").isNull()).select(
            (F.shiftleft(F.col("order").cast("long"), 40).bitwiseOR(F.col("gram"))).alias("key"), F.col("value").cast("float").alias("value")).toArrow()
        table = spark.sparkContext.broadcast(Table(rows["key"].to_numpy(), rows["value"].to_numpy()))

        def sums(batches: Iterator[pa.RecordBatch], s: int = s, table=table) -> Iterator[pa.RecordBatch]:
            for rows, data, offsets in chunks(batches, most=CHUNK):
                owner, codes = gram_codes(data, offsets)
                mine = (codes >> 8 & 255) % shards == s
                total = np.bincount(owner[mine], log_probabilities(codes[mine], table.value), minlength=rows.num_rows)
                yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("_row")), pa.array(total)], names=["_row", "part"])

        one = named.select("_row", "text").mapInArrow(sums, "_row long, part double")
        parts = one if parts is None else parts.unionByName(one)
    total = parts.groupBy("_row").agg(F.sum("part").alias("part"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rest = named.select(*[c for c in named.columns if c != "text"], size.alias("n_bytes"))
    return rest.join(total, "_row").withColumn("perplexity", F.round(F.exp(-F.col("part") / (F.col("n_bytes") + 1)), 6)).drop("_row", "part")


def shrunk(value: Column, n: Column, parent: Column, weight: int) -> Column:
    """The value of n cases drawn towards that of its parent, which counts as `weight` cases; geometric. The parent where there is none."""
    return F.coalesce(F.exp((n * F.log(value) + weight * F.log(parent)) / (n + weight)), parent)


def judge_perplexity(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.99, margin: float = 1.4, min_bytes: int = 200,
                     min_trusted: int = 20) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, kept for each row of (doc_id, text, lang).

    `trusted_ids` (doc_id) names the trusted documents; the model is trained on all their text. kept is false above the threshold, which is `margin` times
    the `quantile` of the perplexities of trusted documents of the same language (null is one) and length class: texts of at least `min_bytes`
    bytes, of at least a half, a quarter of it, and below; each class down takes the margin once more, for short texts differ more. A quantile of few
    documents is drawn towards what language and length class give apart, and these towards that of all trusted documents, by `min_trusted` documents'
    weight. Empty and null texts have nothing to judge and are kept. Without trusted documents nothing can be judged: threshold is null and all is
    kept. Repeated rows and null ids give rows like any other. Other columns are not read. An empty table gives an empty result.
    """
    ids = small_side(trusted_ids.where("doc_id IS NOT NULL").select("doc_id").distinct())
    rows = docs.select("doc_id", "lang", "text")
    model = train(rows.join(ids, "doc_id", "left_semi"))
    short = sum(((F.col("n_bytes") < min_bytes / 2 ** i).cast("int") for i in range(SHORT)), F.lit(0))
    scored = settle(score(rows, model).withColumn("language", F.coalesce("lang", F.lit(""))).withColumn("none", F.col("lang").isNull()).withColumn("short", short))
    trusted = settle(scored.where("n_bytes > 0").join(ids, "doc_id", "left_semi").select("language", "none", "short", "perplexity"))
    high = F.percentile_approx("perplexity", quantile, 10_000)
    overall = F.lit(trusted.agg(high.alias("q")).first()["q"]).cast("double")
    judged = scored
    for name, keys in (("lang", ["language", "none"]), ("short", ["short"]), ("cell", ["language", "none", "short"])):
        by = trusted.groupBy(*keys).agg(high.alias(f"q_{name}"), F.count(F.lit(1)).alias(f"n_{name}"))
        judged = judged.join(small_side(by), keys, "left")
    apart = [shrunk(F.col(f"q_{name}"), F.col(f"n_{name}"), overall, min_trusted) for name in ("lang", "short")]
    together = shrunk(F.col("q_cell"), F.col("n_cell"), apart[0] * apart[1] / overall, min_trusted)
    judged = judged.withColumn("threshold", together * F.pow(F.lit(margin), F.col("short") + 1))
    return judged.select("doc_id", "lang", "n_bytes", "perplexity", "threshold",
                         ((F.col("n_bytes") == 0) | F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).alias("kept"))
