"""Quality rules by distribution divergence, with DataFrame functions only.

Each document has a histogram over character classes and one over the common words of its language (and all other
words). The references of a language are the means of the same histograms over its distinct texts that pass the base rule; its common words are the
most frequent ones in them. A document is rejected when the Jensen-Shannon distance of a long enough histogram to its reference
exceeds a limit, which follows from the distances of these texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.llm.tables import settle, small_side

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
STEPS = 100_000  # distances are counted by such parts of 1
ALL = "*"  # the pool of all languages; that of one begins with =
MARKS = [chr(c) for c in range(0x41, 0x41 + 26)]  # one letter for each common word


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    inside = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, f"[{SPACE}]+"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words inside windows of `window` words that the text holds at least twice, all of them counted. Windows are compared by 64-bit hashes."""
    def starts(cells: Column) -> Column:
        """Starts of repeated windows, given (hash, start) in order."""
        same = lambda x, i: (
            (F.get(cells, i - 1)["h"] == x["h"]) & (i > 0)) | F.coalesce(F.get(cells, i + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(cells, same), lambda x: x["at"]))

    def covered(at: Column) -> Column:
        gap = lambda x, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - x, F.lit(window)))
        return F.aggregate(F.transform(at, gap), F.lit(0), lambda s, x: s + x)

    def count(hashes: Column) -> Column:
        cells = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
            _let(cells, lambda c: _let(starts(c), covered)))

    def windows(one: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(one) - (window - 1)), lambda i: F.xxhash64(F.slice(one, i, window)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= window, 0).otherwise(_let(hashed, lambda one: _let(windows(one), count))).cast("long")


def char_classes(text: Column) -> list[tuple[str, Column]]:
    """Counts of: lower-case ASCII letters, capitals, digits, white space, symbols, other ASCII, other characters."""
    every = F.length(text)
    found, before = [], text
    left = every
    for name, pattern in (("lower", "[a-z]+"), ("space", f"[{SPACE}]+"), ("upper", "[A-Z]+"), ("other", r"[^\x00-\x7F]+"),
                          ("symbol", f"[{SYMBOLS}]+".replace("|", r"\|").replace("*", r"\*").replace("$", r"\$").replace("&", r"\&")), ("digit", "[0-9]+")):
        before = F.regexp_replace(before, pattern, "")
        now = F.length(before)
        found.append((name, (left - now).cast("long")))
        left = now
    return [*found, ("ascii", left.cast("long"))]


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root, base 2) of two histograms of equal length; null if one of them is empty."""
    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def term(a, b):
        m = (a + b) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (part(a) + part(b)) / 2

    p, q = (F.transform(x, lambda v: v.cast("double")) for x in (p, q))
    both = _let(F.struct(p.alias("p"), q.alias("q"), total(p).alias("tp"), total(q).alias("tq")), lambda z: F.when(
        (z["tp"] > 0) & (z["tq"] > 0),
        F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(z["p"], z["q"], lambda a, b: term(a / z["tp"], b / z["tq"])))))))
    return F.round(both, 9)


def common_words(texts: DataFrame, most: int) -> DataFrame:
    """language, common: the most frequent words of each language in (language, words, copies), in order; ties by the word.

    A text that occurs `copies` times is counted once: its words come that often, so the counts divide without rest.
    """
    counts = texts.select("language", "copies", F.explode("words").alias("word")).groupBy("language", "word", "copies").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy("language", "word").agg(F.sum(F.expr("n div copies")).alias("n"))
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), F.asc("word")))
    top = counts.withColumn("place", place).where(F.col("place") <= most)
    return top.groupBy("language").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("common"))


def mean_shares(votes: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """pool, ref_<name> for each name of `sizes`: the mean of the normalised histograms <name> where in_<name>, in billionths, so that sums are exact."""
    def share(name: str, i: int) -> Column:
        total = F.aggregate(name, F.lit(0).cast("long"), lambda s, v: s + v)
        return F.sum(F.when(F.col(f"in_{name}"), F.round(F.get(name, F.lit(i)) * 1e9 / total).cast("long")))

    sums = [share(name, i).alias(f"{name}{i}") for name, n in sizes.items() for i in range(n)]
    return votes.groupBy("pool").agg(*sums).select(
        "pool", *[F.array(*[F.col(f"{name}{i}") for i in range(n)]).alias(f"ref_{name}") for name, n in sizes.items()])


def robust_limits(votes: DataFrame, name: str) -> DataFrame:
    """pool, mid_<name>, spread_<name>: median of the distances far_<name> and the median deviation from it, where in_<name>.

    Distances are counted by steps of 1 / STEPS, so a pool gives at most STEPS + 1 rows.
    """
    def middle(rows: DataFrame, value: str) -> DataFrame:
        up_to = F.sum("n").over(Window.partitionBy("pool").orderBy(value, "step"))
        rows = rows.withColumn("up_to", up_to).withColumn("all", F.sum("n").over(Window.partitionBy("pool")))
        return rows.where(2 * F.col("up_to") >= F.col("all")).groupBy("pool").agg(F.min(value).alias("middle"))

    steps = votes.where(F.col(f"in_{name}") & F.col(f"far_{name}").isNotNull()).select("pool", F.round(F.col(f"far_{name}") * STEPS).cast("long").alias("step"))
    steps = settle(steps.groupBy("pool", "step").agg(F.count(F.lit(1)).alias("n")))
    mid = middle(steps, "step").withColumnRenamed("middle", "mid")
    off = steps.join(F.broadcast(mid), "pool").withColumn("off", F.abs(F.col("step") - F.col("mid")))
    return mid.join(middle(off, "off"), "pool").select(
        "pool", (F.col("mid") / STEPS).alias(f"mid_{name}"), (F.col("middle") / STEPS).alias(f"spread_{name}"))


def judge_quality(docs: DataFrame, common: int = 20, min_words: int = 50, min_chars: int = 200, min_reference_words: int = 2000,
                  char_spreads: float = 24, word_spreads: float = 4.5, least_char_limit: float = 0.1, least_word_limit: float = 0.3) -> DataFrame:
    """Counts and verdict for each row of (doc_id, text, lang).

    Returns doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, char_far, char_limit,
    word_far, word_limit, kept. Words are runs of characters other than space and 0x09 to 0x0D. base_failed: under 20 words, or over 30 % of them in
    repeated 8-word windows. Otherwise a document is rejected if its character classes (char_far) or its common words (word_far; up to 26 are marked)
    are further than a limit from the reference of its language: the mean of the normalised histograms of its distinct texts that pass the base
    rule, taken again without those further than three spreads from the median. A limit is the median distance of these texts plus `char_spreads` or
    `word_spreads` times the median deviation from it, or the least limit if that is more. A language with under min_reference_words words in such texts is
    held against the reference and limits of all languages, where the common words of each count by their rank. A histogram of under
    min_chars characters or min_words words is not judged; the distance is null then, which rejects nothing.
    char_distance and word_distance only report the distance to the sum of all histograms of the language, null also under min_reference_words words.
    A null lang is a language. Null, empty and wordless texts have zero counts and fail the base rule. Repeated rows and null ids give rows
    like any other. Texts are compared by 64-bit hashes. Other columns are not read. An empty table gives an empty result.
    """
    most = min(common, len(MARKS))
    rows = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("language"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    classes = char_classes(F.col("text"))
    plain = rows.withColumn("words", words_of(F.col("text"))).select(
        "doc_id", "lang", "language", "key", F.size("words").cast("long").alias("n_words"), duplicate_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"), F.length("text").cast("long").alias("n_chars"), *[c.alias(name) for name, c in classes])
    plain = settle(plain.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))))
    texts = settle(plain.groupBy("language", "key").agg(
        F.count(F.lit(1)).alias("copies"), F.max("base_failed").alias("base_failed"),
        *[F.max(c).alias(c) for c in ("n_words", "n_chars", *[name for name, _ in classes])]))
    voters = small_side(texts.where("NOT base_failed").select("language", "key", "copies"))
    lowered = rows.select("language", "key", words_of(F.lower("text")).alias("words"))
    top = small_side(common_words(lowered.join(voters, ["language", "key"]), most))
    marks = F.array(*[F.lit(m) for m in MARKS])
    # array_join leaves out the nulls of words that are not common.
    mark = lambda w: F.get(marks, (F.array_position(F.col("common"), w) - 1).cast("int"))
    spelled = F.coalesce(F.array_join(F.transform("words", mark), ""), F.lit(""))
    spelled = lowered.join(top, "language", "left").select("language", "key", F.size("words").alias("n"), spelled.alias("spelled"))
    hits = [(F.length("spelled") - F.length(F.replace("spelled", F.lit(m)))).cast("long") for m in MARKS[:most]]
    hits.append((F.col("n") - F.length("spelled")).cast("long"))
    marked = spelled.select("language", "key", *[h.alias(f"w{i}") for i, h in enumerate(hits)]).groupBy("language", "key").agg(
        *[F.max(f"w{i}").alias(f"w{i}") for i in range(most + 1)])
    texts = texts.join(small_side(marked), ["language", "key"]).select(
        "language", "key", "copies", "base_failed", "n_words", "n_chars", F.array(*[F.col(name) for name, _ in classes]).alias("chars"),
        F.array(*[F.col(f"w{i}") for i in range(most + 1)]).alias("hist"))
    sizes = {"chars": len(classes), "hist": most + 1}
    sums = [F.sum(F.col("copies") * F.get(name, F.lit(i))).alias(f"{name}{i}") for name, n in sizes.items() for i in range(n)]
    texts = settle(texts)
    languages = texts.groupBy("language").agg(
        F.sum(F.col("copies") * F.col("n_words")).alias("language_words"),
        F.coalesce(F.sum(F.when(~F.col("base_failed"), F.col("n_words"))), F.lit(0)).alias("voting_words"), *sums)
    languages = settle(languages.select(
        "language", "language_words", F.when(F.col("voting_words") >= min_reference_words, F.concat(F.lit("="), "language")).otherwise(ALL).alias("pool"),
        *[F.array(*[F.col(f"{name}{i}") for i in range(n)]).alias(f"sum_{name}") for name, n in sizes.items()]))
    texts = texts.join(small_side(languages), "language").withColumn("in_chars", F.col("n_chars") >= min_chars).withColumn(
        "in_hist", F.col("n_words") >= min_words)
    votes = texts.where("NOT base_failed").select("pool", "chars", "hist", "in_chars", "in_hist")
    if not languages.where(F.col("pool") == ALL).isEmpty():
        votes = votes.withColumn("pool", F.explode(F.array_distinct(F.array("pool", F.lit(ALL)))))

    def measured(rows: DataFrame, reference: DataFrame) -> DataFrame:
        """The rows with far_chars and far_hist, their distances to the reference of their pool."""
        rows = rows.join(small_side(reference), "pool", "left")
        far = [F.when(F.col(f"in_{name}"), js_distance(F.col(name), F.col(f"ref_{name}"))).alias(f"far_{name}") for name in sizes]
        return rows.select(*[c for c in rows.columns if not c.startswith("ref_")], *far)

    def limits(rows: DataFrame) -> DataFrame:
        return robust_limits(rows, "chars").join(robust_limits(rows, "hist"), "pool", "full")

    first = settle(measured(votes, mean_shares(votes, sizes)))
    near = first.join(small_side(limits(first)), "pool")
    for name in sizes:
        near = near.withColumn(f"in_{name}", F.col(f"in_{name}") & (F.col(f"far_{name}") <= F.col(f"mid_{name}") + 3 * F.col(f"spread_{name}")))
    reference = settle(mean_shares(near, sizes))
    known = F.col("language_words") >= min_reference_words
    held = measured(texts, reference).join(small_side(limits(settle(measured(votes, reference)))), "pool", "left")
    held = settle(held.select(
        "language", "key", *[F.when(known & F.col(f"in_{name}"), js_distance(F.col(name), F.col(f"sum_{name}"))).alias(f"{out}_distance")
                             for name, out in (("chars", "char"), ("hist", "word"))],
        F.col("far_chars").alias("char_far"), F.greatest(F.col("mid_chars") + char_spreads * F.col("spread_chars"), F.lit(least_char_limit)).alias("char_limit"),
        F.col("far_hist").alias("word_far"), F.greatest(F.col("mid_hist") + word_spreads * F.col("spread_hist"), F.lit(least_word_limit)).alias("word_limit")))
    judged = plain.join(small_side(held), ["language", "key"]).select(
        "doc_id", "lang", "n_words", (F.col("n_chars") - F.col("space")).alias("word_chars"), F.col("symbol").alias("n_symbols"), "n_dup_lines",
        "n_repeat_words", "base_failed", "char_distance", "word_distance", "char_far", "char_limit", "word_far", "word_limit")
    far = F.coalesce(F.col("char_far") > F.col("char_limit"), F.lit(False)) | F.coalesce(F.col("word_far") > F.col("word_limit"), F.lit(False))
    return judged.withColumn("kept", ~(F.col("base_failed") | far))
