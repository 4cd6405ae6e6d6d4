"""URL filter by a ratio of character language models, with DataFrame functions only.

URLs that a rule allows or blocks train one variable-order Markov model each. A character's probability under a context of up to
ORDER characters is smoothed with that under the context shortened by one: p(c | x) = (n(xc) + m * p(c | x')) / (n(x) + m). The
log ratio of the two models falls apart into one addend for each n-gram the training URLs hold, so a URL is scored by a join of its
n-grams with that table; unseen n-grams add nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.tables import settle, small_side

ORDER = 3
MASS = 4.0  # m
ALPHABET = 128.0
START, STOP = "\u0002", "\u0003"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty for null and where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule (struct of rule and verdict) that fits, or null. A rule fits its host, subdomains, and paths that start with its path."""
    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)

    ordered = sorted(rules, key=lambda r: -len(r[0]))
    return F.coalesce(*[F.when(fits(r), F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"))) for r, v in ordered])


def url_grams(urls: DataFrame, *keep: str) -> DataFrame:
    """`keep` and gram: the n-grams of 1 to ORDER + 1 characters that end at each character of a URL or at its end."""
    text = F.concat(F.lit(START * ORDER), F.col("url"), F.lit(STOP))
    ends = F.sequence(F.lit(ORDER + 1), F.length("url") + (ORDER + 1))
    rows = urls.select(*keep, text.alias("text"), F.explode(ends).alias("end"))
    grams = F.array(*[F.substring(F.col("text"), F.col("end") - k, F.lit(k + 1)) for k in range(ORDER + 1)])
    return rows.select(*keep, F.explode(grams).alias("gram"))


def ratio_table(labelled: DataFrame) -> tuple[DataFrame, float]:
    """(gram, value): what an n-gram adds to the log ratio of accepted to rejected; and what each character adds by itself.

    `labelled` has url and accepted (boolean).
    """
    counts = url_grams(labelled, "accepted").groupBy("gram").agg(
        F.sum(F.when(F.col("accepted"), 1).otherwise(0)).cast("double").alias("a"),
        F.sum(F.when(F.col("accepted"), 0).otherwise(1)).cast("double").alias("r"))
    counts = settle(counts.withColumn("size", F.length("gram")))
    contexts = counts.groupBy(F.expr("left(gram, size - 1)").alias("context")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
    rows = settle(counts.join(contexts, F.expr("left(gram, size - 1)") == F.col("context")))
    total = contexts.where("context = ''").first()
    base = float(math.log((total["cr"] + MASS) / (total["ca"] + MASS))) if total else 0.0
    level = rows.where("size = 1").withColumn("pa", (F.col("a") + MASS / ALPHABET) / (F.col("ca") + MASS)).withColumn(
        "pr", (F.col("r") + MASS / ALPHABET) / (F.col("cr") + MASS)).withColumn("value", F.log(F.col("pa") / F.col("pr")) - base)
    levels = [level.select("gram", "value")]
    for size in range(2, ORDER + 2):
        lower = level.select(F.col("gram").alias("short"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        level = rows.where(F.col("size") == size).join(lower, F.expr("substring(gram, 2)") == F.col("short"))
        ea, er = MASS / (F.col("ca") + MASS), MASS / (F.col("cr") + MASS)
        level = level.withColumn("pa", F.col("a") / (F.col("ca") + MASS) + ea * F.col("qa")).withColumn(
            "pr", F.col("r") / (F.col("cr") + MASS) + er * F.col("qr"))
        level = level.withColumn("value", F.log(F.col("pa") / (ea * F.col("qa"))) - F.log(F.col("pr") / (er * F.col("qr"))))
        level = settle(level.select("gram", "pa", "pr", "value"))
        levels.append(level.select("gram", "value"))
    escapes = contexts.where("context <> ''").select(
        F.col("context").alias("gram"), F.log((F.col("cr") + MASS) / (F.col("ca") + MASS)).alias("value"))
    table = escapes
    for one in levels:
        table = table.unionByName(one)
    return settle(table.groupBy("gram").agg(F.sum("value").alias("value"))), base


def score_urls(urls: DataFrame, table: DataFrame, base: float) -> DataFrame:
    """url, score: the log ratio of a URL by character, over (url). Copies of a URL count alike above and below the fraction line."""
    starts = [START * k for k in range(1, ORDER + 1)]
    first = float(table.where(F.col("gram").isin(starts)).agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0])
    found = url_grams(urls.where("url <> ''"), "url").join(small_side(table), "gram").groupBy("url").agg(F.sum("value").alias("sum"))
    times = urls.where("url <> ''").groupBy("url").agg(F.count(F.lit(1)).alias("times"))
    size = F.length("url") + 1
    return times.join(found, "url", "left").select(
        "url", F.round((F.coalesce("sum", F.lit(0.0)) / F.col("times") + F.lit(first)) / size + F.lit(base), 9).alias("score"))


def filter_urls(pages: DataFrame, rules=RULES, tail: float = 0.05) -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold for each row of (page_id, url).

    The longest rule that fits decides; other URLs are allowed if their score, the log ratio of the model of allowed URLs to that
    of blocked ones by character, reaches the threshold. The threshold is calibrated on the URLs rules decide: midway between the
    `tail` quantile of the allowed ones' scores and the 1 - `tail` quantile of the blocked ones'. Without URLs of both kinds every
    other URL is allowed and the threshold is null. A null or empty url has score 0; null and malformed ones have an empty host and path. Repeated rows
    and null ids give rows like any other, long URLs are scored whole. Other columns are not read. An empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = settle(rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)))
    labelled = rows.where("fit IS NOT NULL").select("url", (F.col("fit.verdict") == "allow").alias("accepted"))
    table, base = ratio_table(labelled)
    scores = settle(score_urls(rows.select("url"), table, base))
    rows = rows.join(small_side(scores), "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    ends = rows.where("fit IS NOT NULL").agg(
        F.percentile_approx(F.when(F.col("fit.verdict") == "allow", F.col("score")), tail, 10_000).alias("low"),
        F.percentile_approx(F.when(F.col("fit.verdict") == "block", F.col("score")), 1 - tail, 10_000).alias("high")).first()
    known = ends["low"] is not None and ends["high"] is not None
    threshold = F.lit((ends["low"] + ends["high"]) / 2 if known else None).cast("double")
    method = F.when(F.coalesce(F.col("score") < threshold, F.lit(False)), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                       F.coalesce("fit.verdict", method).alias("verdict"), "score", threshold.alias("threshold"))
