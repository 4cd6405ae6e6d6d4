"""Containment of terms by character q-grams.

A gram is the piece of at most q characters that begins at a place of a text. Every place begins one, so the last grams are shorter than q.
A term of at most q characters is contained exactly where a gram begins with it. Of a longer term, the rarest grams find candidates; only
their texts are read, to see whether they hold the term.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.sizing import broadcast_if_small, settled, spread

Q = 4
PICKS = 3  # grams of a term that a candidate must hold


def text_grams(text: Column, q: int = Q) -> Column:
    """The distinct grams of a text, in one pass whatever its length. Null for a null text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{q}}}))."), F.lit(1)))


def long_term_grams(terms: DataFrame, q: int = Q) -> DataFrame:
    """(term, gram, n_grams) of the terms of at least q characters; every document with the term holds all of them."""
    full = F.filter(text_grams(F.col("term"), q), lambda g: F.length(g) == q)
    return terms.where(F.length("term") >= q).select("term", full.alias("_g")).select(
        "term", F.size("_g").alias("n_grams"), F.explode("_g").alias("gram"))


def pick_grams(wanted: DataFrame, dictionary: DataFrame, picks: int = PICKS) -> DataFrame:
    """(gram, term, bit, all_bits): the rarest grams of each term of `wanted` (term, gram, n_grams), by `dictionary` (gram, df).

    A term with a gram that no document holds is left out. At most 30 picks.
    """
    if not 1 <= picks <= 30:
        raise ValueError("between 1 and 30 grams of a term can be picked")
    known = broadcast_if_small(wanted).join(dictionary, "gram").groupBy("term", "n_grams").agg(
        F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("_g"))
    rarest = known.where(F.size("_g") == F.col("n_grams")).select("term", F.slice("_g", 1, picks).alias("_g"))
    marked = rarest.select("term", F.size("_g").alias("_n"), F.posexplode("_g").alias("_p", "_s"))
    return marked.select(F.col("_s.gram").alias("gram"), "term", F.expr("shiftleft(1, _p)").alias("bit"), F.expr("shiftleft(1, _n) - 1").alias("all_bits"))


def holders(picked: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """(term, key): rows of `postings` (gram, key) that hold all picked grams of a term."""
    met = postings.join(broadcast_if_small(picked), "gram")
    return met.groupBy("term", key, "all_bits").agg(F.bit_or("bit").alias("_b")).where("_b = all_bits").select("term", key)


def verified(candidates: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key): the candidates whose text holds the term. A text is met once, with all its candidate terms."""
    asked = candidates.groupBy(F.col(key).alias("_key")).agg(F.collect_set("term").alias("_terms"))
    held = texts.join(asked, F.col(key).eqNullSafe(F.col("_key"))).select(
        F.col(key), F.explode(F.filter("_terms", lambda t: F.contains(F.col(text), t))).alias("term"))
    return held.select("term", key).distinct()


def gram_hits(texts: DataFrame, key: str, text: str, terms: DataFrame, q: int = Q) -> DataFrame:
    """(term, key) for `terms` (term; distinct, not empty) of any number, without an index and without the driver.

    Terms shorter than q meet the pieces of their own length; of the others only grams that occur in a term leave the texts.
    """
    terms = settled(terms.select("term"))
    lengths = [r["n"] for r in terms.where(F.length("term") < q).select(F.length("term").alias("n")).distinct().collect()]  # fewer than q
    found = []
    for n in sorted(lengths):
        pieces = texts.select(key, F.explode(text_grams(F.col(text), n)).alias("term"))
        found.append(pieces.join(broadcast_if_small(terms.where(F.length("term") == n)), "term").select("term", key).distinct())
    wanted = settled(long_term_grams(terms, q))
    grams = spread(texts, key).select(key, F.explode(text_grams(F.col(text), q)).alias("gram"))
    postings = settled(grams.join(broadcast_if_small(wanted.select("gram").distinct()), "gram", "left_semi").select("gram", key))
    picked = settled(pick_grams(wanted, postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))))
    found.append(verified(holders(picked, postings, key), texts, key, text))
    return reduce(DataFrame.unionByName, found)
