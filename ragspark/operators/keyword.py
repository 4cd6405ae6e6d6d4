"""Keyword retrieval by substring containment."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions.containment import term_hits
from ragspark.functions.ranking import DECIMALS, top_k
from ragspark.functions.sizing import broadcast_if_small, fits, settled
from ragspark.functions.text import extract_keywords, first_positions, occurrence_count
from ragspark.lexicons import STOPWORDS

# A document keyword named in the question counts twice; matches are scaled by 0.8.
DOC_KEYWORD_WEIGHT = 2
FACTOR = 0.8

PRUNE_ABOVE = 20_000_000  # questions times documents, above which pairs are only made where they can matter
OWN_CLASSES = 16  # documents are told apart by their number of own keywords up to it
TASK_PAIRS = 250_000  # pairs of a question and a document that a task sums points for, at most on average
MAX_TASKS = 20_000
BITS = 63  # words of a question that share a number
PAIR_COST = 32  # counting the words of a given pair costs about as much as so many rows of a word in a text


def query_keywords(queries: DataFrame, text: str = "question", stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    return queries.withColumn("keywords", extract_keywords(F.col(text), stopwords))


def _sides(queries: DataFrame, docs: DataFrame, text: str, content: str, doc_keywords: str | None, stopwords: Sequence[str],
           side: list[str]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Questions (query_id, keywords, needles with their points, named document keywords, n_kw), documents (doc_id, found needles, own)
    and the spellings (needle, own) of the documents' keywords.

    Containment is tested with the lower-cased keyword; the reported keyword keeps its case.
    """
    words = queries.select("query_id", *side, F.lower(text).alias("_q"), extract_keywords(F.col(text), stopwords).alias("kws"))
    lowered = F.transform("kws", lambda w: F.lower(w))
    points = F.transform(F.array_distinct(lowered), lambda n: F.struct(n.alias("needle"), F.size(F.filter(lowered, lambda w: w == n)).cast("long").alias("points")))
    words = words.withColumn("needles", points).withColumn("n_kw", F.size("kws").cast("long"))
    words = words.withColumn("worth", F.map_from_entries("needles"))
    needles = words.select(F.explode("needles.needle").alias("needle")).distinct()
    found = term_hits(docs.select("doc_id", F.lower(content).alias("_c")), "doc_id", "_c", needles, "needle")
    spellings = None
    if doc_keywords:
        own = F.coalesce(F.col(doc_keywords), F.array().cast("array<string>")).alias("own")
        found = found.join(docs.select("doc_id", *side, own), "doc_id")
        spellings = settled(docs.select(F.explode(doc_keywords).alias("own")).distinct().select(F.lower("own").alias("needle"), "own"))
        named = term_hits(words, "query_id", "_q", spellings, "needle").withColumnRenamed("terms", "named")
        words = words.join(named, "query_id")
    else:
        found = found.join(docs.select("doc_id", *side), "doc_id") if side else found
        found = found.withColumn("own", F.array().cast("array<string>"))
        words = words.withColumn("named", F.array().cast("array<string>"))
    return words.drop("_q"), found.select("doc_id", *side, "terms", "own"), spellings


def _similarity(points: Column) -> Column:
    return F.round(F.least(points / F.greatest("n_kw", F.lit(1)) * FACTOR, F.lit(1.0)), DECIMALS)


def _pair_rows(pairs: DataFrame, questions: DataFrame, hits: DataFrame, with_matches: bool) -> DataFrame:
    """match_count, similarity (and matched_keywords) of given (query_id, doc_id) pairs, zeros included."""
    met = hits.join(broadcast_if_small(pairs.select("query_id", "doc_id")), "doc_id").join(broadcast_if_small(questions), "query_id")
    mine = F.filter("own", lambda w: F.array_contains("named", F.lower(w)))
    seen = F.aggregate(F.array_intersect("terms", "needles.needle"), F.lit(0).cast("long"), lambda total, n: total + F.element_at("worth", n))
    rows = met.withColumn("match_count", (seen + DOC_KEYWORD_WEIGHT * F.size(mine)).cast("long")).withColumn("similarity", _similarity(F.col("match_count")))
    kept = ["query_id", "doc_id", "match_count", "similarity"]
    if with_matches:
        spoken = F.filter("kws", lambda w: F.array_contains("terms", F.lower(w)))
        rows = rows.withColumn("matched_keywords", F.array_sort(F.array_distinct(F.concat(spoken, mine))))
        kept.append("matched_keywords")
    return rows.select(*kept)


def _legs(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Per question and class of documents (those with as many own keywords) what may lead from one to the other, and `df`, the documents it leads to.

    leg 0: a word of the question, with `tail`, its points and those of all commoner words; leg 1: a document keyword the question names.
    """
    held = hits.select("own_class", F.explode("terms").alias("needle")).groupBy("own_class", "needle").agg(F.count(F.lit(1)).alias("df"))
    words = questions.select("query_id", F.lit(0).alias("leg"), F.explode("needles").alias("n")).select("query_id", "leg", "n.needle", "n.points").join(held, "needle")
    commoner = Window.partitionBy("query_id", "own_class").orderBy(F.desc("df"), F.desc("needle")).rowsBetween(Window.unboundedPreceding, 0)
    words = words.withColumn("tail", F.sum("points").over(commoner))
    owned = hits.select("own_class", F.explode(_own_needles()).alias("needle")).groupBy("own_class", "needle").agg(F.count(F.lit(1)).alias("df"))
    named = questions.select("query_id", F.lit(1).alias("leg"), F.explode("named").alias("needle")).join(owned, "needle")
    kept = ["query_id", "own_class", "leg", "needle", "df"]
    return settled(words.select(*kept, "tail").unionByName(named.select(*kept, F.lit(None).cast("long").alias("tail"))))


def _own_needles() -> Column:
    return F.array_distinct(F.transform("own", lambda w: F.lower(w)))


def _pairs(legs: DataFrame, questions: DataFrame, hits: DataFrame, side: list[str]) -> DataFrame:
    """Distinct (query_id, doc_id) that share a leg (query_id, own_class, leg, needle): 0 a word of the question in the text, 1 an own keyword."""
    asked = legs.join(questions.select("query_id", *side), "query_id") if side else legs
    in_text = F.transform("terms", lambda t: F.struct(F.lit(0).alias("leg"), t.alias("needle")))
    in_own = F.transform(_own_needles(), lambda w: F.struct(F.lit(1).alias("leg"), w.alias("needle")))
    rows = hits.select("doc_id", "own_class", *side, F.explode(F.concat(in_text, in_own)).alias("m")).select("doc_id", "own_class", *side, "m.leg", "m.needle")
    return settled(rows.join(broadcast_if_small(asked), ["leg", "needle", "own_class", *side]).select("query_id", "doc_id").distinct())


def _reaching(least: DataFrame, legs: DataFrame, questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Legs that every pair with `least` (query_id, least similarity) or more has at least one of.

    A pair needs `need` points. Words whose points sum to less, the commonest ones, cannot reach it alone, so a pair without own keywords
    has one of the others. Own keywords give at most twice their number: for the documents with so many, either the named keywords are
    legs too, or that much less is asked of the words, whichever makes fewer rows.
    """
    need = F.greatest(F.lit(1), F.ceil((F.col("least") - 1e-6) * F.greatest("n_kw", F.lit(1)) / FACTOR - 1e-6)).cast("long")
    asked = questions.join(least, "query_id").select("query_id", need.alias("need"), (F.size("named") > 0).alias("_some"))
    most = hits.groupBy("own_class").agg((DOC_KEYWORD_WEIGHT * F.max(F.size("own"))).alias("_most"))
    rows = legs.join(asked, "query_id").join(F.broadcast(most), "own_class")  # a row per class, at most OWN_CLASSES + 1
    rows = rows.withColumn("need_less", F.col("need") - F.when(F.col("_some"), F.col("_most")).otherwise(0))
    each = Window.partitionBy("query_id", "own_class")
    cost = lambda wanted: F.sum(F.when(wanted, F.col("df")).otherwise(0)).over(each)
    word = F.col("leg") == 0
    by_text = (F.col("need_less") >= 1) & (cost(word & (F.col("tail") >= F.col("need_less"))) <= cost(~word | (F.col("tail") >= F.col("need"))))
    enough = F.when(F.col("by_text"), F.col("need_less")).otherwise(F.col("need"))
    rows = rows.withColumn("by_text", by_text).where((word & (F.col("tail") >= enough)) | (~word & ~F.col("by_text")))
    return settled(rows.select("query_id", "own_class", "leg", "needle", "df"))


def _bounded_search(questions: DataFrame, hits: DataFrame, side: list[str], floor: float | None, k: int | None, with_matches: bool, tasks: int | None) -> DataFrame:
    """Pairs at or above the floor, or the k best, without a row for every pair that shares a word.

    For the k best, the documents of each question's rarest words are counted first; their k-th similarity is the floor.
    With `tasks`, points are summed over all words in so many tasks where the floor leaves so many words that counting each pair costs more.
    """
    hits, questions = settled(hits.withColumn("own_class", F.least(F.size("own"), F.lit(OWN_CLASSES)))), settled(questions)
    legs = _legs(questions, hits)
    least = questions.select("query_id", F.lit(floor if floor is not None else 0.0).alias("least"))
    if k is not None:
        rarest = Window.partitionBy("query_id").orderBy("df", "needle", "own_class").rowsBetween(Window.unboundedPreceding, -1)
        first = legs.where("leg = 0").withColumn("_seen", F.coalesce(F.sum("df").over(rarest), F.lit(0))).where(F.col("_seen") < 4 * k)
        sample = _pairs(first.select("query_id", "own_class", "leg", "needle"), questions, hits, side)
        best = top_k(_pair_rows(sample, questions, hits, False), ["query_id"], [F.desc("similarity"), F.asc("doc_id")], k)
        low = best.groupBy("query_id").agg(F.min("similarity").alias("_low"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k)
        least = least.join(low, "query_id", "left").select("query_id", F.greatest("least", F.coalesce("_low", F.lit(0.0))).alias("least"))
    reach = _reaching(least, legs, questions, hits)
    every, left = (rows.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0] for rows in (legs, reach))
    if tasks and left * PAIR_COST > every:
        return _best(_summed(questions, hits, side, tasks), questions, hits, floor, k, with_matches)
    found = _pair_rows(_pairs(reach.drop("df"), questions, hits, side), questions, hits, False).where("match_count > 0")
    return _best(found.withColumn("retrieval_type", F.lit("keyword")), questions, hits, floor, k, with_matches)


def _best(found: DataFrame, questions: DataFrame, hits: DataFrame, floor: float | None, k: int | None, with_matches: bool) -> DataFrame:
    found = found if floor is None else found.where(F.col("similarity") >= floor)
    found = found if k is None else top_k(found, ["query_id"], [F.desc("similarity"), F.asc("doc_id")], k)
    if not with_matches:
        return found
    found = settled(found)  # keywords are listed for the kept rows only
    listed = _pair_rows(found, questions, hits, True).select("query_id", "doc_id", "matched_keywords")
    return found.join(listed, ["query_id", "doc_id"])


def many_pairs(queries: DataFrame, docs: DataFrame, above: int | None = None) -> bool:
    """Whether questions times documents exceed the bound up to which making all pairs is cheaper than choosing among them."""
    return _count_pairs(queries, docs) > (PRUNE_ABOVE if above is None else above)


def _count_pairs(queries: DataFrame, docs: DataFrame) -> int:
    return queries.count() * docs.count()


def _summed(questions: DataFrame, hits: DataFrame, side: list[str], tasks: int) -> DataFrame:
    """(query_id, doc_id, match_count, similarity, retrieval_type) of every pair that shares a word.

    Texts are placed by doc_id and the points of a pair are summed where its text lies, in `tasks` tasks of bounded numbers of pairs.
    """
    scored = _placed_rows(hits, side, tasks, F.lower).join(broadcast_if_small(_points(questions, side)), ["leg", "needle", *side])
    scored = scored.groupBy("query_id", "doc_id").agg(F.sum("points").alias("match_count")).join(broadcast_if_small(questions.select("query_id", "n_kw")), "query_id")
    return scored.select("query_id", "doc_id", "match_count", _similarity(F.col("match_count")).alias("similarity"), F.lit("keyword").alias("retrieval_type"))


def _points(questions: DataFrame, side: list[str]) -> DataFrame:
    """(query_id, leg, needle, points): 0 a word of the question, 1 a document keyword it names."""
    words = questions.select("query_id", *side, F.lit(0).alias("leg"), F.explode("needles").alias("n")).select("query_id", *side, "leg", "n.needle", "n.points")
    return words.unionByName(questions.select(
        "query_id", *side, F.lit(1).alias("leg"), F.explode("named").alias("needle"), F.lit(DOC_KEYWORD_WEIGHT).cast("long").alias("points")))


def _placed_rows(hits: DataFrame, side: list[str], tasks: int, spelling: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, leg, needle): what each text holds, and its own keywords, in `tasks` tasks."""
    seen = F.transform("terms", lambda t: F.struct(F.lit(0).alias("leg"), t.alias("needle")))
    owned = F.transform("own", lambda w: F.struct(F.lit(1).alias("leg"), spelling(w).alias("needle")))
    return hits.repartition(tasks, "doc_id").select("doc_id", *side, F.explode(F.concat(seen, owned)).alias("m")).select("doc_id", *side, "m.leg", "m.needle")


def _listed(questions: DataFrame, hits: DataFrame, spellings: DataFrame | None, side: list[str], tasks: int) -> DataFrame:
    """The rows of `_summed` with matched_keywords.

    The words of a question are numbered, and what a text holds of them is one bit each in `bit_or`: no strings are collected per pair.
    """
    legs = _points(questions, side)
    if spellings is not None:  # keywords are reported as the document spells them
        legs = legs.where("leg = 0").unionByName(legs.where("leg = 1").join(broadcast_if_small(spellings), "needle").drop("needle").withColumnRenamed("own", "needle"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("leg", "needle")) - 1  # as long as the question
    places = settled(legs.select("query_id", "leg", "needle").distinct().withColumn("at", place))
    numbers = range((places.agg(F.max("at")).first()[0] or 0) // BITS + 1)
    legs = settled(legs.join(places, ["query_id", "leg", "needle"]).withColumn("bit", F.expr(f"shiftleft(1L, at % {BITS})")))
    part = lambda n: F.when(F.floor(F.col("at") / BITS) == n, F.col("bit")).otherwise(F.lit(0).cast("long"))
    masks = [F.bit_or(part(n)).alias(f"_m{n}") for n in numbers]
    asked = questions.withColumn("_row", F.monotonically_increasing_id())
    marked = legs.select("query_id", "leg", "needle", "at", "bit").distinct()
    spoken = asked.select("_row", "query_id", F.explode("kws").alias("word")).withColumn("needle", F.lower("word")).join(marked.where("leg = 0"), ["query_id", "needle"])
    own = asked.select("_row", "query_id").join(marked.where("leg = 1"), "query_id").withColumn("word", F.col("needle"))
    kept = ["_row", "word", "at", "bit"]
    words = spoken.select(*kept).unionByName(own.select(*kept)).groupBy("_row", "word").agg(*masks)
    shown = words.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("word", *[f"_m{n}" for n in numbers]))).alias("_shown"))
    shown = settled(asked.select("_row", "query_id", "n_kw").join(shown, "_row").drop("_row"))
    scored = _placed_rows(hits, side, tasks, lambda w: w).join(broadcast_if_small(legs), ["leg", "needle", *side])
    scored = scored.groupBy("query_id", "doc_id").agg(F.sum("points").alias("match_count"), *masks).join(broadcast_if_small(shown), "query_id")
    held = F.filter("_shown", lambda w: reduce(Column.__or__, [F.col(f"_m{n}").bitwiseAND(w[f"_m{n}"]) != 0 for n in numbers]))
    return scored.select("query_id", "doc_id", "match_count", held["word"].alias("matched_keywords"),
                         _similarity(F.col("match_count")).alias("similarity"), F.lit("keyword").alias("retrieval_type"))


def keyword_search(queries: DataFrame, docs: DataFrame, text: str = "question", content: str = "content",
                   doc_keywords: str | None = "keywords", stopwords: Sequence[str] = STOPWORDS,
                   k: int | None = None, with_matches: bool = True, scope: str | None = None, floor: float | None = None, prune_above: int | None = None) -> DataFrame:
    """(query_id, doc_id, match_count, similarity, retrieval_type[, matched_keywords][, rank]).

    A question keyword found in the lower-cased content counts once per occurrence in the question; a
    keyword of the document found in the lower-cased question counts twice.
    similarity = min(0.8 * matches / max(number of question keywords, 1), 1).

    With `scope`, a column of both inputs, a question only meets documents of its own scope value.

    Each document is scanned once. With `floor` only hits of that similarity, with `k` only the k best per question are made: pairs
    come from words rare enough that no hit can do without all of them (up to `prune_above` questions times documents, from all words, which
    is cheaper there and gives the same; beyond PRUNE_ABOVE, if `prune_above` is not given, whichever is cheaper). Without either, the result is every pair that shares a word.
    """
    side = [scope] if scope else []
    questions, hits, spellings = _sides(queries, docs, text, content, doc_keywords, stopwords, side)
    bounded, pairs = k is not None or floor is not None, _count_pairs(queries, docs)
    tasks = min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS)), MAX_TASKS)
    if bounded and pairs > (PRUNE_ABOVE if prune_above is None else prune_above):
        return _bounded_search(questions, hits, side, floor, k, with_matches, tasks if prune_above is None else None)
    questions = settled(questions)
    if with_matches and not bounded:
        return _listed(questions, hits, spellings, side, tasks)
    return _best(_summed(questions, hits, side, tasks), questions, hits, floor, k, with_matches)


def keyword_pairs(pairs: DataFrame, queries: DataFrame, docs: DataFrame, text: str = "question", content: str = "content",
                  doc_keywords: str | None = "keywords", stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """(query_id, doc_id, match_count, similarity) of given pairs, zeros included; nothing else is counted."""
    wanted = settled(pairs.select("query_id", "doc_id").distinct())
    held = docs.join(broadcast_if_small(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    questions, hits, _ = _sides(queries, held, text, content, doc_keywords, stopwords, [])
    return _pair_rows(wanted, questions, hits, False)


def substring_search(docs: DataFrame, terms: DataFrame, content: str = "content", n: int = 5) -> DataFrame:
    """(term, doc_id, match_count, match_positions) for every document that contains the term.

    Counts include overlapping occurrences; positions are the first n, zero-based, on lower-cased text.
    """
    lowered = docs.select("doc_id", F.lower(content).alias("_c"))
    asked = terms.select("term", F.lower("term").alias("needle"))
    hits = term_hits(lowered, "doc_id", "_c", asked, "needle", keep=True).where(F.size("terms") > 0)
    asked = F.broadcast(asked) if fits(asked) else asked
    return (
        hits.select("doc_id", "_c", F.explode("terms").alias("needle"))
        .join(asked, "needle")
        .select(
            "term",
            "doc_id",
            occurrence_count(F.col("_c"), F.col("needle")).alias("match_count"),
            first_positions(F.col("_c"), F.col("needle"), n).alias("match_positions"),
        )
    )
