"""Which of many terms occur, as substrings, in each text.

A bounded term list is broadcast and every text is scanned once with an Aho-Corasick automaton, whatever
the number of terms. A list beyond the bound never reaches the driver: then grams of the terms find candidate
texts, which are read for their candidate terms only (`grams`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions.grams import gram_hits
from ragspark.functions.sizing import fits, spread

try:
    import ahocorasick
except ImportError:  # the JVM path below serves as well, only slower for long lists
    ahocorasick = None

MAX_TERMS = 200_000
MAX_TERM_BYTES = 16 * 1024 * 1024
JVM_TERMS = 48
SCAN_ROWS = 256  # texts that a Python worker holds as strings, with their terms


def term_hits(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term", keep: bool = False) -> DataFrame:
    """(key, terms[, text]): per text the distinct terms it contains. Texts without a hit keep an empty array."""
    wanted = terms.select(F.col(term).alias("term")).where(F.length("term") > 0).distinct()
    rows = texts.select(F.col(key), F.col(text).alias("_text"))
    shown = [F.col("_text").alias(text)] if keep else []
    listed = _bounded_terms(wanted)
    if listed is None:
        found = _gram_join(rows, key, wanted)
        return found.join(texts.select(key, text), key) if keep else found
    if not listed:
        return rows.select(key, F.array().cast("array<string>").alias("terms"), *shown)
    if len(listed) <= JVM_TERMS or ahocorasick is None:
        literal = F.array(*[F.lit(t) for t in listed])
        found = F.filter(literal, lambda t: F.contains(F.col("_text"), t))
        return spread(rows, key).select(key, found.alias("terms"), *shown)
    shared = rows.sparkSession.sparkContext.broadcast(listed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for word in shared.value:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for batch in batches:
            for at in range(0, batch.num_rows, SCAN_ROWS):
                part = batch.slice(at, SCAN_ROWS)
                found = [sorted({w for _, w in automaton.iter(t)}) if t else [] for t in part.column(1).to_pylist()]
                kept = [part.column(1)] if keep else []
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.string())), *kept], names=[key, "terms", text][:2 + keep])

    kept = f", `{text}` string" if keep else ""
    return spread(rows, key).mapInArrow(scan, f"`{key}` {rows.schema[key].dataType.simpleString()}, terms array<string>{kept}")


def _bounded_terms(wanted: DataFrame) -> list[str] | None:
    """The terms, if they stay below the bounds. The list is computed once for the check and the fetch."""
    head = wanted.limit(MAX_TERMS + 1).persist()
    try:
        return sorted(r["term"] for r in head.collect()) if fits(head, MAX_TERMS, MAX_TERM_BYTES) else None
    finally:
        head.unpersist()


def _gram_join(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    hits = gram_hits(rows, key, "_text", wanted).groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_set("term")).alias("terms"))
    return rows.select(key).join(hits, F.col(key).eqNullSafe(F.col("_key")), "left").select(
        key, F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
