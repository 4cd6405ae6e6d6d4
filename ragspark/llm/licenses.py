"""License scan with MinHash bands over overlapping windows, with DataFrame functions only.

Texts and templates are cut into words of ASCII letters and digits in lower case and into shingles of SHINGLE words. The shingles of a
text are read in windows of WINDOW, each half over the next. A band is one MinHash value: the least of the window's
shingle hashes after an exclusive-or with the band's constant. A window that shares a band value with a template retrieves it; `bands_for` gives the
number of bands at which a window that holds the shortest template shares one with probability of at least `sure`, and
overlapping windows make it surer. A retrieved template is verified exactly: the share of its shingles that the text has around the window.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm.tables import settle
from ragspark.llm.wordhash import mix

SHINGLE = 3
WINDOW = 8  # shingles

# Short notices of public licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def bands_for(shortest: int, window: int = WINDOW, sure: float = 0.999) -> int:
    """Bands at which a window shares a value with a template of `shortest` shingles that it holds, with probability `sure`."""
    return math.ceil(math.log(1 - sure) / math.log(1 - shortest / window))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def license_words(text: Column) -> Column:
    """Only the first and the last part of a split can be empty."""
    def inner(parts: Column) -> Column:
        first = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
        last = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
        return F.slice(parts, first, F.greatest(F.lit(0), F.size(parts) - last - first + 1))

    return _let(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), inner)


def shingles(words: Column, length: int = SHINGLE) -> Column:
    """Shingles in order; fewer words are one shingle, no words none."""
    return F.when(F.size(words) == 0, F.array().cast("array<array<string>>")).when(F.size(words) < length, F.array(words)).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(words) - (length - 1)), lambda i: F.slice(words, i, length)))


def shingle_hashes(words: Column, length: int = SHINGLE) -> Column:
    """xxhash64 of each of `shingles`, without making them."""
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(F.size(words) < length, F.array(F.xxhash64(words))).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(words) - (length - 1)), lambda i: F.xxhash64(F.slice(words, i, length))))


def template_table(spark: SparkSession, templates) -> DataFrame:
    """license, shingles (distinct), n_words; templates without a word are left out."""
    rows = spark.createDataFrame(list(templates), "license string, text string").withColumn("words", license_words(F.col("text")))
    return rows.where(F.size("words") > 0).select("license", F.size("words").alias("n_words"), F.array_distinct(shingles(F.col("words"))).alias("wanted"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, containment: float = 0.8, sure: float = 0.999) -> DataFrame:
    """doc_id, license, word_start, containment, for each license of `templates` (pairs of name and text) found in a row of (doc_id, text).

    containment is the largest share of the template's distinct shingles that the text holds in and around one retrieving window, at least
    `containment`; word_start the number of the first word of the first such window. Null, empty and wordless texts hold nothing; a text of fewer
    words than a shingle is one shingle. Texts are read whole. Rows that share a doc_id, or have none, are reported as one document. Of
    templates of one name any may match. The template list is a parameter held by every task. Other columns are not read. Empty tables
    and lists give an empty result.
    """
    spark = docs.sparkSession
    known = settle(template_table(spark, templates).withColumn("hashes", F.transform("wanted", lambda s: F.xxhash64(s))))
    rows = [(r["license"], r["n_words"], r["hashes"]) for r in known.select("license", "n_words", "hashes").collect()]  # the parameter's own rows
    shortest = min((len(r[2]) for r in rows), default=1)
    bands = bands_for(min(shortest, WINDOW - 1), sure=sure)
    constants = mix(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(32)).view(np.int64).tolist() if rows else []
    half = WINDOW // 2
    # The pieces of a template: windows of its own, so that a long template is met piece by piece.
    keys: list[set[int]] = [set() for _ in constants]
    pieces = []
    for name, words, hashes in rows:
        for at in range(0, max(1, len(hashes) - half), half):
            for band, c in enumerate(constants):
                key = min(h ^ c for h in hashes[at:at + WINDOW])
                keys[band].add(key)
                pieces.append((band, key, name, words))
    retrieved = spark.createDataFrame(sorted(set(pieces)), "band int, key long, license string, n_words int")
    nothing = F.array().cast("array<struct<at:int,band:int,key:bigint>>")

    def in_band(blocks: Column, band: int) -> Column:
        """Windows of this band that share a value with a template: (window, band, key)."""
        wanted = F.array(*[F.lit(k).cast("long") for k in sorted(keys[band])])
        c = F.lit(constants[band]).cast("long")
        low = F.transform(blocks, lambda block: F.array_min(F.transform(block, lambda h: h.bitwiseXOR(c))))
        least = _let(low, lambda mins: F.transform(mins, lambda x, i: F.least(x, F.get(mins, i + 1))))

        def met(values: Column) -> Column:
            cells = F.transform(values, lambda x, i: F.struct(i.alias("at"), F.lit(band).alias("band"), x.alias("key")))
            return F.when(F.arrays_overlap(values, wanted), F.filter(cells, lambda w: F.array_contains(wanted, w["key"]))).otherwise(nothing)

        return _let(least, met)

    def windows(words: Column) -> Column:
        def cut(h: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), ((F.size(h) - 1) / half).cast("int")), lambda i: F.slice(h, i * half + 1, half))

        def found(h: Column) -> Column:
            return F.when(F.size(h) > 0, _let(cut(h), lambda blocks: F.concat(nothing, *[in_band(blocks, b) for b in range(len(constants))])))

        return _let(shingle_hashes(words), found)

    # One expression binds each intermediate array once; explode_outer keeps the optimizer from computing it a second time in a filter.
    hits = docs.select("doc_id", "text", _let(license_words(F.col("text")), windows).alias("hits"))
    hits = hits.select("doc_id", "text", F.explode_outer("hits").alias("hit"))
    near = hits.join(F.broadcast(retrieved), (F.col("hit.band") == F.col("band")) & (F.col("hit.key") == F.col("key")))
    near = near.withColumn("held", _let(license_words(F.col("text")), lambda words: shingles(words)))
    low = F.greatest(F.lit(0), F.col("hit.at") * half - F.col("n_words"))
    around = F.slice("held", low + 1, 2 * F.col("n_words") + WINDOW)
    near = near.select("doc_id", "license", (F.col("hit.at") * half).cast("long").alias("word_start"), around.alias("held"))
    found = near.join(F.broadcast(known.select("license", "wanted")), "license").withColumn(
        "containment", F.round(F.size(F.array_intersect("wanted", "held")) / F.size("wanted"), 6))
    return found.where(F.col("containment") >= containment).groupBy("doc_id", "license").agg(
        F.min("word_start").alias("word_start"), F.max("containment").alias("containment"))
