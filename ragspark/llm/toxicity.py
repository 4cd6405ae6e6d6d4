"""Toxicity scores by the nearest labelled examples, nearest by the cosine of TF-IDF vectors.

The terms are whole words and word beginnings (three to eight letters, so that the forms of a stem count together) which tell toxic
examples from others; all further words of a text count together as one more dimension, so a text with one such word among many lies far
from a short one full of them. Document frequencies come from all documents. A bounded sample of the labelled rows forms an inverted
index cut into blocks of examples, with the largest weight of every term in every block: the blocks are visited in falling order of the
cosine those weights allow, until no block can change the k nearest. The neighbours vote with a weight that falls with their distance, and a
logistic curve fitted to the votes of each example's own neighbours turns votes into probabilities.
"""

from __future__ import annotations

import math
import re
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.tables import settle

EXAMPLES = 16_384  # labelled rows that vote, the first by a hash of their id
TERMS = 256
CANDIDATES = 4_096  # terms from which TERMS are chosen
BLOCK = 128  # examples to a block of the index
STEMS = range(3, 9)
LONGEST = 32  # letters of a word that may be a term as a whole
HELD = 200_000  # words, and counts, that a task keeps at once

WORD = re.compile(r"[^\W\d_]+")


def grams(word: str) -> list[str]:
    """The terms of a word: its beginnings, and the word itself with a mark of its end."""
    return [word[:n] for n in STEMS if n <= len(word)] + ([word + "$"] if len(word) <= LONGEST else [])


class Lookup:
    """Terms of words, remembered for the words seen last."""

    def __init__(self, known: dict[str, int] | None = None):
        self.known, self.seen = known, {}

    def __call__(self, word: str) -> list:
        found = self.seen.get(word)
        if found is None:
            found = grams(word) if self.known is None else [self.known[g] for g in grams(word) if g in self.known]
            if len(self.seen) >= HELD:
                self.seen.clear()
            if len(word) <= LONGEST:
                self.seen[word] = found
        return found


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, toxic, other: texts of each kind that hold it."""
    lookup = Lookup()
    sums = (Counter(), Counter())

    def flushed() -> pa.RecordBatch:
        names = list(sums[0].keys() | sums[1].keys())
        columns = [pa.array(names, pa.string()), *[pa.array([s[g] for g in names], pa.int64()) for s in (sums[1], sums[0])]]
        for s in sums:
            s.clear()
        return pa.RecordBatch.from_arrays(columns, names=["gram", "toxic", "other"])

    for rows in batches:
        for text, label in zip(rows.column(0), rows.column(1).to_pylist(), strict=True):
            held = set()
            for word in set(words_of(text.as_py())):
                held.update(lookup(word))
            sums[label].update(held)
            if len(sums[0]) + len(sums[1]) > 5 * HELD:
                yield flushed()
    yield flushed()


def _held(known: dict[str, int]):
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(known)
        for rows in batches:
            out = [sorted({g for word in set(words_of(t.as_py())) for g in lookup(word)}) for t in rows.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], names=["held"])

    return held


def _surprise(toxic: Column, other: Column, n_toxic: int, n_other: int) -> Column:
    """Twice the log-likelihood ratio of a term's counts against counts in proportion."""
    total = n_toxic + n_other
    parts = []
    for seen, size in ((toxic, n_toxic), (other, n_other)):
        for observed, share in ((seen, toxic + other), (F.lit(size) - seen, F.lit(total) - toxic - other)):
            parts.append(F.when(observed > 0, observed * F.log(observed * total / (share * size))).otherwise(0.0))
    return 2 * sum(parts[1:], parts[0])


def chosen_terms(held: list[list[int]], other: np.ndarray, most: int) -> list[int]:
    """Terms that cover the toxic examples: one after the other the term in most of them, an example counting half as much for every
    term it has already; `other` is taken off, and terms that gain under 2.5 examples, or 0.2 percent of them, are left."""
    texts = [np.array(h, dtype=np.int64) for h in held]
    lists: list[list[int]] = [[] for _ in other]
    for n, h in enumerate(held):
        for g in h:
            lists[g].append(n)
    weight = np.ones(len(texts))
    gain = np.array([len(x) for x in lists], dtype=np.float64) - other
    free = np.ones(len(other), dtype=bool)
    found: list[int] = []
    while len(found) < most and free.any():
        best = int(np.argmax(np.where(free, gain, -np.inf)))
        if gain[best] < max(2.5, 0.002 * len(texts)):
            break
        free[best] = False
        found.append(best)
        for n in lists[best]:
            weight[n] /= 2
            gain[texts[n]] -= weight[n]
    return found


def select_terms(texts: DataFrame, most: int) -> list[str]:
    """The terms, from distinct texts with a label."""
    distinct = settle(texts.where("text IS NOT NULL").groupBy("text").agg(F.max("label").alias("label")))
    sizes = {r["label"]: r["n"] for r in distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        return []
    counts = distinct.mapInArrow(_counted, "gram string, toxic long, other long").groupBy("gram").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    telling = (F.col("toxic") >= 3) & (F.col("toxic") * n_other > 3 * F.col("other") * n_toxic)
    surprise = F.round(_surprise(F.col("toxic"), F.col("other"), n_toxic, n_other), 6)
    best = counts.where(telling).withColumn("surprise", surprise).where("surprise >= 15")
    best = best.orderBy(F.desc("surprise"), "gram").limit(CANDIDATES).collect()
    names = [r["gram"] for r in best]
    held = distinct.where("label = 1").select("text").mapInArrow(_held({g: n for n, g in enumerate(names)}), "held array<int>").collect()
    other = np.array([r["other"] * n_toxic / n_other for r in best])
    return [names[n] for n in chosen_terms([r["held"] for r in held], other, most)]


VECTOR = "doc_id long, terms array<int>, times array<int>, words long"


def _vectors(known: dict[str, int]):
    """Of every text the terms it holds, how often, and its number of words."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(known)
        for rows in batches:
            terms, times, words = [], [], []
            for text in rows.column(1):
                found: Counter = Counter()
                many = 0
                for word in words_of(text.as_py()):
                    many += 1
                    hit = lookup(word)
                    if hit:
                        found.update(hit)
                order = sorted(found)
                terms.append(order)
                times.append([found[t] for t in order])
                words.append(many)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32())), pa.array(words, pa.int64())],
                names=["doc_id", "terms", "times", "words"])

    return counted


class Index:
    """Unit vectors of the examples as an inverted index in blocks, with each term's largest weight per block."""

    def __init__(self, idf: np.ndarray, examples: list[tuple[int, int, list[int], list[int], int]], k: int):
        self.idf, self.k = idf, k
        rest = len(idf)
        vectors = [(doc_id, label, *self.unit(terms, times, words)) for doc_id, label, terms, times, words in examples]
        # Examples with the same strongest term stand together, so that few blocks hold a term with much weight.
        strongest = [int(t[np.argmax(np.where(t == rest, -1.0, w))]) if len(t) else rest for _, _, t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda n: (strongest[n], vectors[n][0]))
        self.ids = np.array([vectors[n][0] for n in order], dtype=np.int64)
        self.labels = np.array([vectors[n][1] for n in order], dtype=np.float64)
        self.base = float(self.labels.mean()) if len(order) else 0.0
        self.blocks = -(-len(order) // BLOCK)
        self.largest = np.zeros((rest + 1, self.blocks))
        self.postings: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
        for b in range(self.blocks):
            lists: dict[int, tuple[list, list]] = {}
            for at, n in enumerate(order[b * BLOCK:(b + 1) * BLOCK]):
                for t, w in zip(vectors[n][2].tolist(), vectors[n][3].tolist(), strict=True):
                    mine = lists.setdefault(t, ([], []))
                    mine[0].append(at)
                    mine[1].append(w)
                    self.largest[t, b] = max(self.largest[t, b], w)
            self.postings.append({t: (np.array(a), np.array(w)) for t, (a, w) in lists.items()})
        self.recent: OrderedDict = OrderedDict()
        self.visited = 0

    def unit(self, terms, times, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a text; the last dimension stands for all its words. A text without words has neither."""
        t = np.array([*terms, len(self.idf)], dtype=np.int64)
        w = np.array([*((1 + np.log(np.array(times, dtype=np.float64))) * self.idf[t[:-1]]), 0.5 * math.log1p(words)])
        length = math.sqrt(float(w @ w))
        return (t, w / length) if length > 0 else (t[:0], w[:0])

    def _nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, cosines) of the k nearest examples, ties to the smaller id; cosines are rounded to nine digits."""
        bounds = weights @ self.largest[terms]
        at, cosines = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or (len(at) == k and bounds[b] + 1e-8 < cosines[-1]):
                break
            self.visited += 1
            scores = np.zeros(min(BLOCK, len(self.ids) - b * BLOCK))
            for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                posting = self.postings[b].get(t)
                if posting is not None:
                    scores[posting[0]] += w * posting[1]
            scores = np.round(scores, 9)
            hits = np.flatnonzero(scores > 0)
            at, cosines = np.concatenate([at, b * BLOCK + hits]), np.concatenate([cosines, scores[hits]])
            best = np.lexsort((self.ids[at], -cosines))[:k]
            at, cosines = at[best], cosines[best]
        return at, cosines

    def nearest(self, doc_id, terms, times, words: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples but the document itself. Texts with equal vectors share one search."""
        key = (tuple(terms), tuple(times), words) if len(terms) else (words > 0)
        found = self.recent.get(key)
        if found is None:
            vector = self.unit(terms, times, words)
            found = self._nearest(*vector, self.k + 1) if len(vector[0]) and self.blocks else (np.zeros(0, np.int64), np.zeros(0))
            self.recent[key] = found
            if len(self.recent) > 1000:
                self.recent.popitem(last=False)
        at, cosines = found
        others = self.ids[at] != doc_id if doc_id is not None else np.ones(len(at), dtype=bool)
        return at[others][:self.k], cosines[others][:self.k]

    def vote(self, at: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic neighbours, weighted by nearness, with the share among all examples as one more neighbour."""
        weights = cosines / (1.1 - cosines)
        return float((weights @ self.labels[at] + self.base) / (weights.sum() + 1))


def log_odds(share):
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def logistic_curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Offset and slope of the logistic curve of labels over votes' log-odds; labels are drawn in a little, so that the fit is finite."""
    toxic, other = float(labels.sum()), float(len(labels) - labels.sum())
    target = np.where(labels > 0, (toxic + 1) / (toxic + 2), 1 / (other + 2))
    x = np.column_stack([np.ones(len(votes)), log_odds(votes)])
    fit = np.array([0.0, 1.0])

    def loss(fit):
        z = x @ fit
        return float((np.logaddexp(0, z) - target * z).sum() + 0.5 * 1e-3 * fit @ fit)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * fit)
        size, before = 1.0, loss(fit)
        while size > 1e-6 and loss(fit + size * step) > before:
            size /= 2
        fit = fit + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(fit[0]), max(float(fit[1]), 0.0)


OUT = "doc_id long, score double, predicted int, evidence array<struct<doc_id:long,cosine:double,label:int>>"


def _votes(index):
    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for rows in batches:
            votes = [held.vote(*held.nearest(*r.values())) for r in rows.select(["doc_id", "terms", "times", "words"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), rows.column("label")], names=["vote", "label"])

    return voted


def _scores(index, curve: tuple[float, float], shown: int):
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for rows in batches:
            votes, evidence = [], []
            for r in rows.to_pylist():
                at, cosines = held.nearest(r["doc_id"], r["terms"], r["times"], r["words"])
                votes.append(held.vote(at, cosines))
                evidence.append([{"doc_id": int(held.ids[n]), "cosine": float(c), "label": int(held.labels[n])}
                                 for n, c in zip(at[:shown], cosines[:shown], strict=True)])
            score = 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * log_odds(np.array(votes)), -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(evidence, kind)],
                names=["doc_id", "score", "predicted", "evidence"])

    return scored


def score_toxicity(docs: DataFrame, labels: DataFrame, k: int = 25, examples: int = EXAMPLES, terms: int = TERMS, shown: int = 5) -> DataFrame:
    """doc_id, score, predicted (score >= 0.5) and evidence (the `shown` nearest examples) for every row of `docs`.

    `docs` has doc_id and text, `labels` has doc_id and toxic (1 or 0) of the rows that may be learnt from; at most `examples` of them, the
    first by a hash of the id, choose the terms, vote and fit the curve. A document is never its own neighbour. Rows of `labels` with nulls
    do not count; a doc_id labelled twice is toxic if one label says so; a labelled doc_id with several texts counts with the smallest.
    Null and empty texts, and texts without letters, have no neighbours and get the score of the share of toxic examples; without toxic or without
    other examples, every score is that share, and 0 without any. A repeated doc_id, or none, is a row like any other. Extra columns
    are not read. The index is sent to all tasks: at most `examples` rows of `terms` + 1 numbers.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("label"))
    sample = F.broadcast(settle(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)))
    chosen = select_terms(texts.join(sample, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), terms)
    vectors = settle(texts.mapInArrow(_vectors({g: n for n, g in enumerate(chosen)}), VECTOR))
    counts = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = vectors.count()
    idf = np.full(len(chosen), math.log(total + 1) + 1)
    for r in counts.collect():
        idf[r["term"]] = math.log((total + 1) / (r["n"] + 1)) + 1
    first = F.min(F.struct("terms", "times", "words")).alias("v")
    learnt = settle(vectors.join(sample, "doc_id").groupBy("doc_id", "label").agg(first).select("doc_id", "label", "v.*"))
    rows = [(r["doc_id"], r["label"], r["terms"], r["times"], r["words"]) for r in learnt.collect()]
    index = spark.sparkContext.broadcast(Index(idf, rows, k))
    share = index.value.base
    curve = (float(log_odds(share)) if 0 < share < 1 else (500.0 if share else -500.0), 0.0)
    if 0 < share < 1:
        votes = learnt.mapInArrow(_votes(index), "vote double, label int").collect()
        votes.sort()  # sums of doubles depend on their order
        curve = logistic_curve(np.array([r["vote"] for r in votes]), np.array([float(r["label"]) for r in votes]))
    return vectors.mapInArrow(_scores(index, curve, shown), OUT)
