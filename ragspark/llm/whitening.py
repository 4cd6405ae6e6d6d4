"""Whitening of vectors: centred, turned onto the leading components of their covariance, and scaled to unit variance.

Four passes over the vectors. The first sums the integer vectors exactly. The second centres every vector by the exact mean and adds up
its products; a row of the covariance per task and dimension is shuffled, not a row per vector. One task per vector length
turns the covariance into components (`eigen`); they are sent to all tasks, a table of dimensions x components that does not grow with the
rows. The third pass measures the covariance of the whitened vectors, the fourth returns them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.eigen import EPS, leading_pairs

REACH = 1 << 62  # integers stay within it, so that differences fit 64 bits
PART_CELLS = 8_000_000  # cells of all covariances a task holds at once; a single longer vector may need more

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _integers(batches: Iterator[pa.RecordBatch], scale: int, shift: int, widths=None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, row numbers, integer vectors) of the usable vectors of each batch; the last column holds the vectors."""
    for rows in batches:
        column = rows.column(rows.num_columns - 1)
        sizes = np.asarray(column.value_lengths())
        for width in np.unique(sizes).tolist():
            if width == 0 or (widths is not None and width not in widths):
                continue
            mine = sizes == width
            values = column.filter(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            usable = np.isfinite(values).all(axis=1)  # a null entry is NaN here
            scaled = np.floor(np.clip(values[usable] * scale, -float(REACH), float(REACH)))
            yield width, np.flatnonzero(mine)[usable], np.clip(scaled.astype(np.int64), shift - REACH, REACH - shift) + shift


def _sums(scale: int, shift: int):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for width, at, x in _integers(batches, scale, shift):
            held = found.setdefault(width, [0, np.zeros(width, dtype=object)])
            held[0] += len(at)
            held[1] += (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        for width, (n, s) in found.items():
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(width, width), pa.int32()), pa.array(np.arange(width), pa.int32()), pa.array(np.full(width, n), pa.int64()),
                     pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))], names=["width", "at", "n", "s"])

    return summed


def _centred(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S / n in doubles, S = n * whole + rest: the difference of integers is exact before it is rounded."""
    return (x - whole).astype(np.float64) - rest.astype(np.float64) / n


def _products(model, scale: int, shift: int):
    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means = model.value
        found: dict[int, np.ndarray] = {}
        for width, _, x in _integers(batches, scale, shift, means):
            c = _centred(x, *means[width])
            found[width] = found.get(width, 0) + c.T @ c
        for width, cells in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(width, width), pa.int32()), pa.array(np.arange(width), pa.int32()), pa.array([r.tobytes() for r in cells], pa.binary())],
                names=["width", "at", "cells"])

    return multiplied


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(r) for r in rows["cells"]], axis=0)
    return pd.DataFrame({"width": rows["width"].iloc[:1], "at": rows["at"].iloc[:1], "cells": [total.tobytes()]})


def _fit(counts, components: int):
    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        width = int(rows["width"].iloc[0])
        rows = rows.sort_values("at")
        covariance = np.vstack([np.frombuffer(r) for r in rows["cells"]]) / counts.value[width][0]
        covariance = (covariance + covariance.T) / 2
        values, basis = leading_pairs(covariance, components)
        return pd.DataFrame({"width": [width], "trace": [float(np.trace(covariance))], "values": [values.tobytes()], "basis": [basis.tobytes()]})

    return fitted


class Fit:
    """What a vector length's whitening needs: mean, components, their variances and the measured error."""

    def __init__(self, width: int, n: int, whole: np.ndarray, rest: np.ndarray, trace: float, values: bytes, basis: bytes):
        self.n, self.whole, self.rest = n, whole, rest
        variances = np.frombuffer(values)
        self.basis = np.frombuffer(basis).reshape(width, len(variances))
        self.real = variances > 8 * width * EPS * max(float(variances.max(initial=0)), 0.0)  # others hold rounding only
        self.root = np.sqrt(np.where(self.real, variances, 1.0))
        self.explained = np.clip(variances, 0, None) / trace if trace > 0 else np.full(len(variances), np.nan)
        self.error = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.whole, self.rest) @ self.basis / self.root

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2, exact; null where it does not fit 64 bits."""
        near = (_centred(x, self.n, self.whole, self.rest) ** 2).sum(axis=1) * float(self.n) ** 2
        with np.errstate(over="ignore"):
            low = np.int64(self.n) * (x - self.whole) - self.rest  # exact modulo 2 ** 64, and so is the sum of squares
            exact = (low * low).sum(axis=1).tolist()
        out: list[int | None] = []
        for k, (about, value) in enumerate(zip(near.tolist(), exact, strict=True)):
            if about > 2.0 ** 62:
                wide = [self.n * (int(a) - int(b)) - int(r) for a, b, r in zip(x[k], self.whole, self.rest, strict=True)] if about < 2.0 ** 64 else None
                value = sum(v * v for v in wide) if wide else None
                value = value if value is not None and value < 1 << 63 else None
            out.append(value)
        return out


def _spread(fits, scale: int, shift: int):
    """Count, mean and centred products of the whitened vectors of a task, batches merged pairwise."""
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for width, at, x in _integers(batches, scale, shift, fits.value):
            if len(at):
                y = fits.value[width].whitened(x)
                mean = y.mean(axis=0)
                found[width] = _merged(found.get(width), (len(at), mean, (y - mean).T @ (y - mean)))
        for width, (n, mean, cells) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([width], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tobytes()], pa.binary()), pa.array([cells.tobytes()], pa.binary())],
                names=["width", "n", "mean", "cells"])

    return measured


def _merged(one, two):
    if one is None:
        return two
    n = one[0] + two[0]
    gap = two[1] - one[1]
    return n, one[1] + gap * (two[0] / n), one[2] + two[2] + np.outer(gap, gap) * (one[0] * two[0] / n)


def _error(fits):
    def distance(rows: pd.DataFrame) -> pd.DataFrame:
        width = int(rows["width"].iloc[0])
        real = fits.value[width].real
        merged = None
        for r in rows.itertuples(index=False):
            mean = np.frombuffer(r.mean)
            merged = _merged(merged, (r.n, mean, np.frombuffer(r.cells).reshape(len(mean), len(mean))))
        off = (merged[2] / merged[0] - np.eye(len(real)))[np.ix_(real, real)]
        return pd.DataFrame({"width": [width], "error": [float(np.abs(off).max(initial=0))]})

    return distance


def _returned(fits, scale: int, shift: int):
    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for width, at, x in _integers(iter([rows]), scale, shift, fits.value):
                fit = fits.value[width]
                y = fit.whitened(x)
                many, k = y.shape
                yield pa.RecordBatch.from_arrays([
                    rows.column(0).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                    pa.array(np.full(many * k, fit.n)),
                    pa.array(fit.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(many), k))),
                    pa.array(y.ravel(), mask=np.tile(~fit.real, many)),
                    pa.array(np.tile(fit.explained, many), mask=np.isnan(np.tile(fit.explained, many))),
                    pa.array(np.full(many * k, fit.error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return projected


def _parts(widths: list[int]) -> Iterator[list[int]]:
    """The vector lengths in parts whose covariances fit a task together."""
    part: list[int] = []
    for width in sorted(widths):
        if part and sum(w * w for w in part) + width * width > PART_CELLS:
            yield part
            part = []
        part.append(width)
    if part:
        yield part


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries c become floor(scale * c) + shift. Rows whose embedding is null or holds null or non-finite entries are left out; a
    vector without entries has no component, so no row. Vectors of different lengths are whitened apart, each length by its own n vectors;
    lengths shorter than `components` have as many components as dimensions. A repeated vec_id, or none, is a row like any other.
    `explained` is the component's share of the whole variance, null if there is none. A component without variance (more components than
    independent vectors, equal vectors) has a null `whitened` and is left out of `identity_error`. `deviation` is null where it does not
    fit 64 bits; scaled entries beyond 2 ** 62 count as 2 ** 62. Extra columns are not read. An empty table gives an empty result. The
    table is read four times and must give the same rows each time.
    """
    spark = vectors.sparkSession
    send = spark.sparkContext.broadcast
    rows = vectors.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    only = rows.select("v")
    sums = only.mapInArrow(_sums(scale, shift), "width int, at int, n long, s decimal(38,0)").groupBy("width", "at").agg(
        F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("width", "at")
    totals: dict[int, tuple[int, list[int]]] = {}
    for r in sums.toLocalIterator():
        totals.setdefault(r["width"], (r["n"], []))[1].append(int(r["s"]))
    out = []
    for part in _parts(list(totals)):
        means = {}
        for width in part:
            n, s = totals[width]
            means[width] = (n, np.array([v // n for v in s], dtype=np.int64), np.array([v % n for v in s], dtype=np.int64))
        model = send(means)
        cells = only.mapInArrow(_products(model, scale, shift), "width int, at int, cells binary")
        cells = cells.groupBy("width", "at").applyInPandas(_added, "width int, at int, cells binary")
        found = cells.groupBy("width").applyInPandas(_fit(model, components), "width int, trace double, values binary, basis binary").collect()
        fits = {r["width"]: Fit(r["width"], *means[r["width"]], r["trace"], bytes(r["values"]), bytes(r["basis"])) for r in found}
        sent = send(fits)
        errors = only.mapInArrow(_spread(sent, scale, shift), "width int, n long, mean binary, cells binary").groupBy("width").applyInPandas(
            _error(sent), "width int, error double")
        for r in errors.collect():
            fits[r["width"]].error = r["error"]
        out.append(rows.mapInArrow(_returned(send(fits), scale, shift), OUT))
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], OUT)
