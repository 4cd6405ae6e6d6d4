"""Leading eigenpairs of a symmetric matrix.

Householder reflections bring the matrix to tridiagonal form, Sturm counts bisect its leading eigenvalues, inverse iteration gives their
vectors, those of a cluster of close eigenvalues orthogonalised against each other, and the reflections carry the vectors back.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
CLUSTER = 1e-3  # eigenvalues nearer than this share of the norm are orthogonalised together


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of the matrix; the k-th reflector acts on rows k + 1 and up, an empty one is the identity."""
    a = np.array(matrix, dtype=np.float64)
    size = len(a)
    reflectors = []
    for k in range(size - 2):
        column = a[k + 1:, k].copy()
        if not np.any(column[1:]):
            reflectors.append(np.zeros(0))
            continue
        column /= np.abs(column).max()
        length = np.sqrt(column @ column)
        column[0] += length if column[0] >= 0 else -length
        v = column / np.sqrt(column @ column)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1, k] -= 2 * v[0] * (v @ a[k + 1:, k])
        reflectors.append(v)
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), reflectors


def sturm_counts(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of the given values."""
    tiny = EPS * max(float(np.abs(e).max(initial=0)), float(np.abs(d).max(initial=0)), 1e-300) * EPS
    counts = np.zeros(len(at), np.int64)
    q = np.ones(len(at))
    for k in range(len(d)):
        q = d[k] - at - (e[k - 1] ** 2 / q if k else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        counts += q < 0
    return counts


def leading_values(d: np.ndarray, e: np.ndarray, most: int) -> np.ndarray:
    """The `most` largest eigenvalues, falling, each bisected until its interval has no double inside or is below the norm's rounding."""
    size = len(d)
    radius = np.zeros(size)
    radius[:-1] += np.abs(e)
    radius[1:] += np.abs(e)
    norm = max(float((np.abs(d) + radius).max()), 1e-300)
    wanted = size - 1 - np.arange(min(most, size))  # so many eigenvalues are smaller
    low = np.full(len(wanted), float((d - radius).min()) - EPS * norm)
    high = np.full(len(wanted), float((d + radius).max()) + EPS * norm)
    for _ in range(120):
        middle = (low + high) / 2
        below = sturm_counts(d, e, middle) <= wanted
        low, high = np.where(below, middle, low), np.where(below, high, middle)
        if np.all(high - low <= EPS * np.maximum(np.abs(low), EPS * norm)):
            break
    return (low + high) / 2


def _factors(d: np.ndarray, e: np.ndarray, shift: float, tiny: float):
    """Elimination of the shifted tridiagonal matrix with exchanges of neighbouring rows; zero pivots become `tiny`."""
    size = len(d)
    diagonal, upper = (d - shift).tolist(), [*e.tolist(), 0.0]
    second, lower, swapped = [0.0] * size, [0.0] * size, [False] * size
    for k in range(size - 1):
        below, next_diagonal, next_upper = float(e[k]), diagonal[k + 1], upper[k + 1]
        if abs(diagonal[k]) >= abs(below):
            if diagonal[k] == 0:
                diagonal[k] = tiny
            factor = below / diagonal[k]
            diagonal[k + 1] = next_diagonal - factor * upper[k]
        else:
            factor = diagonal[k] / below
            swapped[k] = True
            diagonal[k], old = below, upper[k]
            upper[k], second[k] = next_diagonal, next_upper
            diagonal[k + 1], upper[k + 1] = old - factor * next_diagonal, -factor * next_upper
        lower[k] = factor
    diagonal = [x if abs(x) >= tiny else tiny for x in diagonal]
    return diagonal, upper, second, lower, swapped


def _solved(factors, right: np.ndarray) -> np.ndarray:
    diagonal, upper, second, lower, swapped = factors
    x = right.tolist()
    size = len(x)
    for k in range(size - 1):
        if swapped[k]:
            x[k], x[k + 1] = x[k + 1], x[k] - lower[k] * x[k + 1]
        else:
            x[k + 1] -= lower[k] * x[k]
    for k in range(size - 1, -1, -1):
        if k + 1 < size:
            x[k] -= upper[k] * x[k + 1]
        if k + 2 < size:
            x[k] -= second[k] * x[k + 2]
        x[k] /= diagonal[k]
    return np.array(x)


def inverse_iteration(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors of the tridiagonal matrix, one column for each of the falling eigenvalues."""
    size = len(d)
    norm = max(float(np.abs(d).max()), float(np.abs(e).max(initial=0)), 1e-300)
    draw = np.random.default_rng(1)
    found = np.zeros((size, len(values)))
    cluster, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            cluster = k
        shift = min(float(value), shift - 4 * EPS * norm) if k > cluster else float(value)  # equal values get shifts apart
        factors = _factors(d, e, shift, EPS * norm)
        others = found[:, cluster:k]
        x = draw.uniform(-1, 1, size)
        for _ in range(6):
            x = x / np.abs(x).max()
            x = _solved(factors, x)
            for _ in range(2):
                x = x - others @ (others.T @ x)
            x = x / np.sqrt(x @ x)
        found[:, k] = x
    return found


def leading_pairs(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns, to double precision."""
    size = len(matrix)
    if size == 0 or not np.any(matrix):
        return np.zeros(min(most, size)), np.eye(size)[:, :most]
    scale = float(np.abs(matrix).max())
    d, e, reflectors = tridiagonal(matrix / scale)
    values = leading_values(d, e, most)
    vectors = inverse_iteration(d, e, values)
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        if len(v):
            vectors[k + 1:] -= 2 * np.outer(v, v @ vectors[k + 1:])
    vectors /= np.sqrt((vectors ** 2).sum(axis=0))
    return values * scale, vectors
