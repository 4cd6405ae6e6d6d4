"""Models in tasks: loaded once per task, called on batches of a fixed number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH = 32

Model = Callable[[Sequence[Any]], Sequence[Any]]  # values of rows (tuples, where there are several columns) -> a result each


def _scored(model: Model, rows: list[tuple]) -> list:
    """A result per row. If the batch fails, its rows go one by one, and a row that fails by itself has none."""
    results: list = [None] * len(rows)
    places = [n for n, row in enumerate(rows) if not any(value is None for value in row)]
    given = [rows[n] if len(rows[n]) > 1 else rows[n][0] for n in places]
    if not given:
        return results
    try:
        answers = list(model(given))
    except Exception:  # whatever the model raises
        answers = []
        for one in given:
            try:
                answers.extend(list(model([one]))[:1] or [None])
            except Exception:
                answers.append(None)
    if len(answers) != len(given):
        raise ValueError(f"the model gave {len(answers)} results for {len(given)} rows")
    for n, answer in zip(places, answers, strict=True):
        results[n] = answer
    return results


def batched_model(load: Callable[[], Model], returns: str = "double", batch: int = BATCH) -> Callable[..., Column]:
    """A column function of the model that `load` gives in the task, called with `batch` rows at a time (fewer at the end of the task).

    Batches go on from one Arrow batch to the next, so their size does not depend on Arrow's. A task without rows loads nothing. Rows with a null
    input are not shown to the model and get null; so do rows the model fails on (it raises, or gives None or NaN).
    """
    if batch < 1:
        raise ValueError("a batch has at least one row")

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model, waiting = None, []
        for part in parts:
            columns = part if isinstance(part, tuple) else (part,)
            waiting.extend(zip(*(column.astype(object).where(column.notna(), None) for column in columns), strict=True))
            whole = len(waiting) - len(waiting) % batch
            if whole and model is None:
                model = load()
            results = [r for first in range(0, whole, batch) for r in _scored(model, waiting[first:first + batch])]
            waiting = waiting[whole:]
            if results:
                yield pd.Series(results, dtype=object)
        if waiting:
            yield pd.Series(_scored(model or load(), waiting), dtype=object)

    return F.pandas_udf(run, returns)
