"""Metadata of any shape as VARIANT, filtered by paths.

Next to the map of scalars (`store.scalarise_metadata`): a VARIANT keeps nested objects, arrays and types, is parsed once when it is stored, and
answers predicates on paths such as `$.author.name` or `$.tags[0]` without being parsed again.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARISONS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
WHOLE = "decimal(38,0)"
KINDS = ((bool, "boolean"), (int, WHOLE), (float, "double"), (str, "string"))


def variant_metadata(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """The metadata column (JSON text, struct, map or array) as VARIANT; null and text that is not JSON become null."""
    kind = df.schema[metadata].dataType
    if isinstance(kind, T.VariantType):
        return df
    value = F.try_parse_json(metadata) if isinstance(kind, T.StringType) else F.to_variant_object(metadata)
    return df.withColumn(metadata, value)


def _kind(value: Any) -> str:
    for python, sql in KINDS:
        if isinstance(value, python):
            return sql
    raise TypeError(f"a path is compared with a bool, int, float or str, not with {type(value).__name__}")


def path_value(metadata: Column, path: str, kind: str) -> Column:
    """The value at the path as the type; null where there is none, or one that cannot be cast."""
    return F.try_variant_get(metadata, path, kind)


def path_predicate(metadata: Column, path: str, comparison: str, value: Any = None) -> Column:
    """True or false, never null. `exists` holds for any value at the path but a JSON null, `in` takes values of one type.

    An int is compared with the number at the path: 2.5 is not 2, and is more than 2. Whatever cannot be cast to the type of the value fits no comparison.
    """
    if comparison == "exists":
        held = F.try_variant_get(metadata, path, "variant")
        return held.isNotNull() & ~F.coalesce(F.is_variant_null(held), F.lit(True))
    if comparison == "in":
        return reduce(operator.or_, [path_predicate(metadata, path, "=", v) for v in value], F.lit(False))
    if comparison not in COMPARISONS:
        raise ValueError(f"unknown comparison {comparison}")
    compare, kind = COMPARISONS[comparison], _kind(value)
    if kind == WHOLE:  # whole numbers at the path are compared exactly, others as doubles
        whole, near = path_value(metadata, path, WHOLE), path_value(metadata, path, "double")
        fits = F.when(whole.cast("double") == near, compare(whole, F.lit(str(value)).try_cast(WHOLE))).otherwise(compare(near, F.lit(float(value))))
    else:
        fits = compare(path_value(metadata, path, kind), F.lit(value))
    return F.coalesce(fits, F.lit(False))


def where_metadata(df: DataFrame, predicates: Iterable[Sequence[Any]], metadata: str = "metadata") -> DataFrame:
    """The rows that fit all predicates (path, comparison[, value])."""
    tests = [path_predicate(F.col(metadata), *predicate) for predicate in predicates]
    return df.where(reduce(operator.and_, tests)) if tests else df
