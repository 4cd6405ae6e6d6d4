"""Typed records out of model replies that are held in a table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORRUPT = "_corrupt"


def parsed_object(text: Column, fields: str) -> Column:
    """The JSON object in `text` as a struct of `fields` (a DDL list); null unless it is one whole object."""
    parsed = F.from_json(text, f"{fields}, {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT})
    whole = F.try_parse_json(text).isNotNull() & text.rlike(r"(?s)^\s*\{.*\}\s*$")
    return F.when(whole & parsed[CORRUPT].isNull(), parsed)


def with_defaults(record: Column, defaults: dict[str, Column]) -> Column:
    """The record with a default for every absent field; null stays null, for the caller's fallback."""
    return F.when(
        record.isNotNull(),
        F.struct(*[F.coalesce(record[name], value).alias(name) for name, value in defaults.items()]),
    )
