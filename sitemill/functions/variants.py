"""Paths into JSON text, by VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """A VARIANT of JSON text; null where it is null or no JSON."""
    return F.try_parse_json(text)


def path(value: Column, where: str, kind: str) -> Column:
    """What lies at ``where`` (``$.a.b[0]``) as ``kind``; null where nothing
    does, or something that can't be that."""
    return F.try_variant_get(value, where, kind)


def is_broken(text: Column, value: Column) -> Column:
    """Whether there is text that is no JSON."""
    return text.isNotNull() & value.isNull()


def total(value: Column, array: str, field: str) -> Column:
    """The sum of a whole-number field over the objects of an array; null where
    there is no array, 0 where it is empty."""
    return F.aggregate(path(value, array, "array<variant>"), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(path(x, f"$.{field}", "bigint"), F.lit(0)))
