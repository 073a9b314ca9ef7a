"""Predicates and scalar expressions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkweave.dialect import similar_pattern


def similar_to(column: Column, pattern: str, escape: str = "\\") -> Column:
    return column.rlike(similar_pattern(pattern, escape))


def is_distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def is_unknown(condition: Column) -> Column:
    return condition.isNull()


def is_true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_not_true(condition: Column) -> Column:
    return ~is_true(condition)


def trunc(x: Column, places: int = 0) -> Column:
    """Toward zero, at a decimal place."""
    unit = F.lit(10.0**places)
    return F.signum(x) * F.floor(F.abs(x) * unit) / unit


def date_bin(width_micros: int, at: Column, origin: str = "1970-01-01 00:00:00") -> Column:
    """The start of the bin of a timestamp without zone, bins being counted from the origin."""
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    start = micros(F.lit(origin))
    steps = F.floor((micros(at) - start) / F.lit(width_micros))
    return F.timestamp_micros(start + steps * width_micros).cast("timestamp_ntz")
