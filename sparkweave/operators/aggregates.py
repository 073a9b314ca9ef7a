"""Aggregates in forms that Spark has no syntax for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_agg(value: str, *order_by: str, descending: bool = False) -> Column:
    """array_agg(value ORDER BY ...): pairs are collected, sorted and stripped again."""
    pairs = F.collect_list(F.struct(*order_by, F.col(value).alias("__value")))
    return F.transform(F.sort_array(pairs, not descending), lambda p: p["__value"])


def string_agg(value: str, separator: str, *order_by: str, descending: bool = False) -> Column:
    return F.array_join(F.transform(array_agg(value, *order_by, descending=descending), lambda x: x.cast("string")), separator)


def first_by(value: str, order_by: str) -> Column:
    """first_value(value ORDER BY ...) as an aggregate, without a sort."""
    return F.min_by(value, order_by)


def last_by(value: str, order_by: str) -> Column:
    return F.max_by(value, order_by)


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], *aggregates: Column) -> DataFrame:
    """GROUP BY GROUPING SETS with one pass over df."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(*aggregates)


def weighted_percentile(value: str, weight: str, p: float) -> Column:
    return F.percentile(value, p, weight)
