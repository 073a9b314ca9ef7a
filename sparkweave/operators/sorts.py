"""Sorting with an explicit order of nulls, limits, and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key(name: str, descending: bool = False, nulls_first: bool | None = None) -> Column:
    """A sort key; unless told, nulls sort as the largest values."""
    first = descending if nulls_first is None else nulls_first
    column = F.col(name)
    if descending:
        return column.desc_nulls_first() if first else column.desc_nulls_last()
    return column.asc_nulls_first() if first else column.asc_nulls_last()


def top(df: DataFrame, n: int, *keys: Column, offset: int = 0) -> DataFrame:
    """The rows offset to offset + n of the order; each partition keeps its own best rows only."""
    ordered = df.orderBy(*keys)
    return (ordered.offset(offset) if offset else ordered).limit(n)


def repartition(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """By hash of the columns, or round robin without."""
    return df.repartition(n, *columns)


def gather(df: DataFrame) -> DataFrame:
    """One partition, without a shuffle."""
    return df.coalesce(1)
