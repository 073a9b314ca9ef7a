"""Window operators that Spark has no syntax for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, name: str, aggregate: Column, order_by: Sequence[Column | str], before: int, after: int, partition_by: Sequence[str] = ()) -> DataFrame:
    """df with an aggregate over a GROUPS frame: the peer groups from `before` preceding to `after` following.

    A peer group's number is its dense rank, over which the frame is a RANGE.
    """
    rank = f"{name}__rank"
    ranked = df.withColumn(rank, F.dense_rank().over(Window.partitionBy(*partition_by).orderBy(*order_by)))
    frame = Window.partitionBy(*partition_by).orderBy(rank).rangeBetween(-before, after)
    return ranked.withColumn(name, aggregate.over(frame)).drop(rank)


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """The rows for which a condition over window functions holds."""
    return df.withColumn("__kept", condition).where("__kept").drop("__kept")


def distinct_on(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    return qualify(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)) == 1)


def top_per_group(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each key; Spark limits the groups before it shuffles them."""
    return qualify(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)) <= k)
