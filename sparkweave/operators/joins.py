"""Joins by kind, and with a choice of physical strategy."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of joins -> Spark's names.
KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "leftsemi": "left_semi", "leftanti": "left_anti", "cross": "cross"}
#: Bytes, as the rows' values take in memory, up to which broadcast_if_small() broadcasts.
SMALL = 64 << 20


def join(left: DataFrame, right: DataFrame, on: Column | list | str | None, kind: str = "inner") -> DataFrame:
    """Any kind of join. Right semi and right anti are the left ones of the other side; left mark adds the column `mark`."""
    kind = kind.lower().replace("_", "").replace(" ", "").replace("outer", "")
    if kind in ("rightsemi", "rightanti"):
        return join(right, left, on, kind.replace("right", "left"))
    if kind == "leftmark":
        return mark(left, right, on)
    if kind == "cross":
        return left.crossJoin(right)
    return left.join(right, on, KINDS[kind])


def mark(left: DataFrame, right: DataFrame, on: Column | list[tuple[str, str]], name: str = "mark") -> DataFrame:
    """left with a flag that says whether a row of right fits; a row of left stays one row.

    on: pairs of columns that are equal, which is one join with the distinct keys of right; or any condition, for which
    the rows that fit and those that don't are two joins over the same exchanges, without row numbers.
    """
    if isinstance(on, list):
        keys = right.select(*(F.col(r).alias(f"__key{k}") for k, (_, r) in enumerate(on))).distinct().withColumn("__hit", F.lit(True))
        equal = reduce(and_, (left[l] == keys[f"__key{k}"] for k, (l, _) in enumerate(on)))
        return left.join(keys, equal, "left").select(*left.columns, F.col("__hit").isNotNull().alias(name))
    fits, rest = left.join(right, on, "left_semi"), left.join(right, on, "left_anti")
    return fits.withColumn(name, F.lit(True)).unionAll(rest.withColumn(name, F.lit(False)))


def broadcast_if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df with a broadcast hint if its optimized plan is estimated, from the sizes of its files, to have at most that many bytes."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= most else df


def with_strategy(df: DataFrame, strategy: str) -> DataFrame:
    """df with a hint for its join: broadcast (if it is small), shuffle_hash, merge or shuffle_replicate_nl."""
    return broadcast_if_small(df) if strategy == "broadcast" else df.hint(strategy)


def null_safe(left: Column, right: Column) -> Column:
    """Equality that holds for two nulls."""
    return left.eqNullSafe(right)


def salted(left: DataFrame, right: DataFrame, key: str, salts: int = 16, kind: str = "inner") -> DataFrame:
    """An equi join of one column of the same name whose hot keys are spread: left is dealt at random, right is repeated."""
    if kind not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the repeated side must not keep rows of its own")
    dealt = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    repeated = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [key, "__salt"], kind).drop("__salt")
