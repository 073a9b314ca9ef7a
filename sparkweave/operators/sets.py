"""Set operations by column name or position, and unnesting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine(left: DataFrame, right: DataFrame, kind: str, keep_all: bool = False) -> DataFrame:
    """union, intersect or except, of distinct rows or of all."""
    match kind, keep_all:
        case "union", True:
            return left.unionAll(right)
        case "union", False:
            return left.union(right).distinct()
        case "intersect", True:
            return left.intersectAll(right)
        case "intersect", False:
            return left.intersect(right)
        case "except", True:
            return left.exceptAll(right)
        case "except", False:
            return left.subtract(right)
    raise ValueError(f"no such operation: {kind}")


def unnest(df: DataFrame, columns: Sequence[str], preserve_nulls: bool = True) -> DataFrame:
    """A row for each position of the list columns, the shorter ones filled with nulls; struct columns become their fields.

    preserve_nulls: a row whose lists are all null or empty stays, with nulls.
    """
    kinds = dict(df.dtypes)
    lists, structs = [k for k in columns if kinds[k].startswith("array")], [k for k in columns if kinds[k].startswith("struct")]
    rest = [k for k in df.columns if k not in columns]
    out = df
    if lists:
        zipped = F.arrays_zip(*[F.coalesce(F.col(k), F.array().cast(kinds[k])).alias(k) for k in lists])
        made = F.explode_outer(zipped) if preserve_nulls else F.explode(zipped)
        out = out.select(*rest, *structs, made.alias("__each")).select(*rest, *structs, *[F.col("__each")[k].alias(k) for k in lists])
    return out.select(*[k for k in out.columns if k not in structs], *[f"{k}.*" for k in structs])
