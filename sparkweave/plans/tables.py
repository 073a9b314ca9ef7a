"""The tables below one folder, each read when it is first named."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkweave.sources import files


#: Schemas by application, path and time of change: a file's footer is read once, not once a query.
_SCHEMAS: dict[tuple, StructType] = {}


def _changed(path: str) -> int | None:
    """When a path was last written, in nanoseconds; None where only Spark can open it."""
    try:
        store, at = files.opened(path)
        return store.get_file_info(at).mtime_ns
    except (OSError, ValueError):
        return None


def read(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose schema stays the same until it is written anew."""
    key = (spark.sparkContext.applicationId, path, _changed(path))
    if key in _SCHEMAS:
        return spark.read.schema(_SCHEMAS[key]).parquet(path)
    df = spark.read.parquet(path)
    _SCHEMAS[key] = df.schema
    return df


class Tables:
    """`Tables(spark, folder).orders` is the DataFrame of `folder/orders.parquet`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = read(self.spark, f"{self.folder}/{name}.parquet")
        self.__dict__[name] = df
        return df

    def supply(self, parts: DataFrame | None = None, suppliers: DataFrame | None = None) -> DataFrame:
        """Supply of a part by a supplier, derived from the lines that sold it.

        parts (p_partkey) and suppliers (s_suppkey) restrict the lines before they are grouped and shuffled.
        """
        lines = self.lineitem.select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        if parts is not None:
            lines = lines.join(parts, lines["l_partkey"] == parts["p_partkey"], "left_semi")
        if suppliers is not None:
            lines = lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"], "left_semi")
        grouped = lines.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey"))
        return grouped.agg(F.sum("l_quantity").alias("ps_availqty"), F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("ps_supplycost"))
