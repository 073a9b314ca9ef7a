"""Names of engine options and the Spark settings behind them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Option name, after an engine prefix if there is one -> Spark SQL setting; None for options that have no
#: counterpart and change nothing.
OPTIONS: dict[str, str | None] = {
    "execution.target_partitions": "spark.sql.shuffle.partitions",
    "execution.batch_size": "spark.sql.execution.arrow.maxRecordsPerBatch",
    "execution.time_zone": "spark.sql.session.timeZone",
    "execution.parquet.pushdown_filters": "spark.sql.parquet.filterPushdown",
    "execution.parquet.enable_page_index": "spark.sql.parquet.columnIndexFilter",
    "execution.parquet.schema_force_view_types": None,
    "execution.parquet.pruning": "spark.sql.parquet.recordLevelFilter.enabled",
    "execution.parquet.compression": "spark.sql.parquet.compression.codec",
    "execution.coalesce_batches": None,
    "execution.collect_statistics": "spark.sql.statistics.fallBackToHdfs",
    "catalog.information_schema": None,
    "optimizer.enable_round_robin_repartition": None,
    "optimizer.repartition_joins": None,
    "optimizer.repartition_aggregations": None,
    "optimizer.prefer_hash_join": "spark.sql.join.preferSortMergeJoin",
    "optimizer.hash_join_single_partition_threshold": "spark.sql.autoBroadcastJoinThreshold",
}
#: Options whose Spark setting means the opposite.
_INVERTED = {"optimizer.prefer_hash_join"}


def apply(spark: SparkSession, option: str, value: str) -> None:
    """Set an engine option, or a spark.* setting as it is; ValueError for any other name."""
    if option.startswith("spark."):
        spark.conf.set(option, str(value))
        return
    name = option if option in OPTIONS else option.partition(".")[2]
    if name not in OPTIONS:
        raise ValueError(f"unknown option: {option}")
    setting, text = OPTIONS[name], str(value)
    if setting is None:
        return
    if name in _INVERTED:
        text = {"true": "false", "false": "true"}[text.lower()]
    spark.conf.set(setting, text.lower() if text.lower() in ("true", "false") else text)
