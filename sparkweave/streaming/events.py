"""Event-time operators that read a stream as well as a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def _timed(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """A stream with its watermark, which takes instants; a table's times without zone stay as they are."""
    if not events.isStreaming:
        return events
    source = events.withColumn(time, F.col(time).cast("timestamp"))
    return source.withWatermark(time, late) if late else source


def windowed(events: DataFrame, width: str, *aggregates: Column, slide: str | None = None, keys: tuple[str, ...] = (), time: str = "ts", late: str | None = None) -> DataFrame:
    """Aggregates for each tumbling or sliding window and key. On a stream, rows later than `late` are dropped and windows close then."""
    source = _timed(events, time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = source.groupBy(window.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(events: DataFrame, gap: str, *aggregates: Column, keys: tuple[str, ...] = (), time: str = "ts", late: str | None = None) -> DataFrame:
    """Aggregates for each run of a key's events that no gap interrupts; a session ends a gap after its last event."""
    source = _timed(events, time, late)
    out = source.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), *[c for c in out.columns if c != "w"])


def running(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total): for each batch of a stream and key in it, how many values there were so far, and their sum; the state is the two numbers."""

    def step(of, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [of[0]], "n": [n], "total": [total]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "append", "NoTimeout")


def final(aggregated: DataFrame, path: str) -> DataFrame:
    """The last state of a streaming aggregate once all that is there has been read: each batch replaces the table before it."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    aggregated.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/marks").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return aggregated.sparkSession.read.parquet(f"{path}/out")


def read(spark: SparkSession, folder: str, schema: str | StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream: files that come later are read later."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Start writing a stream to Parquet files, each row once; `once`: what is there now, then stop."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def matched(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_time: str, right_time: str, within: str, late: str) -> DataFrame:
    """An inner join of two streams (or tables) on a key, for rows whose times lie within an interval: a symmetric hash join."""
    if left.isStreaming:
        left, right = left.withWatermark(left_time, late), right.withWatermark(right_time, late)
    near = (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"interval {within}"))
    return left.join(right, (F.col(left_key) == F.col(right_key)) & near)
