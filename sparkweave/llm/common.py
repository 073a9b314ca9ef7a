"""What the corpus operators share: the shared folder, lineage cuts, checked broadcasts, word splitting."""

from __future__ import annotations

import os
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.sources import files
from sparkweave.sources.shared import shared_dir

#: A word, wherever words are counted: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a side that may be broadcast after they have been counted.
BROADCAST_ROWS = 100_000


#: Folders made by this process, until release().
_made: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/sparkweave/{label}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete all that this process has staged; results that read it can be read no longer."""
    while _made:
        files.remove(_made.pop())


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: it is computed once, and a lost executor costs no lineage."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        files.remove(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most that many rows; counts no further than the bound."""
    return df.limit(rows + 1).count() <= rows


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to be small; else as it is, for a shuffled join with adaptive skew handling."""
    return F.broadcast(df) if bounded(df, rows) else df


def n_words(text: Column) -> Column:
    """How many words a text has, 0 for null; each becomes one letter, so that no list of words is built of a very long text."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, F.lit(WORD), F.lit("x")), " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) fixed by the values of the columns, the same in every run."""
    return ((F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") + 0.5) / float(1 << 53)


def ship(spark: SparkSession, thing) -> Callable:
    """Broadcast an object of bounded size; call what is returned on an executor to get it. Its classes are shipped along."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(sent.value)


def local_path(uri: str) -> str | None:
    """The path of a file:// address or plain path, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


class Store:
    """Binary files in the shared folder, written and read on executors: a mounted path, or what pyarrow.fs can open."""

    def __init__(self, root: str):
        self.local = local_path(root)
        if self.local is None:
            from pyarrow import fs

            self.remote, self.base = fs.FileSystem.from_uri(root)

    def create(self, name: str):
        """A file to write bytes to."""
        if self.local is None:
            return self.remote.open_output_stream(f"{self.base}/{name}")
        os.makedirs(self.local, exist_ok=True)
        return open(f"{self.local}/{name}", "wb")

    def read(self, name: str, start: int = 0, size: int | None = None) -> bytes:
        if self.local is None:
            with self.remote.open_input_file(f"{self.base}/{name}") as file:
                return file.read_at(file.size() - start if size is None else size, start)
        with open(f"{self.local}/{name}", "rb") as file:
            file.seek(start)
            return file.read(-1 if size is None else size)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column has about that many bytes in each; one long text makes a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        group = np.cumsum(sizes) // most_bytes
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z in lower case. bytes.split() and bytes.lower() know ASCII only, as WORD does."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def indexed(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df, staged, with a gapless number from 0 in that order: a range sort, then an offset for each of its partitions."""
    pid, at = f"{name}_p", f"{name}_m"
    rows = stage(df.orderBy(*order).withColumns({pid: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(pid).count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).select(pid, "offset")
    # a row for each partition of the sort
    return rows.join(F.broadcast(offsets), pid).withColumn(name, F.col(at) + F.col("offset")).drop(pid, at, "offset")


def twins(rows: DataFrame, keys: list[str], repeated: DataFrame, name: str, most: int) -> DataFrame:
    """rows with a number from 0 without gaps among the rows of each repeated group, else 0.

    repeated: (keys, n), the groups and how many rows each has. A group is numbered in parts of about `most` rows,
    by salts that follow from where a row is read: the rows of a group are taken to be interchangeable.
    """
    salt, salts, before, nth = (f"{name}_{x}" for x in ("salt", "salts", "before", "nth"))
    joined = rows.join(checked(repeated.select(*keys, F.ceil(F.col("n") / most).alias(salts))), keys, "left")
    many = stage(joined.where(F.col(salts).isNotNull()).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.col(salts))), "salted")
    group, earlier = [*keys, salt], Window.partitionBy(*keys).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = many.groupBy(*group).count().select(*group, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(before))
    numbered = many.withColumn(nth, F.row_number().over(Window.partitionBy(*group).orderBy(F.lit(0)))).join(starts, group)
    out = numbered.withColumn(name, F.col(before) + F.col(nth) - 1).select(*rows.columns, name)
    return out.unionByName(joined.where(F.col(salts).isNull()).select(*rows.columns, F.lit(0).cast("long").alias(name)))
