"""Token counts kept as delta-maintained rollups with idempotent batch commits.

A batch is a table of signed deltas (docs, tokens) by source, language and tokenizer version: inserts
count up, deletes down, a revised count takes the old one back and adds the new one, under another
version if that changed. Deltas are summed before they are stored, and totals are sums over committed
batches. A batch is committed by the success mark that Spark writes into its folder last, so that a
batch that failed half-way is not seen and is written anew, and one that is sent again changes
nothing. Repeated rows count as often as they come, texts of any length are encoded whole, and an empty
table commits an empty batch. compact() folds the committed batches into one table, which remembers their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.llm.common import new_path, slices
from sparkweave.llm.tokens import Encoder
from sparkweave.sources import files

KEYS = ("source", "lang", "version")
_FIELDS = "source string, lang string, version string, docs long, tokens long"


def counted(docs: DataFrame, tokenizer: str, by_word: bool = True, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """docs without its text column, but with the number of its token ids in place of any column of that name; of a null or empty text 0."""
    columns = [c for c in docs.columns if c not in (text_col, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(tokenizer, by_word)
        for batch in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(encode(batch.column(text_col))[1], pa.int64())], [*columns, name])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in columns), T.StructField(name, T.LongType())]))


def deltas(rows: DataFrame, version: str | Column, tokens: str | Column, sign: int = 1) -> DataFrame:
    """One signed delta for each source, language and version of rows (source, lang); a null count is 0."""
    version = F.lit(version) if isinstance(version, str) else version
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    slim = rows.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), version.alias("version"), F.coalesce(tokens.cast("long"), F.lit(0)).alias("tokens"))
    return slim.groupBy(*KEYS).agg((F.lit(sign) * F.count("*")).cast("long").alias("docs"), (F.lit(sign) * F.sum("tokens")).cast("long").alias("tokens"))


def revised(rows: DataFrame, old_version: str, old_tokens: str | Column, new_version: str, new_tokens: str | Column) -> DataFrame:
    """The deltas of rows whose counts are replaced."""
    return deltas(rows, old_version, old_tokens, -1).unionByName(deltas(rows, new_version, new_tokens))


class Rollup:
    """Totals below one folder; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _committed(self, kind: str) -> list[str]:
        """Names below a folder that have the success mark."""
        return files.marked(f"{self.root}/{kind}")

    def _base(self) -> str | None:
        return f"{self.root}/base/{names[-1]}" if (names := self._committed("base")) else None

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the changes (source, lang, version, docs, tokens) under the name of a batch; False if it was there already."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError(f"not a name of a batch: {batch!r}")
        if files.exists(f"{self.root}/batches/{batch}/_SUCCESS") or self._is_folded(batch):
            return False
        summed = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
        summed.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.root}/batches/{batch}")
        return True

    def _is_folded(self, batch: str) -> bool:
        base = self._base()
        return base is not None and not self.spark.read.schema("batch string").parquet(f"{base}/names").where(F.col("batch") == batch).isEmpty()

    def _folded(self) -> set[str]:
        base = self._base()
        return {r[0] for r in self.spark.read.schema("batch string").parquet(f"{base}/names").collect()} if base else set()

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) of all committed batches; a group whose documents all went is left out."""
        folded, base = self._folded(), self._base()
        paths = [f"{self.root}/batches/{b}" for b in self._committed("batches") if b not in folded]
        paths += [f"{base}/totals"] if base else []
        read = self.spark.read.schema(_FIELDS).parquet(*paths) if paths else self.spark.createDataFrame([], _FIELDS)
        summed = read.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold the committed batches into a new base; totals stay the same, and folded batches stay committed."""
        names = sorted(self._folded() | set(self._committed("batches")))
        at = f"{self.root}/base/{len(self._committed('base')):08d}"
        self.totals().write.mode("overwrite").parquet(f"{at}/totals")
        self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{at}/names")
        files.write(f"{at}/_SUCCESS")
        for name in self._committed("batches"):
            files.remove(f"{self.root}/batches/{name}")


def new(spark: SparkSession) -> Rollup:
    return Rollup(spark, new_path(spark, "rollup"))
