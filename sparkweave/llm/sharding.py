"""Sharding by sampled splitters, with DataFrame operations only.

Rows are ordered by a hash of their text. A size-weighted sample of these keys (a row is drawn with
probability proportional to its size) gives the quantiles that cut the keys into many ranges of nearly
equal bytes; equal texts fall into one range. Overfull ranges, such as that of a text with very many
copies, are subdivided by a hash of the document, and large groups of equal documents by a number within the
group. The pieces, a bounded number of them whatever the input, are dealt to the shards, largest first,
each to the shard with the fewest bytes.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm.common import checked, stage, twins, uniform

#: Ranges for each shard, sampled keys for each range, and rows that are numbered in one task.
RANGES, SAMPLES, NUMBERED, SEED = 64, 32, 200_000, 8
_CELLS = 1 << 12


def _groups(rows: DataFrame, total: int, ranges: int) -> DataFrame:
    """(key, own, bytes, n, w, heavy): of the groups of equal rows those that are sampled (w is not null) or need numbers (heavy)."""
    step = total / (ranges * SAMPLES)
    groups = rows.groupBy("key", "own").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    drawn = F.when(uniform(F.col("own"), F.lit(SEED)) * step < F.col("bytes"), F.greatest(F.col("bytes").cast("double"), F.lit(step)))
    heavy = (F.col("n") > 1) & ((F.col("bytes") > total / ranges) | (F.col("n") > NUMBERED))
    return stage(groups.withColumns({"w": drawn, "heavy": heavy}).where("w is not null or heavy"), "groups")


def _splitters(groups: DataFrame, ranges: int) -> DataFrame:
    """(b): keys up to which a range goes; at most `ranges` of them, from a sample of about SAMPLES for each, of twice that at most."""
    sample = groups.where("w is not null").select("key", "w")
    upto = F.sum("w").over(Window.orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    share = F.sum("w").over(Window.partitionBy())
    return stage(sample.select("key", F.floor(upto / share * ranges).alias("r")).groupBy("r").agg(F.max("key").alias("b")).select("b").distinct(), "splitters")


def _cell(key):
    return (F.shiftright(key, 52) + (_CELLS >> 1)).cast("long")


def _ranged(rows: DataFrame, splitters: DataFrame) -> DataFrame:
    """rows with the number of splitters below their key: those of earlier cells of the key space, and those in its own."""
    spark = rows.sparkSession
    inside = splitters.groupBy(_cell(F.col("b")).alias("c")).agg(F.collect_list("b").alias("bs"))
    cells = spark.range(_CELLS).select(F.col("id").alias("cell")).join(inside, F.col("cell") == F.col("c"), "left")
    before = F.coalesce(F.sum(F.coalesce(F.size("bs"), F.lit(0))).over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("cell", before.alias("before"), F.coalesce("bs", F.array().cast("array<long>")).alias("bs"))
    found = rows.withColumn("cell", _cell(F.col("key"))).join(F.broadcast(cells), "cell")  # as many rows as there are cells
    return found.withColumn("range", (F.col("before") + F.size(F.filter("bs", lambda b: b < F.col("key")))).cast("int")).drop("cell", "before", "bs")


def _keyed(docs: DataFrame, id_col: str, text_col: str, *columns: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(text)
    return docs.select(*columns, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"), F.xxhash64(F.col(id_col), key).alias("own"))


class Plan:
    """Where rows (key, own, size) go: what was counted over all of them, and tables of bounded size that place any of them."""

    def __init__(self, rows: DataFrame, shards: int):
        total, count = rows.agg(F.sum("size"), F.count("*")).first()
        ranges = RANGES * shards
        full = max(total or 0, 1) / ranges
        groups = _groups(rows, max(total or 0, 1), ranges)
        self.heavy, self.splitters = groups.where("heavy"), _splitters(groups, ranges)
        self.fine = max(1, -(-(count or 0) // (2 * ranges * NUMBERED)))
        ranged = stage(self._ranged(rows), "ranged")
        parts = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).select("range", F.when(F.col("bytes") > 2 * full, F.ceil(F.col("bytes") / full)).otherwise(1).cast("int").alias("parts"))
        self.parts = stage(parts, "parts")
        self.pieces = self._pieces(ranged)
        sums = stage(self.pieces.groupBy("range", "part", "fine").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "pieces")
        dealt = stage(_deal(sums.groupBy("range", "part").agg(F.sum("bytes").alias("bytes")), shards), "dealt")
        order = Window.partitionBy("shard").orderBy("range", "part", "fine").rowsBetween(Window.unboundedPreceding, -1)
        self.starts = sums.join(F.broadcast(dealt), ["range", "part"]).withColumn("start", F.coalesce(F.sum("n").over(order), F.lit(0))).select("range", "part", "fine", "shard", "start")

    def _ranged(self, rows: DataFrame) -> DataFrame:
        told = rows.withColumn("twin", F.lit(0).cast("long")) if self.heavy.isEmpty() else twins(rows, ["key", "own"], self.heavy, "twin", NUMBERED)
        return _ranged(told, self.splitters)

    def _pieces(self, ranged: DataFrame) -> DataFrame:
        part = F.pmod(F.pmod("own", "parts") + F.col("twin"), "parts").cast("int")
        fine = F.pmod(F.pmod(F.xxhash64("own"), F.lit(self.fine)) + F.floor(F.col("twin") / F.col("parts")), F.lit(self.fine)).cast("int")
        return ranged.join(F.broadcast(self.parts), "range").withColumns({"part": part, "fine": fine})  # a row for each range

    def placed(self, rows: DataFrame | None = None) -> DataFrame:
        """The rows that were counted, or the same ones with other columns, with shard and slot."""
        pieces = self.pieces if rows is None else self._pieces(self._ranged(rows))
        nth = F.row_number().over(Window.partitionBy("range", "part", "fine").orderBy("key", "own"))
        return pieces.withColumn("nth", nth).join(self.starts, ["range", "part", "fine"]).withColumn("slot", F.col("start") + F.col("nth") - 1)


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row: shards of nearly equal bytes, slots without gaps from 0.

    size is the text's UTF-8 bytes plus one; a null text counts as empty, and a very long one as it is. Equal
    texts share a shard unless their range is overfull. Rows with equal id and text stand together in any order,
    so that reruns agree; ties of keys go by the hash of id and text. An empty table gives an empty one.
    """
    rows = stage(_keyed(docs, id_col, text_col, F.col(id_col).alias("doc_id")), "rows")
    return Plan(rows, shards).placed().select("doc_id", "size", "text_crc32", "shard", "slot")


def place(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the columns shard and slot (in place of any of these names), as shard() gives them: whole rows move once."""
    plan = Plan(stage(_keyed(docs, id_col, text_col), "rows"), shards)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return plan.placed(_keyed(docs, id_col, text_col, F.struct(*kept).alias("row"))).select("row.*", "shard", "slot")


def write(placed: DataFrame, path: str, files: int = 1) -> None:
    """Rows with shard and slot as Parquet: a folder for each shard, up to `files` files in it, each with runs of slots in ascending order."""
    n = placed.groupBy("shard").agg(F.max("slot").alias("last")).withColumnRenamed("shard", "of")  # a row for each shard
    cut = placed.join(F.broadcast(n), F.col("shard") == F.col("of")).withColumn("nth", F.floor(F.col("slot") * files / (F.col("last") + 1)))
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut.repartition(tasks, "shard", "nth").sortWithinPartitions("shard", "slot").drop("of", "last", "nth").write.partitionBy("shard").parquet(path)


def _deal(pieces: DataFrame, shards: int) -> DataFrame:
    """(range, part, shard) of the pieces, of which there are at most three for each range."""
    load, rows = [(0, s) for s in range(shards)], []
    for row in pieces.orderBy(F.desc("bytes"), "range", "part").collect():
        held, s = heapq.heappop(load)
        rows.append(f"({row['range']}, {row['part']}, {s})")
        heapq.heappush(load, (held + row["bytes"], s))
    spark = pieces.sparkSession
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(`range`, part, shard)") if rows else spark.sql("SELECT 0 AS `range`, 0 AS part, 0 AS shard WHERE false")
