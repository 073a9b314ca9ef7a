"""Nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

Each table turns a unit vector by three rounds of random signs and a fast Hadamard transform, twice with
other signs, and takes the nearest signed axis of each turn; the two axes together are its bucket, of
which there are more the more rows there are, up to (2 x width)^2. A query looks into the buckets with
the largest sums of coordinates. How many is found on a bounded sample of queries, whose neighbours are
known from an exhaustive scan: as many as reach the wanted recall. Andoni et al., "Practical and Optimal
LSH for Angular Distance" (2015).

Rows travel once, in chunks that are hashed where they arrive; queries travel to every chunk, and only
what shares a bucket with a query is compared. Beyond ROUTED rows, rows travel to the part of the buckets
of each table that holds theirs, and queries to the parts that they probe. What is compared in single
precision is decided by the inner product of the original vectors in double precision. A query that finds
fewer rows than it is due is compared with all rows. Vectors of other lengths than one are hashed by
direction, separately for each shell of similar norms, so that the largest inner products are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.llm.common import checked, ship, stage

TABLES, RECALL, SEED = 8, 0.95, 2
#: Queries that tune the number of buckets to look into (with k neighbours each), and the fewest buckets.
TUNED, LEAST_PROBES = 96, 16
#: Rows, and queries, of one tile at most (nearly: chunks are dealt by hash); rows that are worth a chunk of their own.
CHUNK, WORTH = 65_536, 4_096
#: Rows up to which every query goes to every chunk; beyond, rows and queries are routed by bucket.
ROUTED = 64 * CHUNK


def hadamard(v: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, without scaling; the width is a power of two.

    Up to six of its steps are one product with the transform of 64 points, which is how processors like it.
    """
    n, d = v.shape
    h = min(d, 64)
    small = np.ones((1, 1), v.dtype)
    while len(small) < h:
        small = np.block([[small, small], [small, -small]])
    v = (v.reshape(-1, h) @ small).reshape(n, d)
    while h < d:
        v = v.reshape(n, d // (2 * h), 2, h)
        v = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return v


def rotated(vectors: np.ndarray, turn: int, seed: int = SEED) -> np.ndarray:
    """The pseudo-rotation of that number, of vectors padded to a power of two."""
    n, d = vectors.shape
    width = _width(d)
    v = np.zeros((n, width), vectors.dtype)
    v[:, :d] = vectors
    for s in np.random.default_rng([seed, turn]).choice([-1.0, 1.0], (3, width)).astype(v.dtype):
        v = hadamard(v * s) / np.sqrt(v.dtype.type(width))
    return v


def _width(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


def _signed(v: np.ndarray) -> np.ndarray:
    """The coordinates along the signed axes: axis k is number 2k, its opposite 2k + 1."""
    return np.stack([v, -v], axis=2).reshape(len(v), -1)


@dataclass
class Space:
    """The buckets of the vectors of one length: signed axes of the first and the second turn (1: none), tables, probes,
    and how many neighbouring buckets are routed as one (None: no routing)."""

    first: int
    second: int
    tables: int
    seed: int
    probes: int = 1
    step: int | None = None

    @classmethod
    def of(cls, d: int, rows: int, tables: int, seed: int) -> Space:
        """Two buckets a row, as far as two turns give so many."""
        axes, second = 2 * _width(d), 1
        while second < axes and axes * second < 2 * rows:
            second = max(4, 2 * second)
        space = cls(axes, second, tables, seed)
        return replace(space, step=max(1, space.size * CHUNK // rows)) if rows > ROUTED else space

    @property
    def size(self) -> int:
        return self.first * self.second

    def _turns(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        one = _signed(rotated(unit, 2 * table, self.seed))
        two = _signed(rotated(unit, 2 * table + 1, self.seed)[:, : self.second // 2]) if self.second > 1 else np.zeros((len(unit), 1), unit.dtype)
        return one, two

    def codes(self, unit: np.ndarray, only: int | None = None) -> np.ndarray:
        """The bucket in each table, a row for each table, or for the one asked for."""
        tables = range(self.tables) if only is None else [only]
        out = np.empty((len(tables), len(unit)), np.int32)
        for a in range(0, len(unit), 8192):
            for k, t in enumerate(tables):
                one, two = self._turns(unit[a : a + 8192], t)
                out[k, a : a + 8192] = one.argmax(axis=1) * self.second + two.argmax(axis=1)
        return out

    def near(self, unit: np.ndarray, only: int | None = None) -> np.ndarray:
        """The buckets to look into: table, query, probe. A pair of the i-th and the j-th best axes is among them only if i * j <= probes."""
        tables = range(self.tables) if only is None else [only]
        out = np.empty((len(tables), len(unit), self.probes), np.int32)
        i = np.arange(min(self.first, self.probes))
        each = np.minimum(self.second, self.probes // (i + 1))
        i, j = np.repeat(i, each), np.concatenate([np.arange(n) for n in each])
        for k, t in enumerate(tables):
            one, two = self._turns(unit, t)
            by_one, by_two = np.argsort(-one, axis=1, kind="stable")[:, : i.max() + 1], np.argsort(-two, axis=1, kind="stable")[:, : j.max() + 1]
            sums = np.take_along_axis(one, by_one, 1)[:, i] + np.take_along_axis(two, by_two, 1)[:, j]
            best = np.argpartition(-sums, self.probes - 1, axis=1)[:, : self.probes]
            out[k] = np.take_along_axis(by_one, i[best], 1) * self.second + np.take_along_axis(by_two, j[best], 1)
        return out

    def ranks(self, unit: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How many buckets each of the vectors puts before the nearest of the given ones (a column for each table)."""
        out = np.full(len(unit), self.size)
        for t in range(self.tables):
            one, two = self._turns(unit, t)
            for k in range(len(unit)):
                sums = one[k][:, None] + two[k][None, :]
                out[k] = min(out[k], np.count_nonzero(sums > sums.flat[codes[k, t]]))
        return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _numbers(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c), np.int64) for c in names], axis=1)


def _valid(df: DataFrame, asked: Column, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, asked, d, shell) of the rows whose vector takes part; d: its length; shell: the norm in half powers of two. Single precision stays so."""
    single = isinstance(df.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "float" if single else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            sizes = np.asarray(pc.fill_null(pc.list_value_length(v), 0), np.int64)
            x = np.abs(np.asarray(pc.fill_null(v.flatten(), float("nan")), np.float64))
            row = np.repeat(np.arange(len(sizes)), sizes)
            strange, largest = np.bincount(row, ~np.isfinite(x), len(sizes)), np.zeros(len(sizes))
            np.maximum.at(largest, row, x)
            good = (strange == 0) & (largest > 0) & np.asarray(pc.is_valid(batch.column("id")))
            scaled = np.divide(x, largest[row], out=np.zeros_like(x), where=good[row])
            norm = np.log2(largest, out=np.zeros(len(sizes)), where=good) + np.log2(np.bincount(row, scaled * scaled, len(sizes)), out=np.zeros(len(sizes)), where=good) / 2
            shell = np.floor(2 * norm + 0.5).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), v, batch.column("asked"), pa.array(sizes.astype(np.int32)), pa.array(shell)], ["id", "v", "asked", "d", "shell"]).filter(pa.array(good))

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    return slim.mapInArrow(run, f"id long, v array<{kind}>, asked boolean, d int, shell int")


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of (query row, row, score, id), each pair once and the k best of each query: higher scores, then smaller ids."""
    order = np.lexsort((v, ids, -s, q))
    q, v, s, ids = q[order], v[order], s[order], ids[order]
    once = np.concatenate([[True], (q[1:] != q[:-1]) | (v[1:] != v[:-1])]) if len(q) else np.zeros(0, bool)
    q, v, s, ids = q[once], v[once], s[once], ids[once]
    keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[keep], v[keep], s[keep], ids[keep]


class Tile:
    """Rows that queries are compared with, those of their buckets only if there is a space."""

    def __init__(self, rid: np.ndarray, ids: np.ndarray, v: np.ndarray, space: Space | None, table: int, part: int):
        self.rid, self.ids, self.v, self.space, self.part = rid, ids, v, space, part
        self.scale = float(np.abs(v).max())
        self.rough = (v / self.scale).astype(np.float32)
        # rounding of single-precision sums, with room to spare
        self.slack = 4e-7 * (v.shape[1] + 8) * np.linalg.norm(self.rough, axis=1).max()
        if space is not None:
            self.only = None if space.step is None else table
            codes = space.codes(_unit(v), self.only)
            self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
            counts = np.stack([np.bincount(c, minlength=space.size) for c in codes])
            self.starts = (np.cumsum(counts, axis=1) - counts + np.arange(len(codes))[:, None] * len(v)).astype(np.int64)
            self.counts, self.order = counts, self.order.ravel()
            self.seen = np.zeros(len(v), bool)

    def _candidates(self, unit: np.ndarray) -> Iterator[np.ndarray | None]:
        """The rows that share a bucket with each query, each once; None: all."""
        if self.space is None:
            yield from [None] * len(unit)
            return
        near = self.space.near(unit, self.only)
        table = np.arange(len(near))[:, None, None]
        starts, counts = self.starts[table, near], self.counts[table, near]
        if self.space.step is not None:
            counts = np.where(near // self.space.step == self.part, counts, 0)
        starts, counts = (x.transpose(1, 0, 2).reshape(len(unit), -1) for x in (starts, counts))
        for start, count in zip(starts, counts):
            held = count > 0
            start, count = start[held], count[held]
            ends = np.cumsum(count)
            self.seen[self.order[np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]] = True
            rows = np.flatnonzero(self.seen)
            self.seen[rows] = False
            yield rows

    def __call__(self, rid: np.ndarray, q: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, ...]], int]:
        """The k best rows of each query, its own row left out, and how many were compared: a rough product proposes, a sum in fixed order decides."""
        out, compared = [], 0
        scale = np.abs(q).max(axis=1, keepdims=True)
        rough_q = (q / scale).astype(np.float32)
        for a in range(0, len(q), 256):
            ii, jj = [], []
            for i, rows in enumerate(self._candidates(_unit(q[a : a + 256])), a):
                score = (self.rough if rows is None else self.rough[rows]) @ rough_q[i]
                compared += len(score)
                if len(score) > k + 1:
                    limit = np.partition(score, len(score) - k - 1)[len(score) - k - 1] - self.slack * np.linalg.norm(rough_q[i])
                    at = np.flatnonzero(score >= limit)
                else:
                    at = np.arange(len(score))
                jj.append(at if rows is None else rows[at])
                ii.append(np.full(len(at), i))
            ii, jj = np.concatenate(ii), np.concatenate(jj)
            other = rid[ii] != self.rid[jj]
            ii, jj = ii[other], jj[other]
            for b in range(0, len(ii), 1 << 16):
                i, j = ii[b : b + (1 << 16)], jj[b : b + (1 << 16)]
                exact = (q[i].astype(np.float64) * self.v[j].astype(np.float64)).sum(axis=1)
                out.append(_best(rid[i], self.rid[j], exact, self.ids[j], k))
        return out, compared


SPOT = ("d", "shell", "tab", "part", "i", "j")


def _merge(k: int, spaces: dict[int, Space] | None):
    """On rows of tiles sorted by SPOT and side (0: rows, 1: queries): the k best of each query among all tiles of the task.
    With a row of its own, of query row -1, for the number of comparisons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        of, waiting, tile, held, compared = None, [], None, 0, 0

        def batch_of(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["query", "vec", "score", "vec_id"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _numbers(batch, *SPOT, "side")
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                part, key = batch.slice(a, b - a), tuple(keys[a])
                if key[:-1] != of:
                    of, waiting, tile = key[:-1], [], None
                rid, ids, v = np.asarray(part.column("rid")), np.asarray(part.column("id")), _matrix(part.column("v"))
                if key[-1] == 0:
                    waiting.append((rid, ids, v))
                    continue
                if tile is None and waiting:
                    tile = Tile(*(np.concatenate(x) for x in zip(*waiting)), spaces and spaces[key[0]], key[2], key[3])
                    waiting = []
                if tile is not None:
                    found, n = tile(rid, v, k)
                    kept, held, compared = kept + found, held + sum(len(f[0]) for f in found), compared + n
            if held > 2_000_000:
                kept = [_best(*(np.concatenate(x) for x in zip(*kept)), k)]
                held = len(kept[0][0])
                if held > 1_000_000:
                    yield batch_of(kept)
                    kept, held = [], 0
        if kept:
            yield batch_of([_best(*(np.concatenate(x) for x in zip(*kept)), k)])
        yield batch_of([(np.array([-1]), np.array([compared]), np.array([0.0]), np.array([0]))])

    return run


def _nearest(tiled: DataFrame, k: int, spaces: dict[int, Space] | None) -> DataFrame:
    """(query, vec, score, vec_id) from rows (side 0) and queries (side 1) of parts with qs by vs tiles; and a row for each task, see _merge()."""
    chunk = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
    mine, others = F.when(F.col("side") == 1, chunk("qs")).otherwise(chunk("vs")), F.when(F.col("side") == 1, F.col("vs")).otherwise(F.col("qs"))
    tiled = tiled.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    i, j = F.when(F.col("side") == 1, F.col("mine")).otherwise(F.col("other")), F.when(F.col("side") == 1, F.col("other")).otherwise(F.col("mine"))
    dealt = tiled.select("d", "shell", "tab", "part", i.alias("i"), j.alias("j"), "side", "rid", "id", "v")
    tasks = int(tiled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, *SPOT).sortWithinPartitions(*SPOT, "side").mapInArrow(_merge(k, spaces), "query long, vec long, score double, vec_id long")


def _ranked(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, query_id, rank, vec_id, score): the k best of what the tiles found."""
    pairs = found.where("query >= 0").repartition("query").groupBy("query", "vec").agg(F.max("score").alias("score"), F.first("vec_id").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "vec"))
    best = pairs.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(queries.select(F.col("rid").alias("query"), F.col("id").alias("query_id")), "query").select("query", "query_id", "rank", "vec_id", "score")


def _tuned(rows: DataFrame, spaces: dict[int, Space], k: int, recall: float) -> dict[int, Space]:
    """The spaces with as many probes as find that part of the neighbours of at most TUNED queries, which are compared with all rows."""
    spark = rows.sparkSession
    sample = rows.where("asked").orderBy(F.xxhash64("id", "v"), "rid").limit(TUNED).select("rid", "d", "v").collect()
    of = {d: ([r["rid"] for r in sample if r["d"] == d], np.array([r["v"] for r in sample if r["d"] == d])) for d in {r["d"] for r in sample}}
    get = ship(spark, (of, spaces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, spaces = get()
        best = {d: (np.full((len(q), 0), -np.inf), np.zeros((len(q), 0, d))) for d, (_, q) in of.items()}
        for whole in batches:
            for d, (own, q) in of.items():
                batch = whole.filter(pc.equal(whole.column("d"), pa.scalar(d, pa.int32())))
                for a in range(0, batch.num_rows, 4096):
                    part = batch.slice(a, 4096)
                    v = _matrix(part.column("v")).astype(np.float64)
                    new = q @ v.T
                    new[np.array(own)[:, None] == np.asarray(part.column("rid"))[None, :]] = -np.inf
                    at = np.argpartition(-new, min(k, len(v)) - 1, axis=1)[:, :k]
                    scores, vectors = best[d]
                    scores = np.concatenate([scores, np.take_along_axis(new, at, 1)], axis=1)
                    vectors = np.concatenate([vectors, v[at]], axis=1)
                    at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    best[d] = np.take_along_axis(scores, at, 1), np.take_along_axis(vectors, at[:, :, None], 1)
        for d, (scores, vectors) in best.items():
            n, m = np.nonzero(scores > -np.inf)
            codes = spaces[d].codes(_unit(vectors[n, m])).T if len(n) else np.empty((0, spaces[d].tables), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), d, np.int32)), pa.array(n.astype(np.int32)), pa.array(scores[n, m]), pa.array(list(codes), pa.list_(pa.int32()))], ["d", "n", "score", "codes"])

    each = rows.select("rid", "d", "v").mapInArrow(run, "d int, n int, score double, codes array<int>") if of else None
    out = dict(spaces)
    for d, space in spaces.items():
        out[d] = replace(space, probes=min(space.size, max(LEAST_PROBES, space.size // 16)))
    if each is None:
        return out
    rank = F.row_number().over(Window.partitionBy("d", "n").orderBy(F.desc("score"), "codes"))
    # at most TUNED * k rows
    found = each.withColumn("rank", rank).where(F.col("rank") <= k).select("d", "n", "codes").collect()
    for d in {r["d"] for r in found}:
        mine = [r for r in found if r["d"] == d]
        ranks = spaces[d].ranks(_unit(of[d][1][[r["n"] for r in mine]]), np.array([r["codes"] for r in mine]))
        out[d] = replace(spaces[d], probes=min(spaces[d].size, max(LEAST_PROBES, int(np.quantile(ranks, recall, method="higher")) + 1)))
    return out


def _routed(rows: DataFrame, spaces: dict[int, Space], side: int) -> DataFrame:
    """A row of (d, shell, rid, id, v) for each table and part of its buckets that holds the row (side 0) or that the query probes (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for d in np.unique(np.asarray(whole.column("d"))).tolist():
                space, every = spaces[d], whole.filter(pc.equal(whole.column("d"), pa.scalar(d, pa.int32())))
                for a in range(0, every.num_rows, 256):
                    batch = every.slice(a, 256)
                    unit = _unit(_matrix(batch.column("v")))
                    near = space.codes(unit)[:, :, None] if side == 0 else space.near(unit)
                    for t in range(space.tables):
                        parts = np.sort(near[t] // space.step, axis=1)
                        new = np.concatenate([np.ones((len(parts), 1), bool), parts[:, 1:] != parts[:, :-1]], axis=1)
                        n, m = np.nonzero(new)
                        columns = [batch.column(c).take(pa.array(n)) for c in ("d", "shell", "rid", "id", "v")]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(n), t, np.int32)), pa.array(parts[n, m].astype(np.int32))], ["d", "shell", "rid", "id", "v", "tab", "part"])

    kind = rows.schema["v"].dataType.simpleString()
    slim = rows.select("d", "shell", "rid", "id", "v")
    return slim.mapInArrow(run, f"d int, shell int, rid long, id long, v {kind}, tab int, part int").withColumn("side", F.lit(side))


def _local(spark: SparkSession, rows: list[tuple], fields: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, fields))


def search(vectors: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row for which asked holds, the k rows found with the largest inner product, all candidates if fewer.

    The candidates are all other rows with vectors of the query's length. Ties go to the smaller id. Ids,
    and vectors, that are null take no part, nor do vectors that are zero or hold a null or non-finite
    component. Repeated ids and rows each count, as queries and as candidates: only the query's own row is
    none. Empty tables give an empty result. Every row is hashed. recall is what the number of probes is
    tuned to, on a sample.
    """
    return searched(vectors, asked, k, id_col, vector_col, tables, recall, seed)[0]


def searched(vectors: DataFrame, asked: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, recall: float = RECALL, seed: int = SEED) -> tuple[DataFrame, int]:
    """search(), and how many pairs its buckets made it compare."""
    spark = vectors.sparkSession
    rows = stage(_valid(vectors, asked, id_col, vector_col).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    queries = rows.where("asked")
    sizes = rows.groupBy("d", "shell").agg(F.count("*").alias("n"), F.count(F.when(F.col("asked"), 1)).alias("q")).collect()  # a row for each length and shell
    n_of, q_of = ({d: sum(r[c] for r in sizes if r["d"] == d) for d in {r["d"] for r in sizes}} for c in ("n", "q"))
    if not sum(q_of.values()):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), 0
    spaces = _tuned(rows, {d: Space.of(d, n, tables, seed) for d, n in n_of.items()}, k, recall)
    shells = _local(spark, [(r["d"], r["shell"]) for r in sizes], "d int, shell int")
    probing = queries.drop("shell").join(shells, "d")
    here, routed = [d for d in spaces if spaces[d].step is None], [d for d in spaces if spaces[d].step is not None]

    # every query to every chunk
    cores = spark.sparkContext.defaultParallelism
    chunks = lambda n: max(-(-n // CHUNK), min(cores, -(-n // WORTH)))
    own = _local(spark, [(r["d"], r["shell"], -(-q_of[r["d"]] // CHUNK) or 1, chunks(r["n"])) for r in sizes if r["d"] in here], "d int, shell int, qs int, vs int")
    columns = ["d", "shell", "rid", "id", "v", "side"]
    met = rows.withColumn("side", F.lit(0)).select(*columns).unionByName(probing.withColumn("side", F.lit(1)).select(*columns))
    tiled = met.withColumns({"tab": F.lit(0), "part": F.lit(0)}).join(own, ["d", "shell"])
    if routed:
        far, spot = F.col("d").isin(routed), ["d", "shell", "tab", "part"]
        sides = [_routed(x.where(far), spaces, side) for side, x in enumerate((rows, probing))]
        n, q = (x.groupBy(*spot).count().withColumn(name, F.ceil(F.col("count") / CHUNK).cast("int")).drop("count") for x, name in zip(sides, ("vs", "qs")))
        tiled = tiled.unionByName(sides[0].unionByName(sides[1]).join(checked(stage(n.join(q, spot), "parts")), spot))
    found = stage(_nearest(tiled, k, spaces), "found")
    compared = found.where("query < 0").agg(F.sum("vec")).first()[0] or 0
    best = stage(_ranked(found, queries, k), "nearest")

    # queries with fewer than k rows meet all rows, as if these were one bucket
    short = stage(queries.join(best.where(F.col("rank") == k).select(F.col("query").alias("rid")), "rid", "left_anti"), "short")
    left = {r["d"]: r["count"] for r in short.groupBy("d").count().collect()}
    out = ["query_id", "rank", "vec_id", "score"]
    if not left:
        return best.select(*out), compared
    every = rows.where(F.col("d").isin(list(left))).withColumn("side", F.lit(0)).select(*columns).unionByName(short.withColumn("side", F.lit(1)).select(*columns))
    all_of = _local(spark, [(d, -(-n // CHUNK), chunks(n_of[d])) for d, n in left.items()], "d int, qs int, vs int")
    rest = _ranked(_nearest(every.withColumns({"shell": F.lit(0), "tab": F.lit(0), "part": F.lit(0)}).join(all_of, "d"), k, None), queries, k)
    return best.join(short.select(F.col("rid").alias("query")), "query", "left_anti").select(*out).unionByName(rest.select(*out)), compared
