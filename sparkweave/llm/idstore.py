"""Token-id shards with a minimal perfect hash index from document keys to payload offsets.

Layout, below one folder: a manifest table (one row a shard, in key order), and per shard
`<name>.ids`, nothing but the ids of its documents in ascending key order as little-endian unsigned
integers (16 bits if the vocabulary fits, else 32), and `<name>.mph`, the index. The index holds a
minimal perfect hash of the distinct keys (levels of bit arrays: a key sits at the first level at
which no other key shares its bit; its slot is that bit's rank), and per slot a fingerprint, the
key's first row and its number of rows; then the rows' offsets, and the keys in row order for scans.
A lookup reads, by range, a block of bits and its rank for each level that it tries (two or three), one
fingerprint and the offsets of its rows: some hundred bytes, whatever the shard's size.
Limasset et al., "Fast and scalable minimal perfect hashing for massive key sets" (2017).

Files are named anew by each task attempt and count only once the manifest names them, so that
retried or speculative tasks do no harm.
"""

from __future__ import annotations

import bisect
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.llm.common import Store, new_path, slices
from sparkweave.llm.tokens import Encoder, with_end

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
MANIFEST = "shard int, name string, width int, n_docs long, n_ids long, nameless long, first_key long, last_key long"


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """SplitMix64 of x: a bijection for each salt."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(salt + 1) * _MIX[0]
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
        return z ^ (z >> np.uint64(31))


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return ((mix(keys, level) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Maps n distinct 64-bit keys to the slots 0 to n - 1, each once; of a strange key it gives some slot or -1."""

    SPREAD = 1.5
    #: Words of bits between two stored ranks.
    BLOCK = 8

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.bases = np.cumsum(sizes) - sizes
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, left = [], [], keys.view(np.uint64)
        while len(left):
            size = -(-max(64, int(len(left) * cls.SPREAD)) // 64) * 64
            at = _place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        packed = np.packbits(np.concatenate(bits) if bits else np.zeros(0, bool), bitorder="little")
        return cls(np.array(sizes, np.int64), packed.view("<u8"))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys, slots = keys.view(np.uint64), np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (base, size) in enumerate(zip(self.bases, self.sizes)):
            at = base + _place(keys[open_], level, int(size))
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            slots[open_[hit]] = self.ranks[at[hit] >> 6] + below
            open_ = open_[~hit]
        return slots


class Index:
    """A shard's index: rows of a key, and where a row's ids are."""

    FINGERPRINT = 1 << 20  # salt

    def __init__(self, hash_: PerfectHash, prints, first, copies, offsets, keys):
        self.hash, self.prints, self.first, self.copies, self.offsets, self.keys = hash_, prints, first, copies, offsets, keys

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> Index:
        """keys: ascending, of the rows that have one, which are the last; counts: ids of each row."""
        distinct, first, copies = np.unique(keys, return_index=True, return_counts=True)
        hash_, order = PerfectHash.build(distinct), np.empty(len(distinct), np.int64)
        order[hash_(distinct)] = np.arange(len(distinct))
        prints = mix(distinct.view(np.uint64), cls.FINGERPRINT).astype(np.uint32)
        nameless = len(counts) - len(keys)
        return cls(hash_, prints[order], (first + nameless)[order].astype(np.int64), copies[order].astype(np.int64), np.concatenate([[0], np.cumsum(counts)]), keys)

    def parts(self) -> list[np.ndarray]:
        own = [self.hash.sizes, self.hash.words, self.hash.ranks[: -1 : self.hash.BLOCK], self.prints, self.first, self.copies, self.offsets, self.keys]
        return [np.array([len(x) for x in own], "<i8"), *(np.ascontiguousarray(x, k) for x, k in zip(own, KINDS))]

    @classmethod
    def load(cls, data: bytes) -> Index:
        at, own = 8 * len(KINDS), []
        for n, kind in zip(np.frombuffer(data, "<i8", len(KINDS)), KINDS):
            own.append(np.frombuffer(data, kind, n, at))
            at += own[-1].nbytes
        return cls(PerfectHash(own[0], own[1]), *own[3:])

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; -1 and 0 where the fingerprint says that it is not here."""
        slots = self.hash(keys)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == mix(keys[known].view(np.uint64), self.FINGERPRINT).astype(np.uint32)
        first, copies = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        first[known], copies[known] = self.first[slots[known]], self.copies[slots[known]]
        return first, copies


#: Of the parts of an index file, after their lengths.
KINDS = ("<i8", "<u8", "<i8", "<u4", "<i8", "<i8", "<i8", "<i8")


class Lookup:
    """Single keys of an index that stays in its file: what a key needs is read by range. read(start, size) gives bytes."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read, lengths = read, np.frombuffer(read(0, 8 * len(KINDS)), "<i8")
        sizes = [n * np.dtype(k).itemsize for n, k in zip(lengths, KINDS)]
        self.starts = 8 * len(KINDS) + np.cumsum(sizes) - sizes
        self.levels, self.n_words = self._values(0, 0, int(lengths[0])), int(lengths[1])
        self.bases = np.cumsum(self.levels) - self.levels

    def _values(self, part: int, first: int, n: int) -> np.ndarray:
        width = np.dtype(KINDS[part]).itemsize
        return np.frombuffer(self.read(int(self.starts[part]) + first * width, n * width), KINDS[part])

    def _slot(self, key: np.ndarray) -> int:
        for level, (base, size) in enumerate(zip(self.bases, self.levels)):
            at = int(base) + int(_place(key, level, int(size))[0])
            first = at // 64 // PerfectHash.BLOCK * PerfectHash.BLOCK
            words = self._values(1, first, min(PerfectHash.BLOCK, self.n_words - first))
            word, bit = int(words[at // 64 - first]), at % 64
            if word >> bit & 1:
                return int(self._values(2, first // PerfectHash.BLOCK, 1)[0]) + int(np.bitwise_count(words[: at // 64 - first]).sum()) + (word & ((1 << bit) - 1)).bit_count()
        return -1

    def offsets(self, key: int) -> np.ndarray:
        """Where the ids of each row of a key start, and where the last ones end; empty if the key is not here."""
        keys = np.array([key], np.int64).view(np.uint64)
        slot = self._slot(keys)
        if slot < 0 or self._values(3, slot, 1)[0] != mix(keys, Index.FINGERPRINT).astype(np.uint32)[0]:
            return np.empty(0, np.int64)
        return self._values(6, int(self._values(4, slot, 1)[0]), int(self._values(5, slot, 1)[0]) + 1)


def write(docs: DataFrame, root: str, tokenizer: str, end_id: int, by_word: bool = True, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode the texts and write the shards below root; returns the manifest, which is written there as well.

    tokenizer: path of a tokenizer file. Documents come in ascending order of their long id, those
    without one first; a null text is empty and has the end id only. Repeated ids keep all their rows.
    An empty table gives an empty manifest. Other columns are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, store = Encoder.of(tokenizer, by_word), Store(root)
        width = 2 if max(encode.vocabulary - 1, end_id) < 1 << 16 else 4
        shard, name, keys, counts, out = TaskContext.get().partitionId(), f"shard-{uuid.uuid4().hex}", [], [], None
        for batch in slices(batches, "text"):
            out = out or store.create(f"{name}.ids")
            ids, of = with_end(*encode(batch.column("text")), end_id)
            out.write(ids.astype(f"<u{width}").tobytes())
            keys.append(np.asarray(batch.column("doc_id").drop_null(), np.int64))
            counts.append(of)
        if out is None:
            return
        out.close()
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        with store.create(f"{name}.mph") as file:
            for part in Index.build(keys, counts).parts():
                file.write(part.tobytes())
        ends = [int(keys[0]), int(keys[-1])] if len(keys) else [None, None]
        row = [shard, name, width, len(counts), int(counts.sum()), len(counts) - len(keys), *ends]
        kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [c.split()[0] for c in MANIFEST.split(", ")])

    dealt = slim.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{root}/manifest")
    return manifest(spark, root)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row a shard; start: ids in all shards before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, each found through the index and read from the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for row in (row for batch in batches for row in batch.to_pylist()):
            index, width = Index.load(store.read(f"{row['name']}.mph")), row["width"]
            first, copies = index.rows(np.ascontiguousarray(index.keys))
            nth = np.arange(len(first)) - np.searchsorted(index.keys, index.keys)
            if (first < 0).any() or (nth >= copies).any():
                raise ValueError(f"{row['name']}: the index does not know its own keys")
            rows, keys = np.concatenate([np.arange(row["nameless"]), first + nth]), [None] * row["nameless"] + index.keys.tolist()
            for a in range(0, len(rows), 1024):
                part, starts, ends = rows[a : a + 1024], index.offsets[rows[a : a + 1024]], index.offsets[rows[a : a + 1024] + 1]
                low = int(starts.min())
                ids = np.frombuffer(store.read(f"{row['name']}.ids", low * width, (int(ends.max()) - low) * width), f"<u{width}").astype("<u4")
                crcs = [zlib.crc32(ids[s - low : e - low]) for s, e in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array(keys[a : a + 1024], pa.int64()), pa.array(starts + row["start"]), pa.array(ends - starts), pa.array(crcs, pa.int64()), pa.array([row["shard"]] * len(part), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    rows = manifest(spark, root)
    return rows.repartition(max(1, rows.count()), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


class Reader:
    """Keyed access for one process: the manifest in memory (a row a shard), and the headers of the indexes used last; a
    key costs the same few reads whatever the number of documents in its shard."""

    #: Headers to keep.
    HELD = 1024

    def __init__(self, spark: SparkSession, root: str):
        self.store, self.rows = Store(root), sorted((r.asDict() for r in manifest(spark, root).collect()), key=lambda r: r["shard"])
        self.named = [r for r in self.rows if r["first_key"] is not None]
        self.lows, self.loaded = [r["first_key"] for r in self.named], {}

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each row with that key; none if there is no such key."""
        out, at = [], bisect.bisect_left(self.lows, key) - 1
        for row in self.named[max(at, 0) :]:
            if row["first_key"] > key:
                break
            if row["last_key"] < key:
                continue
            name, width = row["name"], row["width"]
            index = self.loaded.pop(name, None) or Lookup(partial(self.store.read, f"{name}.mph"))
            self.loaded[name] = index
            if len(self.loaded) > self.HELD:
                self.loaded.pop(next(iter(self.loaded)))
            ends = index.offsets(key).tolist()
            for a, b in zip(ends, ends[1:]):
                out.append(np.frombuffer(self.store.read(f"{name}.ids", a * width, (b - a) * width), f"<u{width}").astype(np.uint32))
        return out


def encode(docs: DataFrame, tokenizer: str, end_id: int, **options) -> tuple[str, DataFrame]:
    """write() to a new folder in the shared one: its address and the manifest."""
    root = new_path(docs.sparkSession, "ids")
    return root, write(docs, root, tokenizer, end_id, **options)
