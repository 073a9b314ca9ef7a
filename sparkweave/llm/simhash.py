"""SimHash near-duplicates: a pivot distance table discards pairs, survivors are verified.

Two fingerprints of 64 bits that differ in at most three bits agree in two of five bands at least,
so the pairs of bands (ten keys of about 26 bits) are complete blocks; a crowded block is cut once more
by four bands of its other 38 bits, one of which must agree. Within a block, each
fingerprint has a row of Hamming distances to many reference fingerprints (pivots). By the triangle
inequality, two fingerprints at distance d differ by at most d in every coordinate: a pair whose
largest coordinate difference is over three is discarded, the others are compared bit by bit.

The pivots alone cannot be the index: distances to a random pivot have a standard deviation of four
in 64 bits, so that one coordinate still lets 47 % of all pairs through at radius three.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import checked, slices, stage
from sparkweave.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Widths of the bands, from the lowest bit.
BANDS = (13, 13, 13, 13, 12)
#: Fingerprints from which a block is crowded, and of one cut of it that are compared at once; a larger cut is dealt out as pairs of chunks.
CHUNK, TILE = 2048, 65_536
N_PIVOTS = 16
#: Bytes of a text that are split into words at once.
PIECE = 1 << 18
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number of bytes at a time; a piece ends between two words."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            found = _SPACE.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end].split()
        at = end


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit by bit, the majority of the shingles' XXH64; zero for no words."""
    digest, set_bits, n, carried = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    # encode, lower and split of bytes know ASCII only, as the definition of words does
    for fresh in _pieces(text.encode("utf-8", "surrogatepass").lower()) if text else ():
        words, ends, at = carried + fresh, [], -1
        carried = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
        if len(words) < shingle:
            continue
        whole = b" ".join(words)
        for word in words:
            at += 1 + len(word)
            ends.append(at)
        starts = [0, *[end + 1 for end in ends[: len(words) - shingle]]]
        hashes = [digest(whole[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])]
        bits = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    if not n and carried:
        n, bits = 1, np.array([digest(b" ".join(carried), seed)], "<u8").view(np.uint8)
        set_bits += np.unpackbits(bits, bitorder="little")
    majority = np.packbits(2 * set_bits > max(n, 1), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, text_hash): fp is the fingerprint's 64 bits as a signed long. A null text has no words: fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64)), batch.column("text_hash")], ["doc_id", "fp", "text_hash"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long, text_hash long")


def _pivots() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, N_PIVOTS, np.uint64)


def _close(a: np.ndarray, b: np.ndarray, same: bool, pivots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in a and b of pairs within the radius, a strip of a at a time."""
    table_a = np.bitwise_count(a[:, None] ^ pivots).astype(np.int8)
    table_b = table_a if same else np.bitwise_count(b[:, None] ^ pivots).astype(np.int8)
    strip = max(1, (1 << 21) // max(len(b), 1))
    for k in range(0, len(a), strip):
        near = np.abs(table_a[k : k + strip, None, 0] - table_b[None, :, 0]) <= radius
        i, j = np.nonzero(np.triu(near, k + 1) if same else near)
        for c in range(1, len(pivots)):
            keep = np.abs(table_a[i + k, c] - table_b[j, c]) <= radius
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(a[i + k] ^ b[j]) <= radius
        yield i[keep] + k, j[keep]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Of the pairs, those that connect what was not connected: at most n - 1, and no link between groups is lost."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for left, right in pairs:
        for i, j in zip(left.tolist(), right.tolist()):
            if (x := find(i)) != (y := find(j)):
                root[max(x, y)] = min(x, y)
                kept.append((i, j))
    return kept


def _links(radius: int):
    """On rows (block, key, part, i, j, side, fp) sorted by all of these: links (u, v) that connect each tile's close pairs."""

    def tile(fps: np.ndarray, sides: np.ndarray, same: bool, pivots: np.ndarray) -> np.ndarray:
        if same:
            return np.array([(fps[i], fps[j]) for i, j in _forest(len(fps), _close(fps, fps, True, pivots, radius))], np.uint64).reshape(-1, 2)
        a, b = fps[sides == 0], fps[sides == 1]
        pairs = ((i, j + len(a)) for i, j in _close(a, b, False, pivots, radius))
        both = np.concatenate([a, b])
        return np.array([(both[i], both[j]) for i, j in _forest(len(both), pairs)], np.uint64).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, rest = _pivots(), None

        def over(rows: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
            starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :5] != rows[:-1, :5]).any(axis=1)]))
            ends = np.append(starts[1:], len(rows))
            many = ends - starts > 1
            found = [tile(fps[a:b], rows[a:b, 5], rows[a, 3] == rows[a, 4], pivots) for a, b in zip(starts[many], ends[many])]
            links = np.concatenate([np.empty((0, 2), np.uint64), *found]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(batch.column(c), np.int64) for c in ("block", "key", "part", "i", "j", "side")], axis=1)
            fps = np.asarray(batch.column("fp"), np.int64).view(np.uint64)
            if rest is not None:
                rows, fps = np.concatenate([rest[0], rows]), np.concatenate([rest[1], fps])
            others = np.flatnonzero((rows[:, :5] != rows[-1, :5]).any(axis=1))
            last = others[-1] + 1 if len(others) else 0
            rest = rows[last:], fps[last:]
            if last:
                yield over(rows[:last], fps[:last])
        if rest is not None:
            yield over(*rest)

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): enough links between the distinct fingerprints of column fp to connect all that are within the radius (up to 3)."""
    if radius > 3:
        raise ValueError("five bands serve a radius of up to three")
    at, bands = 0, []
    for width in BANDS:
        bands.append(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    def key_of(n: int, a: int, b: int):
        c, d, e = (bands[k] for k in range(5) if k not in (a, b))
        return F.struct(F.lit(n).alias("block"), (bands[a] * (1 << 13) + bands[b]).alias("key"), ((c * (1 << 13) + d) * (1 << 13) + e).alias("others"))

    keys = F.array(*[key_of(n, a, b) for n, (a, b) in enumerate(combinations(range(5), 2))])
    keyed, spot = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.block", "k.key", "k.others"), ["block", "key"]
    crowded = stage(keyed.groupBy(*spot).count().where(F.col("count") > CHUNK).select(*spot, F.lit(True).alias("crowded")), "blocks")
    columns = ["block", "key", "part", "i", "j", "side", "fp"]
    if crowded.isEmpty():
        dealt = keyed.withColumns({c: F.lit(0) for c in ("part", "i", "j", "side")}).select(*columns)
    else:
        # part 0: the whole block; of crowded ones, each of four bands of ten bits (the last has what is left)
        cut = F.array(*[F.shiftright("others", 10 * n).bitwiseAND(F.lit(1023)) + n * 1024 + 1 for n in range(4)])
        parted = keyed.join(checked(crowded), spot, "left").select("block", "key", F.explode(F.when(F.col("crowded"), cut).otherwise(F.array(F.lit(0).cast("long")))).alias("part"), "fp")
        spot = [*spot, "part"]
        large = parted.where("part > 0").groupBy(*spot).count().where(F.col("count") > TILE)
        large = stage(large.select(*spot, F.ceil(F.col("count") / (TILE // 2)).cast("int").alias("chunks")), "parts")
        one = parted.join(checked(large), spot, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        tiles = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.struct(F.least(F.col("own"), other).alias("i"), F.greatest(F.col("own"), other).alias("j"), (F.col("own") > other).cast("int").alias("side")))
        dealt = one.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")).select(*spot, "fp", F.explode(tiles).alias("t")).select(*spot, "t.i", "t.j", "t.side", "fp")
    return dealt.repartition(*columns[:5]).sortWithinPartitions(*columns).mapInArrow(_links(radius), "u long, v long")


def _grouped(fps: DataFrame, radius: int) -> DataFrame:
    """Staged fingerprints with component_id and class."""
    classes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    joined = components(stage(links(classes.select("fp"), radius), "links"))
    named = classes.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.select("fp", "component").join(smallest, "component").select(F.col("fp").alias("of_fp"), "component_id", F.col("component").alias("class"))
    return fps.join(of, F.col("fp") == F.col("of_fp")).drop("of_fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id, class) for every row of docs; component_id is the smallest doc_id that links of the radius reach.

    Null and empty texts have fingerprint zero and link like any other. Rows without an id get a
    component like others; a component of such rows only has component_id null. class is the
    component's smallest fp as a signed long. Repeated rows stay repeated. An empty table gives an empty one. Other columns are not read.
    """
    fps = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return _grouped(fps, radius).select("doc_id", "fp", "component_id", "class")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each group of near-duplicates, all columns as they are: the row with the smallest doc_id,
    of several the one with the smallest hash of its text, then of all its columns (but maps).

    A row without an id stays only if its group has no id at all. Rows that share an id but not their texts may be in
    different groups, and then each counts in its own. Null and empty texts are a group like others. An empty table
    gives an empty one.
    """
    fps = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    found = stage(_grouped(fps, radius).groupBy("class", "doc_id", "text_hash").agg(F.count("*").alias("n")), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("first")
    firsts = found.groupBy("class").agg(first).select(F.col("class").alias("of"), "first.doc_id", "first.text_hash").withColumnsRenamed({"doc_id": "first_id", "text_hash": "first_hash"})
    # joined by all three columns, so that a large group is spread
    first_of = (F.col("class") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    stays = F.col("of").isNotNull()
    key_id, key_hash = (f"{name}{uuid.uuid4().hex}" for name in ("id", "hash"))
    told = stage(found.join(firsts, first_of, "left").where(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias(key_id), F.col("text_hash").alias(key_hash), stays.alias("stays")), "told")
    of_row = docs[id_col].cast("long").eqNullSafe(F.col(key_id)) & (F.xxhash64(docs[text_col]) == F.col(key_hash))
    kept = docs.join(checked(told), of_row, "left_anti")
    repeated = told.where("stays")
    if repeated.isEmpty():
        return kept
    # of equal ids and texts one row: partial aggregates, however many there are
    plain = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()]
    packed = docs.join(checked(repeated), of_row, "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(*plain).alias("h"), F.col(id_col).cast("long").alias("i"), F.xxhash64(text_col).alias("t"))
    return kept.unionByName(packed.groupBy("i", "t").agg(F.min_by("row", "h").alias("row")).select("row.*"))


