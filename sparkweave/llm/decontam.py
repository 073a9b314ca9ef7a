"""Benchmark decontamination by size-partitioned MinHash containment search.

Zhu et al., "LSH Ensemble" (2016) partitions by set size, because a containment threshold becomes
another similarity threshold at each size. Here the short side, the benchmark, is sketched: items are
partitioned by their number of shingles, and each item of a partition keeps the shingles of smallest
hash, as many as (1 - threshold) of the partition's upper size bound, plus one. A document that holds
`threshold` of an item's shingles must hold one of these, so the search over the sketches misses
nothing at any document length; documents with too few shingles for a partition skip it. Each
candidate is then verified by its exact containment, |item and document| / |item|.

Shingles are 128-bit keys in arrays, some 20 bytes for each word of the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import ship, slices, stage, words_of
from sparkweave.llm.idstore import mix

SHINGLE, THRESHOLD = 5, 0.8
#: UTF-8 bytes of benchmark text that are sent to the executors at once; a larger benchmark takes several passes.
BLOCK_BYTES = 16 << 20


def _hashed(words: list) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _keys(codes: np.ndarray, at: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A 64-bit key of the n word codes from each position on."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out += mix(codes[at + k], salt + k)
    return out


class Matcher:
    """Finds the items of one block of the benchmark in documents. An item's shingles have min(n, its words) words."""

    SECOND = 1 << 10  # salt of the other half of a key

    def __init__(self, items: list[tuple], n: int, threshold: float):
        self.threshold, self.ids = threshold, [i for i, _ in items]
        spans, firsts, seconds, vocabulary = np.zeros(len(items), np.int64), [], [], set()
        sketch: dict[int, list[tuple[np.ndarray, int, float]]] = {}
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            vocabulary.update(words)
            own = _hashed(words)
            spans[k] = span = min(n, len(own))
            at = np.arange(len(own) - span + 1 if span else 0)
            first, where = np.unique(_keys(own, at, span, 0), return_index=True)
            firsts.append(first)
            seconds.append(_keys(own, at[where], span, self.SECOND))
            if span:
                part = (len(first) - 1).bit_length()
                kept = first[: int((1 - threshold) * (1 << part) + 1e-9) + 1]
                sketch.setdefault(int(span), []).append((kept, k, threshold * ((1 << part) // 2)))
        distinct = sorted(vocabulary)
        self.vocabulary, self.codes = pa.array(distinct, pa.binary()).cast(pa.string()), _hashed(distinct)
        self.sizes = np.array([len(f) for f in firsts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first, self.second = (np.concatenate([np.empty(0, np.uint64), *x]) for x in (firsts, seconds))
        #: By length of the shingles: hashes, their items, and how many shingles a document needs.
        self.sketch: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for span, parts in sketch.items():
            hashes, lengths = np.concatenate([p[0] for p in parts]), [len(p[0]) for p in parts]
            order = np.argsort(hashes, kind="stable")
            of = np.repeat(np.array([p[1] for p in parts], np.int32), lengths)[order]
            self.sketch[span] = hashes[order], of, np.repeat(np.array([p[2] for p in parts], np.float32), lengths)[order]

    def __call__(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of the texts that reach the threshold."""
        if not len(self.vocabulary):
            return []
        runs = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        flat = runs.flatten()
        real = pc.not_equal(flat, "")  # leading and trailing white space leave empty runs
        row_of = np.asarray(pc.list_parent_indices(runs), np.int64)[np.asarray(real)]
        place = np.asarray(pc.fill_null(pc.index_in(flat.filter(real), value_set=self.vocabulary), -1), np.int64)
        codes, known = self.codes[place], np.concatenate([[0], np.cumsum(place >= 0)])
        counts, found = np.bincount(row_of, minlength=len(texts)), []
        for span, (hashes, items, least) in sorted(self.sketch.items()):
            if len(codes) < span:
                continue
            at = np.flatnonzero((known[span:] - known[:-span] == span) & (row_of[span - 1 :] == row_of[: len(row_of) - span + 1]))
            keys = _keys(codes, at, span, 0)
            low, high = np.searchsorted(hashes, keys, "left"), np.searchsorted(hashes, keys, "right")
            many = high - low
            hit = np.repeat(np.arange(len(at)), many)
            entry = np.arange(len(hit)) - np.repeat(np.cumsum(many) - many - low, many)
            rows = row_of[at[hit]]
            enough = counts[rows] - span + 1 >= least[entry]
            pairs = np.unique(rows[enough] * len(self.ids) + items[entry[enough]])
            bounds, of = np.searchsorted(row_of[at], np.arange(len(texts) + 1)), -1
            for row, item in zip((pairs // len(self.ids)).tolist(), (pairs % len(self.ids)).tolist()):
                if row != of:
                    own, of = slice(bounds[row], bounds[row + 1]), row
                    first, where = np.unique(keys[own], return_index=True)
                    second = _keys(codes, at[own][where], span, self.SECOND)
                a, b = self.starts[item], self.starts[item] + self.sizes[item]
                there = np.minimum(np.searchsorted(first, self.first[a:b]), len(first) - 1)
                shared = int(np.count_nonzero((first[there] == self.first[a:b]) & (second[there] == self.second[a:b])))
                if shared >= self.threshold * (b - a) - 1e-9:
                    found.append((row, item, shared))
        return found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> Iterator[Matcher]:
    """Matchers that together hold the whole benchmark, each of a bounded part."""
    slim = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    for b in range(blocks):
        part = slim if blocks == 1 else slim.where(F.pmod(F.xxhash64("text", "id"), F.lit(blocks)) == b)
        yield Matcher([tuple(row) for row in part.collect()], n, threshold)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) for each row of docs and each item that it holds.

    Words are runs of anything but ASCII white space, A-Z in lower case; shingles are distinct runs of n words.
    An item of fewer words is one shingle, and held by every document with these words in a row. An item or
    text that is null or has no words is held by none and holds none. Repeated rows on either side count each.
    Empty tables give an empty result. A benchmark of more than BLOCK_BYTES takes a pass for each block.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, shared long, item_shingles long, containment double"
    out, item_type = docs.sparkSession.createDataFrame([], kinds), benchmark.schema[item_col].dataType

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_type = to_arrow_type(item_type)
    for matcher in _blocks(benchmark, item_col, item_text_col, n, threshold):
        get = ship(docs.sparkSession, matcher)

        def run(batches: Iterator[pa.RecordBatch], get=get) -> Iterator[pa.RecordBatch]:
            match = get()
            for batch in slices(batches, "text"):
                if found := match(batch.column("text")):
                    rows, items, counts = (np.array(x, np.int64) for x in zip(*found))
                    sizes = match.sizes[items]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(rows)), pa.array([match.ids[k] for k in items], arrow_type), pa.array(counts), pa.array(sizes), pa.array(counts / sizes)],
                        ["doc_id", "item_id", "shared", "item_shingles", "containment"],
                    )

        out = out.unionByName(slim.mapInArrow(run, kinds)) if matcher.ids else out
    return out


def drop(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that hold an item, as find() says; the others as they are, with all columns.

    Null and empty texts stay, and all rows stay if the benchmark is empty. Repeated rows are judged alike.
    Between the blocks of a large benchmark the rows are staged, so that a worker holds one block.
    """
    last = None
    for matcher in _blocks(benchmark, item_col, item_text_col, n, threshold):
        docs = docs if last is None else stage(docs, "block")
        last = get = ship(docs.sparkSession, matcher)

        def run(batches: Iterator[pa.RecordBatch], get=get) -> Iterator[pa.RecordBatch]:
            match = get()
            for batch in slices(batches, text_col):
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _, _ in match(batch.column(text_col))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
