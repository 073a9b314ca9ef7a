"""SimHash groups against brute force, and connected components."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkweave.llm import simhash
from sparkweave.llm.components import components

FIELDS = "doc_id long, text string, fp long, component_id long, kept_id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], FIELDS)


def bits(text):
    """One bit at a time, from the text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, close):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in combinations(sorted(nodes), 2):
        if close(a, b) and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def expected(rows):
    fps = [bits(t) for _, t in rows]
    of = groups(set(fps), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[of[f]] = min(least.get(of[f], i), i)
    return sorted(((i, f, least.get(of[f])) for (i, _), f in zip(rows, fps)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = []
    for k in range(60):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.choice([1, 2, 3, 60, 300]))]
        out.append((3 * k + 5, " ".join(words)))
        for c in range(r.choice([0, 0, 1, 4])):
            near = list(words)
            near[r.randrange(len(near))] = "changed"
            out.append((3 * k + 1000 * c, r.choice([" ".join(words), " ".join(near), " ".join(words).upper(), "\n".join(words)])))
    return [*out, (1, None), (2, ""), (3, " \t"), (None, "no id"), (None, None), (4, "x " * 40_000), (5, out[0][1]), (5, out[0][1])]


def test_groups(spark, rows):
    assert got(simhash.near_duplicates(frame(spark, rows))) == expected(rows)


@pytest.mark.parametrize("piece", [1, 7, 30])
def test_texts_in_pieces(rows, monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    for _, text in rows[:80]:
        assert simhash.fingerprint(text) == bits(text)


def test_tables_of_the_driver(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert got(simhash.near_duplicates(docs)) == expected([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_keep_one(spark, rows):
    df = frame(spark, rows)
    kept = simhash.keep_one(df)
    assert kept.dtypes == df.dtypes
    want = {c for _, _, c in expected(rows) if c is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == sum(1 for x in {f: c for _, f, c in expected(rows)}.values() if x is None)


def test_small_tables(spark):
    for few in ([], [(1, None)], [(None, "a"), (None, "a"), (None, "totally different words stand here")], [(7, "a b c d")] * 3):
        assert got(simhash.near_duplicates(frame(spark, few))) == expected(few)
        assert simhash.keep_one(frame(spark, few)).count() == len({bits(t) for _, t in few})


def test_keep_one_where_ids_repeat(spark):
    a, b = "an entirely different text of a few words", "some other words that have nothing to do with it at all"
    kept = lambda few: sorted(map(tuple, simhash.keep_one(frame(spark, few)).select("doc_id", "text").collect()), key=str)
    assert kept([(3, b), (5, a), (5, b)]) == [(3, b), (5, a)]
    assert kept([(5, a), (5, b)] * 3) == [(5, a), (5, b)]
    assert kept([(None, a), (None, a), (None, b), (7, b), (9, a.upper())]) == [(7, b), (9, a.upper())]
    assert set(kept([(None, a), (None, a), (None, None), (None, "")])) in ({(None, a), (None, x)} for x in (None, ""))
    # different other columns: one row, always the same one
    two = [simhash.keep_one(frame(spark, [(5, a)] * 4).withColumn("n", F.monotonically_increasing_id()).repartition(k)).collect() for k in (1, 3)]
    assert two[0] == two[1] and len(two[0]) == 1


@pytest.mark.parametrize("chunk, tile", [(2, 2), (8, 6), (8, 65_536), (2048, 65_536)])
def test_links_of_crowded_blocks(spark, monkeypatch, chunk, tile):
    """Many fingerprints in the same blocks, cut and dealt out in chunks of any size, stay as connected as they are."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "TILE", tile)
    r = random.Random(chunk)
    base = r.getrandbits(64)
    near = {base}
    while len(near) < 60:
        f = r.choice(sorted(near))
        for b in r.sample(range(64), r.choice([1, 2, 3, 4, 5])):
            f ^= 1 << b
        near.add(f)
    near |= {r.getrandbits(64) for _ in range(40)}
    signed = [f - (1 << 64) if f >> 63 else f for f in near]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    pairs = {tuple(sorted((u % (1 << 64), v % (1 << 64)))) for u, v in found}
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    assert groups(near, lambda a, b: (a, b) in pairs) == groups(near, lambda a, b: (a ^ b).bit_count() <= 3)


def test_a_block_that_very_many_share(spark):
    """100,000 fingerprints with equal upper halves: what is shuffled grows with them, not with their pairs."""
    r = np.random.default_rng(4)
    low = np.unique(r.integers(0, 1 << 32, 100_000, np.uint64))
    near = low[:300] ^ np.uint64(5)
    fps = np.unique(np.concatenate([low, near])) | np.uint64(0x1234567 << 32)
    df = spark.createDataFrame([(f,) for f in fps.view(np.int64).tolist()], "fp long")
    found = {tuple(sorted(map(int, p))) for p in simhash.links(df).collect()}
    root = components(spark.createDataFrame(sorted(found), "u long, v long")).collect()
    of = {r["node"]: r["component"] for r in root}
    signed = lambda x: int(np.uint64(x | np.uint64(0x1234567 << 32)).view(np.int64))
    assert all(of[signed(a)] == of[signed(b)] for a, b in zip(low[:300], near))
    assert all((u ^ v).bit_count() <= 3 for u, v in found)


def test_pivots_never_discard_a_close_pair():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 64, 200, np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64)
    found = {(int(i), int(j)) for x, y in simhash._close(a, b, False, simhash._pivots(), 3) for i, j in zip(x, y)}
    assert {(k, k) for k in range(200)} <= found


def test_components(spark):
    r = random.Random(2)
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 540)]
    random_ = [(r.randint(0, 90), r.randint(0, 90)) for _ in range(50)]
    edges = [*chain, *star, *random_, (700, 700), (1000, None), (None, None), *star[:3]]
    r.shuffle(edges)
    want = groups({x for e in edges if None not in e for x in e}, lambda a, b, s=set(edges): (a, b) in s or (b, a) in s)
    assert dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect())) == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
