"""Cross-polytope search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.llm import ann

FIELDS = "vec_id long, embedding array<float>, label int, score double, shell int, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0.0, 1, "v") for i, v in rows], FIELDS)


def brute(rows, q, k):
    x = np.array([v for _, v in rows], np.float32).astype(float)
    ids, me = np.array([i for i, _ in rows]), [i for i, _ in rows].index(q)
    s = x @ x[me]
    order = [j for j in np.lexsort((ids, -np.round(s, 13))) if ids[j] != q][:k]
    return [(int(ids[j]), s[j]) for j in order]


@pytest.mark.parametrize("norms", [False, True])
def test_recall_and_scores(spark, norms):
    r = np.random.default_rng(5)
    x = r.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms:
        x *= r.uniform(0.2, 5, size=(1500, 1))
    rows = [(k, v.astype(np.float32)) for k, v in enumerate(x)]
    df = frame(spark, rows)
    got = ann.search(df, F.expr("vec_id % 20 = 0"), 20).toPandas()
    hits = total = 0
    for q, mine in got.groupby("query_id"):
        mine, want = mine.sort_values("rank"), dict(brute(rows, q, 20))
        assert mine["rank"].tolist() == list(range(1, 21)) and mine["score"].is_monotonic_decreasing and q not in set(mine["vec_id"])
        exact = {i: s for i, s in brute(rows, q, len(rows))}
        assert np.allclose(mine["score"], [exact[i] for i in mine["vec_id"]], atol=1e-12)
        hits, total = hits + len(set(mine["vec_id"]) & set(want)), total + 20
    assert got["query_id"].nunique() == 75 and hits / total >= 0.9


@pytest.mark.parametrize("n", [5, 10, 21, 50, 100])
def test_few_rows_of_many_values(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    rows = [(k, v.astype(np.float32)) for k, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    df, hits = frame(spark, rows), 0
    got = ann.search(df, F.lit(True), 20).toPandas()
    for q in range(n):
        mine, want = got[got["query_id"] == q].sort_values("rank"), brute(rows, q, 20)
        assert mine["rank"].tolist() == list(range(1, len(want) + 1))
        hits += len(set(mine["vec_id"]) & {i for i, _ in want})
    assert hits >= 0.9 * n * min(20, n - 1)


def test_queries_far_from_tight_groups(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([np.repeat(r.normal(size=(3, 64)), 400, axis=0) + 0.02 * r.normal(size=(1200, 64)), r.normal(size=(12, 64))])
    rows = [(k, v.astype(np.float32)) for k, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    df = frame(spark, rows)
    got = ann.search(df, F.expr("vec_id >= 1200"), 20).toPandas()
    for q in range(1200, 1212):
        assert len(set(got[got["query_id"] == q]["vec_id"]) & {i for i, _ in brute(rows, q, 20)}) >= 18


@pytest.mark.parametrize("chunk", [4, 16_384])
def test_a_query_whose_buckets_hold_too_few(spark, monkeypatch, chunk):
    monkeypatch.setattr(ann, "CHUNK", chunk)
    x = np.random.default_rng(2).normal(size=(60, 64))
    rows = [(k, v.astype(np.float32)) for k, v in enumerate(x)]
    df = frame(spark, rows)
    got = ann.search(df, F.expr("vec_id % 7 = 0"), 20, tables=1, recall=0.01).toPandas()
    for q in range(0, 60, 7):
        assert got[got["query_id"] == q].sort_values("rank")["vec_id"].tolist() == [i for i, _ in brute(rows, q, 20)]


def test_copies_tie_to_smaller_ids(spark):
    v = np.eye(64)[3]
    df = frame(spark, [(k, v) for k in range(60, 0, -1)] + [(100, -v)])
    got = ann.search(df, F.expr("vec_id = 20"), 20).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [k for k in range(1, 22) if k != 20] and {r["score"] for r in got} == {1.0}


def test_a_bucket_of_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 16)
    r = np.random.default_rng(1)
    x = np.concatenate([np.tile(np.eye(8)[0], (90, 1)), r.normal(size=(60, 8))])
    rows = [(k, v.astype(np.float32)) for k, v in enumerate(x)]
    df = frame(spark, rows)
    got = ann.search(df, F.expr("vec_id % 3 = 0"), 5).toPandas()
    for q in (0, 3, 60):
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["vec_id"].tolist() == [i for i, _ in brute(rows, q, 5)]


def test_vectors_that_take_no_part(spark):
    good = [(k, np.eye(4)[k % 4] + 0.1) for k in range(6)]
    bad = [(10, None), (11, [0, 0, 0, 0]), (12, [1, None, 0, 0]), (13, [float("nan"), 1, 1, 1]), (14, [float("inf"), 1, 1, 1]), (16, []), (None, [1, 1, 1, 1])]
    df = frame(spark, good + bad)
    got = ann.search(df, F.lit(True), 20).collect()
    assert {r["query_id"] for r in got} == {r["vec_id"] for r in got} == set(range(6)) and len(got) == 30


def test_no_rows(spark):
    for rows in ([], [(1, None)], [(1, [1, 0])], [(None, [1, 0])]):
        assert ann.search(frame(spark, rows), F.lit(True), 3).collect() == []


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 50))
    assert np.allclose(np.linalg.norm(ann.rotated(x, 3), axis=1), np.linalg.norm(x, axis=1))
    wide = np.random.default_rng(1).normal(size=(3, 256))
    assert np.allclose(ann.hadamard(ann.hadamard(wide)), 256 * wide) and np.allclose(ann.hadamard(np.eye(8))[:2, :2], [[1, 1], [1, -1]])


@pytest.mark.parametrize("rows", [100, 700, 100_000])
def test_buckets_grow_with_rows_and_the_nearest_come_first(rows):
    space = ann.Space.of(50, rows, 2, 1)
    assert space.size == {100: 512, 700: 2048, 100_000: 16_384}[rows]
    unit = ann._unit(np.random.default_rng(rows).normal(size=(9, 50)))
    for probes in (1, 7, 60, space.size):
        near = ann.replace(space, probes=probes).near(unit)
        for t in range(2):
            one, two = space._turns(unit, t)
            for k in range(9):
                sums = (one[k][:, None] + two[k][None, :]).ravel()
                assert len(set(near[t, k])) == probes
                assert np.allclose(np.sort(sums[near[t, k]]), np.sort(sums)[len(sums) - probes :])
    assert (space.codes(unit) == ann.replace(space, probes=1).near(unit)[:, :, 0]).all()
    assert (space.ranks(unit, space.codes(unit).T) == 0).all()


def test_routing_by_bucket(spark, monkeypatch):
    """Beyond ROUTED rows, rows and queries meet in parts of the buckets; parts of more than CHUNK rows are dealt out."""
    monkeypatch.setattr(ann, "CHUNK", 64)
    monkeypatch.setattr(ann, "ROUTED", 500)
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(900, 32)), np.repeat(r.normal(size=(1, 32)), 500, axis=0) + 0.01 * r.normal(size=(500, 32))])
    rows = [(k, v.astype(np.float32)) for k, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    df = frame(spark, rows)
    got, compared = ann.searched(df, F.expr("vec_id % 20 = 0"), 20)
    got = got.toPandas()
    hits = sum(len(set(mine["vec_id"]) & {i for i, _ in brute(rows, q, 20)}) for q, mine in got.groupby("query_id"))
    assert len(got) == 70 * 20 and hits >= 0.9 * len(got) and 0 < compared < 8 * 70 * 1400


def test_the_compared_share_falls_with_rows(spark):
    shares = []
    for n in (400, 1600, 6400):
        x = np.random.default_rng(n).normal(size=(n, 64))
        df = frame(spark, [(k, v.astype(np.float32)) for k, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))])
        shares.append(ann.searched(df, F.expr("vec_id % 20 = 0"), 20)[1] / (n * n / 20))
    assert shares[0] > 1.2 * shares[1] > 1.44 * shares[2]


def test_rows_of_one_id_each_count(spark):
    df = frame(spark, [(1, [1, 0]), (1, [0.5, 0.25]), (2, [1, 0]), (2, [1, 0]), (3, [0, 1])])
    got = ann.search(df, F.lit(True), 20).collect()
    assert len(got) == 5 * 4
    twos = [[r["vec_id"] for r in got if r["query_id"] == q] for q in (1, 2, 3)]
    assert [sorted(t) for t in twos] == [[1, 1, 2, 2, 2, 2, 3, 3], [1, 1, 1, 1, 2, 2, 3, 3], [1, 1, 2, 2]]
    of_two = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 2)
    assert of_two == [(1, 1, 1.0)] * 2 + [(2, 2, 1.0)] * 2 + [(3, 1, 0.5)] * 2 + [(4, 3, 0.0)] * 2


def test_lengths_are_searched_apart(spark):
    df = frame(spark, [(k, np.eye(4)[k % 4] + 0.1) for k in range(6)] + [(10, [1, 1]), (11, [1, 2]), (12, [3])])
    got = ann.search(df, F.lit(True), 20).collect()
    assert len(got) == 6 * 5 + 2 and {(r["query_id"], r["vec_id"], r["score"]) for r in got if r["query_id"] > 9} == {(10, 11, 3.0), (11, 10, 3.0)}
