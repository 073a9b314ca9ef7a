"""Shards of nearly equal bytes, slots without gaps, groups of equal texts."""

import zlib

import pytest

from sparkweave.llm import sharding

FIELDS = "doc_id long, text string, size string, shard string, range int, part int, key string, own string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "s", 1, 2, "k", "o") for i, t in rows], FIELDS)


def checked(df, rows, shards=8):
    got = df.toPandas()
    size = lambda t: len((t or "").encode()) + 1
    want = sorted((-1 if i is None else i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(zip(got["doc_id"].fillna(-1).astype(int), got["size"], got["text_crc32"])) == want
    assert got["shard"].between(0, shards - 1).all()
    for _, mine in got.groupby("shard"):
        assert sorted(mine["slot"]) == list(range(len(mine)))
    return got


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_bytes_are_near_equal(spark, shards):
    rows = [(k, f"é{k} " * (1 + k * k % 211)) for k in range(3000)] + [(None, None), (1, ""), (1, ""), (2, None)]
    got = checked(sharding.shard(frame(spark, rows), shards), rows, shards)
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == shards and sums.max() <= 1.01 * sums.mean() and sums.min() >= 0.99 * sums.mean()


def test_groups_stay_together_unless_they_are_overfull(spark):
    rows = [(k, f"text {k % 700} " * 20) for k in range(1400)] + [(2000 + k, "the same text " * 20) for k in range(900)]
    got = checked(sharding.shard(frame(spark, rows)), rows)
    sums, hot = got.groupby("shard")["size"].sum(), zlib.crc32(b"the same text " * 20)
    assert sums.max() <= 1.03 * sums.mean()
    assert got[got["text_crc32"] == hot]["shard"].nunique() == 8
    split = got[got["text_crc32"] != hot].groupby("text_crc32")["shard"].nunique()
    assert (split > 1).mean() <= 0.1


@pytest.mark.parametrize("numbered, i, text", [(700, 5000, "the same text " * 20), (200_000, None, None)])
def test_equal_rows_are_dealt_out(spark, monkeypatch, numbered, i, text):
    monkeypatch.setattr(sharding, "NUMBERED", numbered)
    rows = [(k, f"text {k} ") for k in range(300)] + [(i, text)] * 6000
    a, b = (checked(sharding.shard(df), rows) for df in (frame(spark, rows), frame(spark, rows[::-1]).repartition(7)))
    sums = a.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() <= 1.03 * sums.mean()
    told = [sorted(x.fillna(-1)[["doc_id", "text_crc32", "shard", "slot"]].values.tolist()) for x in (a, b)]
    assert told[0] == told[1]


@pytest.mark.parametrize("files", [1, 3])
def test_whole_rows_are_placed_and_written_alike(spark, tmp_path, files):
    rows = [(k, f"text {k % 250} " * (1 + k % 9)) for k in range(500)] + [(7, "many equal rows " * 20)] * 2000 + [(None, None), (1, "")]
    df = frame(spark, rows)
    sharding.write(sharding.place(df), str(tmp_path / "out"), files)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted([*df.columns, "slot"]) and 8 <= len(list((tmp_path / "out").glob("shard=*/*.parquet"))) <= 8 * files
    key = lambda r: (str(r["doc_id"]), zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"])
    want = sorted((str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(df).collect())
    assert sorted(map(key, back.collect())) == want
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(rows, key=str)


def test_a_very_long_text_fills_a_shard(spark):
    rows = [(0, "long " * 400_000)] + [(k, f"short {k}") for k in range(1, 400)]
    got = checked(sharding.shard(frame(spark, rows)), rows)
    assert (got[got["doc_id"] > 0]["shard"] != got[got["doc_id"] == 0]["shard"].iloc[0]).all()


def test_reruns_agree(spark):
    rows = [(k % 400, f"t{k % 90}") for k in range(800)]
    a, b = (sorted(map(tuple, sharding.shard(df).select("doc_id", "text_crc32", "shard", "slot").collect())) for df in (frame(spark, rows), frame(spark, rows[::-1]).repartition(7)))
    assert a == b


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None)] * 3, [(1, "x")] * 20, [(k, "same") for k in range(50)]])
def test_small_tables(spark, rows):
    checked(sharding.shard(frame(spark, rows)), rows)
