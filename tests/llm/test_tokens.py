"""Token ids against the library, the perfect hash, the id shards and the rollups."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkweave.llm import idstore, rollup
from sparkweave.llm.tokens import Encoder
from sparkweave.sources import files

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
FIELDS = "doc_id long, text string, source string, lang string, n_tokens long, start long, shard int"


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, g, 1, 2, 3) for i, t, s, g in rows], FIELDS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBz É'İſ́K.,!#1 \n\t\x0b\x1c  中<|>eo", max_size=40), st.text(max_size=20), st.sampled_from(["x<|endoftext|>y", "<|ENDOFTEXT|>", "it's", "A.B.", "don't,", "é.", "İ."])), max_size=6))
def test_ids_are_those_of_the_whole_texts(texts):
    ids, counts = Encoder.of(PATH)(pa.array(texts, pa.string()))
    want = [ids_of(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_without_words(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, counts = Encoder(path, by_word=False)(pa.array(["a  b", None]))
    assert ids.tolist() == Tokenizer.from_file(path).encode("a  b").ids and counts.tolist()[1] == 0


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.int64)
    assert sorted(idstore.PerfectHash.build(keys)(keys).tolist()) == list(range(len(keys)))


def test_large_perfect_hash():
    keys = np.random.default_rng(1).permutation(200_000).astype(np.int64) * 7
    index = idstore.Index.load(b"".join(p.tobytes() for p in idstore.Index.build(np.sort(keys), np.ones(len(keys), np.int64)).parts()))
    first, copies = index.rows(keys)
    assert (first == keys // 7).all() and (copies == 1).all()
    strange, _ = index.rows(keys + 1)
    assert (strange >= 0).mean() < 1e-4


def test_shards(spark):
    rows = [(k * 3, f"Some Words, {k}.", "s", "en") for k in range(200)] + [(9, "copy of nine", "s", "en")] * 3 + [(7, None, "s", "en"), (8, "", "s", "en"), (None, "nameless", "s", "en"), (None, None, "s", "en"), (-5, "x " * 30_000, "s", "en")]
    root, manifest = idstore.encode(frame(spark, rows), PATH, 2, shards=5)
    got = idstore.scan(spark, root).toPandas()
    assert len(got) == len(rows) == manifest.toPandas()["n_docs"].sum()
    in_order = got.sort_values("start")
    assert in_order["doc_id"].isna().tolist() == [True] * 2 + [False] * (len(rows) - 2) and in_order["doc_id"].dropna().is_monotonic_increasing
    assert in_order["start"].tolist() == (in_order["n_tokens"].cumsum() - in_order["n_tokens"]).tolist()
    crc = lambda t: zlib.crc32(np.array([*ids_of(t), 2], "<u4").tobytes())
    want = sorted((-1 if i is None else i, len(ids_of(t)) + 1, crc(t)) for i, t, *_ in rows)
    assert sorted(zip(got["doc_id"].fillna(-1).astype(int), got["n_tokens"], got["ids_crc32"])) == want
    reader = idstore.Reader(spark, root)
    assert [x.tolist() for x in reader.get(30)] == [[*ids_of("Some Words, 10."), 2]]
    assert sorted(len(x) for x in reader.get(9)) == sorted([len(ids_of("Some Words, 3.")) + 1] + [len(ids_of("copy of nine")) + 1] * 3)
    assert reader.get(10) == [] and reader.get(10**12) == [] and reader.get(-(10**12)) == []


@pytest.mark.parametrize("n", [0, 1, 7, 1000, 200_000])
def test_lookups_read_little(n):
    r = np.random.default_rng(n)
    keys = np.sort(r.integers(-(1 << 62), 1 << 62, n)).repeat(r.integers(1, 3, n))
    index = idstore.Index.build(keys, r.integers(0, 50, len(keys) + 3))
    data, read = b"".join(p.tobytes() for p in index.parts()), []

    def some(start, size):
        read.append(size)
        return data[start : start + size]

    every = idstore.Index.load(data)
    for key in [*r.choice(keys, min(n, 300)).tolist(), *r.integers(-(1 << 62), 1 << 62, 50).tolist()]:
        read.clear()
        ends = idstore.Lookup(some).offsets(key)  # cold, with the header
        first, copies = (int(x[0]) for x in every.rows(np.array([key])))
        assert ends.tolist() == (index.offsets[first : first + copies + 1].tolist() if copies else []) and sum(read) < 1500
        assert (copies > 0) == bool((keys == key).any())


def test_empty_shards(spark):
    root, _ = idstore.encode(frame(spark, []), PATH, 2)
    assert idstore.scan(spark, root).collect() == []


def test_rollup(spark):
    rows = [(k, f"words {k} and more", ["a", "b", None][k % 3], ["en", None][k % 2]) for k in range(60)] + [(60, None, "a", "en"), (61, "", "b", "en")]
    counts = rollup.counted(frame(spark, rows), PATH)
    table = rollup.new(spark)

    def check(want):
        got = {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in table.totals().collect()}
        assert got == want

    def sums(chosen, version, extra=0):
        out = {}
        for _, t, s, g in chosen:
            d, n = out.get((s, g, version), (0, 0))
            out[s, g, version] = (d + 1, n + len(ids_of(t)) + extra)
        return out

    check({})
    assert table.commit("load", rollup.deltas(counts, "v1", "n_tokens"))
    check(sums(rows, "v1"))
    assert not table.commit("load", rollup.deltas(counts, "v1", "n_tokens"))
    gone = counts.where("doc_id < 20")
    table.commit("gone", rollup.deltas(gone, "v1", "n_tokens", -1))
    check(sums(rows[20:], "v1"))
    table.compact()
    check(sums(rows[20:], "v1"))
    assert not table.commit("load", rollup.deltas(counts, "v1", "n_tokens"))
    moved = counts.where("doc_id >= 20 and source = 'a'")
    table.commit("moved", rollup.revised(moved, "v1", "n_tokens", "v2", moved["n_tokens"] + 1))
    check(sums([r for r in rows[20:] if r[2] != "a"], "v1") | sums([r for r in rows[20:] if r[2] == "a"], "v2", 1))
    table.commit("none", rollup.deltas(counts.limit(0), "v1", "n_tokens"))
    table.compact()
    check(sums([r for r in rows[20:] if r[2] != "a"], "v1") | sums([r for r in rows[20:] if r[2] == "a"], "v2", 1))


def test_a_batch_that_failed_half_way_is_not_seen(spark):
    table, rows = rollup.new(spark), spark.sql("SELECT 's' AS source, 'l' AS lang, 'v' AS version, 1L AS docs, 5L AS tokens")
    rows.write.parquet(f"{table.root}/batches/b1")
    files.remove(f"{table.root}/batches/b1/_SUCCESS")
    assert table.totals().isEmpty() and table.commit("b1", rows)
    assert [tuple(r) for r in table.totals().collect()] == [("s", "l", "v", 1, 5)]
    with pytest.raises(ValueError):
        table.commit("../b", rows)


def test_rollup_query(spark, folder):
    from sparkweave.llm.queries import QUERIES

    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    first, want = {}, {}
    for i, t in zip(docs["doc_id"], docs["text"]):
        first[t] = min(first.get(t, i), i)
    for row in docs.itertuples():
        if first[row.text] == row.doc_id:
            end = row.lang == "en"
            key = (row.source, row.lang, "word_bpe_49k+end" if end else "word_bpe_49k")
            d, n = want.get(key, (0, 0))
            want[key] = (d + 1, n + len(ids_of(row.text)) + end)
    got = {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in QUERIES["op3_token_rollup"](spark, folder).collect()}
    assert got == want
