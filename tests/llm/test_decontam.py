"""Containment search against all pairs of shingle sets."""

import random
import re

import pytest

from sparkweave.llm import decontam

DOC, ITEM = "doc_id long, text string, item_id string, shared int, containment double", "item_id long, text string, doc_id int"


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in docs], DOC), spark.createDataFrame([(i, t, 4) for i, t in items], ITEM)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))


def shingles(text, n):
    of = words(text)
    return {tuple(of[k : k + n]) for k in range(len(of) - n + 1)}


def brute(docs, items):
    out = []
    sets = [(j, min(5, len(words(q)))) for j, q in items]
    held = [shingles(q, n) if n else set() for (_, q), (_, n) in zip(items, sets)]
    for i, t in docs:
        of = {n: shingles(t, n) for n in range(1, 6)}
        for (j, n), b in zip(sets, held):
            a = of.get(n, set())
            if b and len(a & b) / len(b) >= 0.8 - 1e-9:
                out.append((i, j, len(a & b), len(b)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case():
    r = random.Random(8)
    text = lambda n, size=3000: [f"w{r.randint(0, size)}" for _ in range(n)]
    items = [(k, " ".join(text(r.choice([2, 4, 5, 6, 20, 40, 90])))) for k in range(40)] + [(3, "a b c a b c a b c"), (90, None), (91, ""), (None, "an item that has no id at all"), (92, "Same Words\nas  another item here"), (93, "same words as another ITEM here")]
    docs = []
    for k in range(150):
        words = text(r.choice([0, 3, 30, 400]))
        if k % 3 == 0:
            item = (r.choice(items)[1] or "").split()
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                if item:
                    item[r.randrange(len(item))] = "other"
            at = r.randint(0, len(words))
            words[at:at] = item
        docs.append((k, " ".join(words)))
    docs += [(k + 1000, t) for k, (_, t) in enumerate(items)] + [(5, docs[0][1]), (None, "long " * 50_000 + items[7][1]), (777, None), (778, items[7][1].upper().replace(" ", "\t"))]
    return docs, items


def test_pairs(spark, case):
    docs, items = case
    found = decontam.find(*frames(spark, docs, items))
    assert found.columns == ["doc_id", "item_id", "shared", "item_shingles", "containment"]
    assert sorted((tuple(r)[:4] for r in found.collect()), key=str) == brute(docs, items)


def test_blocks_of_the_benchmark(spark, case, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 500)
    docs, items = case
    assert sorted((tuple(r)[:4] for r in decontam.find(*frames(spark, docs, items)).collect()), key=str) == brute(docs, items)


def test_drop(spark, case):
    docs, items = case
    df, benchmark = frames(spark, docs, items)
    clean = decontam.drop(df, benchmark)
    assert clean.dtypes == df.dtypes
    texts = [t for _, t in docs if not brute([(0, t)], items)]
    assert sorted((r["text"] for r in clean.collect()), key=str) == sorted(texts, key=str)


def test_short_items_in_longer_texts(spark):
    items = [(1, "what is the capital"), (2, "yes"), (3, "Of France"), (4, "no such words"), (5, "capital of france is paris")]
    docs = [(1, "Tell me: What is\nthe CAPITAL of France ?"), (2, "yes"), (3, "yesterday france of"), (4, "what is the"), (5, "the capital of France is Paris")]
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.find(*frames(spark, docs, items)).collect()) == [(1, 1), (1, 3), (2, 2), (5, 3), (5, 5)]
    assert [r["doc_id"] for r in decontam.drop(*frames(spark, docs, items)).orderBy("doc_id").collect()] == [3, 4]


def test_size_of_a_matcher():
    r = random.Random(1)
    items = [(k, " ".join(f"word{r.randint(0, 50_000)}" for _ in range(40))) for k in range(2500)]
    match = decontam.Matcher(items, 5, 0.8)
    held = sum(x.nbytes for x in [match.vocabulary, match.codes, match.first, match.second, *(y for s in match.sketch.values() for y in s)])
    assert held <= 8 * sum(len(t) for _, t in items)


def test_no_rows(spark, case):
    docs, items = case
    for d, i in (([], items), (docs, []), ([], []), (docs, [(1, None)]), ([(1, None)], items)):
        df, benchmark = frames(spark, d, i)
        assert decontam.find(df, benchmark).collect() == [] and decontam.drop(df, benchmark).count() == len(d)
