"""Ordinal regression: held-out accuracy, ordered thresholds, and odd rows."""

import os
import random
import re

import numpy as np
import pytest

from sparkweave.llm import toxicity

FIELDS = "doc_id long, text string, toxic int, grade string, labelled long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "g", 1) for i, t in rows], FIELDS)


def made(n, seed):
    """Documents of common words, a third with rude ones among them: how many says how toxic."""
    r, rude = random.Random(seed), ["vile", "awful", "nasty", "hateful", "brutal", "cruel"]
    out = []
    for k in range(n):
        words = [f"w{int(r.paretovariate(0.7)) % 500}" for _ in range(r.randint(10, 200))]
        toxic = int(k % 3 == 0)
        for _ in range(r.randint(2, 14) * toxic):
            words.insert(r.randint(0, len(words)), r.choice([str.upper, str.lower, "{}!".format])(r.choice(rude)))
        out.append((k, " ".join(words), toxic))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = made(900, 1)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (1, None), (10**9, 1)], "doc_id long, toxic int")
    return toxicity.train(frame(spark, [(i, t) for i, t, _ in rows]), labels)


def test_held_out(spark, model):
    rows = made(600, 2)
    got = {r["doc_id"]: r for r in toxicity.grade(frame(spark, [(i, t) for i, t, _ in rows]), model).collect()}
    wrong = [i for i, _, t in rows if got[i]["rejected"] != bool(t)]
    assert len(wrong) <= 12
    hits = [sum(w.strip("!").lower() in ("vile", "awful", "nasty", "hateful", "brutal", "cruel") for w in text.split()) for _, text, _ in rows]
    severity = [got[i]["severity"] for i, *_ in rows]
    assert np.corrcoef(hits, severity)[0, 1] > 0.8 and 0 <= min(severity) and max(severity) <= 3
    assert {r["grade"] for r in got.values()} == {0, 1, 2, 3}


def test_thresholds_share_the_weights(model):
    assert (np.diff(model.cuts) > 0).all()
    above = model.above(np.linspace(-5, 30, 50))
    assert (np.diff(above, axis=1) < 0).all() and (np.diff(above, axis=0) > 0).all()


def test_rows_without_words(spark, model):
    rows = [(1, None), (2, ""), (2, ""), (None, "vile nasty cruel brutal vile awful"), (3, "w1 " * 60_000)]
    got = toxicity.grade(frame(spark, rows), model).collect()
    assert [r["rejected"] for r in got] == [False, False, False, True, False] and got[0]["severity"] == got[1]["severity"]
    df = frame(spark, rows)
    kept = toxicity.drop(df, model)
    assert kept.dtypes == df.dtypes and kept.count() == 4
    assert toxicity.grade(frame(spark, []), model).collect() == [] and toxicity.drop(frame(spark, []), model).collect() == []


def test_gradient_and_likelihood():
    """Against the likelihood written out document by document, and finite differences of it."""
    r = np.random.default_rng(0)
    dense = r.normal(size=(12, 5)) * (r.random((12, 5)) < 0.6)
    x, grade, weight = (*np.nonzero(dense), dense[np.nonzero(dense)]), r.integers(0, 4, 12), r.random(12)

    def plain(theta):
        cuts = [theta[5], theta[5] + np.exp(theta[6]), theta[5] + np.exp(theta[6]) + np.exp(theta[7])]
        total = 0.03 * (theta[:5] ** 2).sum() / 2
        for row, g, w in zip(dense, grade, weight):
            above = [1.0, *[1 / (1 + np.exp(c - row @ theta[:5])) for c in cuts], 0.0]
            total -= w * np.log(above[g] - above[g + 1])
        return total

    theta = r.normal(size=8)
    value, gradient = toxicity.objective(theta, x, grade, weight, 4, 0.03)
    assert value == pytest.approx(plain(theta))
    for k in range(8):
        step = np.eye(8)[k] * 1e-5
        assert gradient[k] == pytest.approx((plain(theta + step) - plain(theta - step)) / 2e-5, rel=1e-4, abs=1e-7)


def test_grades_of_training_documents_are_thirds_of_their_peers():
    score, length = np.random.default_rng(1).normal(size=100), np.arange(100) * 7 % 100
    got, by_length = toxicity._thirds(score * (1 + length), length), np.argsort(np.arange(100) * 7 % 100)
    for peers in np.array_split(by_length, 3):
        order = peers[np.argsort((score * (1 + length))[peers])]
        assert (np.diff(got[order]) >= 0).all() and np.bincount(got[peers], minlength=4)[1:].min() >= 11


def test_query_against_a_plain_version(spark, model):
    rows = [(i, t) for i, t, _ in made(200, 4)] + [(None, None), (7, ""), (8, "Vile VILE\tvile2 cruel_cruel é")]
    got = sorted(((r["doc_id"], round(r["severity"], 9), r["grade"], round(r["p_toxic"], 9), r["rejected"]) for r in toxicity.grade(frame(spark, rows), model).collect()), key=str)
    want = []
    for i, text in rows:
        words = [w for w in re.split(r"[\W\d_]+", (text or "").lower()) if w]
        score = sum(model.weights.get(w, 0.0) for w in words) * 50 / (len(words) + 90)
        above = [1 / (1 + np.exp(c - score)) for c in model.cuts]
        want.append((i, round(sum(above), 9), (above[0] >= 0.25) * (1 + sum(p >= 0.5 for p in above[1:])), round(above[0], 9), above[0] >= 0.25))
    assert [g[0] for g in got] == [w[0] for w in sorted(want, key=str)]
    for g, w in zip(got, sorted(want, key=str)):
        assert g[1] == pytest.approx(w[1], abs=1e-7) and g[2] == w[2] and g[4] == w[4]


def test_grades_do_not_follow_length(spark):
    """Rude words in proportion to length, with a density that differs: each grade is given, to texts of like length."""
    r, rude, rows = random.Random(6), ["vile", "awful", "nasty", "hateful"], []
    for k in range(1500):
        n, density = r.randint(100, 1500), r.uniform(0.01, 0.05) if k % 3 == 0 else 0
        rows.append((k, " ".join(r.choice(rude) if r.random() < density else f"w{int(r.paretovariate(0.7)) % 500}" for _ in range(n)), int(k % 3 == 0)))
    df = frame(spark, [(i, t) for i, t, _ in rows])
    found = toxicity.grade(df, toxicity.train(df, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"))).toPandas()
    found["n"] = [len(t) for _, t, _ in rows]
    toxic = found[found["doc_id"] % 3 == 0]
    means = toxic[toxic["grade"] > 0].groupby("grade")["n"].mean()
    assert list(means.index) == [1, 2, 3] and means.max() <= 1.2 * means.min() and (toxic["grade"] > 0).mean() > 0.97


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1)], [(None, 1)], [(5, None)]])
def test_without_labels_of_both_classes(spark, labels):
    df = frame(spark, [(1, "a b"), (2, None)])
    none = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert none is None and toxicity.drop(df, none).count() == 2
    assert all(r["severity"] == 0 and r["grade"] == 0 and not r["rejected"] for r in toxicity.grade(df, none).collect())


def test_the_bound_on_labelled_rows_holds(spark):
    rows = made(300, 3)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    df = frame(spark, [(i, t) for i, t, _ in rows])
    small = toxicity.train(df, labels, per_class=40)
    again = toxicity.train(df.repartition(3), labels.repartition(2), per_class=40)
    assert small.weights == again.weights and (small.cuts == again.cuts).all()


def test_the_model_is_fitted_by_a_task(spark, monkeypatch, tmp_path):
    """The driver gets the model, the same as of a fit by hand, but no texts."""

    def noted(*args, fit=toxicity.fit):
        (tmp_path / str(os.getpid())).touch()
        return fit(*args)

    rows = made(300, 5)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    want = toxicity.fit([t for _, t, _ in rows], [t for *_, t in rows], (200 / 300, 100 / 300))
    monkeypatch.setattr(toxicity, "fit", noted)
    got = toxicity.train(frame(spark, [(i, t) for i, t, _ in reversed(rows)]), labels)
    assert got.weights == want.weights and (got.cuts == want.cuts).all()
    assert (fitted := [p.name for p in tmp_path.iterdir()]) and str(os.getpid()) not in fitted


def test_driver_tables(spark, folder):
    """On half of the labelled documents, hold out the other half."""
    larger = folder.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    test = labels.where("doc_id % 2 = 1").join(toxicity.grade(docs, model), "doc_id").toPandas()
    toxic = test["toxic"] == 1
    assert test.loc[toxic, "rejected"].mean() >= 0.75 and test.loc[~toxic, "rejected"].mean() <= 0.01
