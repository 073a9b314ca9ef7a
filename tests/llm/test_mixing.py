"""Pareto mixing against targets found by brute force."""

import re

import pytest

from sparkweave.llm import mixing

FIELDS = "doc_id long, text string, source string, size long, rank double, row string, of string, target double, src long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 9, 0.5, "r", "o", 1.0, 3) for i, t, s in rows], FIELDS)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """sizes: words of each source, in order; the excess over the bound is shared anew until there is none."""
    w, total, fixed = [weights[k % len(weights)] for k in range(len(sizes))], share * sum(sizes), set()
    while True:
        level = (total - sum(epochs * sizes[k] for k in fixed)) / sum(w[k] for k in range(len(w)) if k not in fixed)
        above = {k for k in range(len(w)) if k not in fixed and w[k] * level > epochs * sizes[k]}
        if not above:
            return [epochs * sizes[k] if k in fixed else w[k] * level for k in range(len(w))]
        fixed |= above


@pytest.fixture(scope="module")
def rows():
    out = []
    for k in range(900):  # a hot source holds more than a third
        source = "hot" if k % 2 == 0 else [None, "b", "é", "Z", "zz"][k // 2 % 5]
        out.append((k, " ".join(["w"] * (1 + k * 37 % 53)), source))
    return [*out, (900, None, "b"), (901, "", None), (902, " \n\t", "Z"), (None, "no id here", "b"), (903, "x " * 5000, "hot")]


def test_targets_and_sample(spark, rows):
    got = mixing.mix(frame(spark, rows)).toPandas()
    assert len(got) == len(rows)
    assert sorted(got["size"]) == sorted(words(t) for _, t, _ in rows)
    names = sorted({s for *_, s in rows if s}, key=lambda s: s.encode()) + [None]
    sizes = [sum(words(t) for _, t, s in rows if s == n) for n in names]
    for name, size, target in zip(names, sizes, targets(sizes)):
        mine = got[got["source"].isna()] if name is None else got[got["source"] == name]
        assert set(mine["source_size"]) == {size} and mine["target"].iloc[0] == pytest.approx(target)
        assert abs(mine["taken"].sum() - target) <= 0.02 * target + 30
    assert (got["taken"] <= 2 * got["size"]).all() and set(got["copies"]) <= {0, 1, 2}
    assert (got.loc[got["size"] == 0, "taken"] == 0).all()


def test_reruns_agree_however_the_rows_lie(spark, rows):
    key = ["doc_id", "size", "taken"]
    a, b = (sorted(map(str, mixing.mix(df).select(*key).collect())) for df in (frame(spark, rows), frame(spark, rows[::-1]).repartition(5)))
    assert a == b


def test_repeat_keeps_columns(spark, rows):
    df = frame(spark, rows)
    out, taken = mixing.repeat(df), mixing.mix(df)
    assert out.dtypes == df.dtypes
    assert out.count() == sum(r["copies"] for r in taken.collect())
    assert set(out.distinct().collect()) <= set(df.collect())


@pytest.mark.parametrize("numbered", [300, 200_000])
def test_repeated_rows_meet_their_target(spark, monkeypatch, numbered):
    monkeypatch.setattr(mixing, "NUMBERED", numbered)
    rows = [(1, "w " * 10, "x")] * 2000 + [(2 + k, "w " * (1 + k % 9), ["x", "y", None][k % 3]) for k in range(300)] + [(None, "a b c", "y")] * 500
    one, two = (mixing.mix(df).toPandas() for df in (frame(spark, rows), frame(spark, rows[::-1]).repartition(7)))
    assert len(one) == len(rows)
    for _, mine in one.fillna({"source": "none"}).groupby("source"):
        assert abs(mine["taken"].sum() - mine["target"].iloc[0]) <= 11
    key = ["doc_id", "source", "size", "copies"]
    assert sorted(map(str, one[key].values.tolist())) == sorted(map(str, two[key].values.tolist()))
    assert mixing.repeat(frame(spark, rows)).count() == one["copies"].sum()


def test_large_documents_close_a_source_only_if_they_fit(spark):
    rows = [(1 + k, "w " * 1000, "x") for k in range(3)] + [(10 + k, "w " * (1 + k % 9), "x") for k in range(200)]
    for share in (0.1, 0.2, 0.5):
        got = mixing.mix(frame(spark, rows), share=share).toPandas()
        assert 0 < got["taken"].sum() <= got["target"].iloc[0] + 1000


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "one", "a")], [(None, None, None), (None, "a b", None)]])
def test_small_tables(spark, rows):
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and mixing.repeat(frame(spark, rows)).count() == sum(r["copies"] for r in got)


def test_inclusion_grows_with_size(spark):
    """Over many seeds, documents are taken in proportion to their size."""
    df = frame(spark, [(k, " ".join(["w"] * (2 + 4 * (k % 2))), "s") for k in range(400)])
    found = mixing.mix(df, share=0.5).toPandas()
    small, large = (found[found["size"] == n]["copies"].mean() for n in (2, 6))
    assert large == pytest.approx(3 * small, rel=0.35)
