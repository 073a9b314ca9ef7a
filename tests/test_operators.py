"""Operators on tiny frames with nulls, ties and no rows; streams against tables."""

import pytest
from pyspark.sql import functions as F

from sparkweave.operators import aggregates, joins, scalars, sets, sorts, windows
from sparkweave.streaming import events


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (2, "c")], "k int, x string")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "j int, y string")


@pytest.mark.parametrize("kind, n", [("inner", 2), ("left", 4), ("right", 4), ("full", 6), ("left_semi", 2), ("left_anti", 2), ("right_semi", 1), ("right_anti", 2), ("cross", 12), ("left outer", 4)])
def test_join_kinds(left, right, kind, n):
    assert joins.join(left, right, F.col("k") == F.col("j"), kind).count() == n


def test_mark_and_null_safe(left, right):
    assert rows(joins.join(left, right, F.col("k") == F.col("j"), "left_mark").select("x", "mark")) == [("a", False), ("b", True), ("c", True), ("n", False)]
    assert left.join(right, joins.null_safe(F.col("k"), F.col("j"))).count() == 3


def test_salted_join_is_a_join(left, right):
    a, b = left, right.withColumnRenamed("j", "k")
    for kind in ("inner", "left", "left_semi", "left_anti"):
        assert rows(joins.salted(a, b, "k", 3, kind)) == rows(a.join(b, "k", kind))
    with pytest.raises(ValueError):
        joins.salted(a, b, "k", 3, "full")


def test_not_in_with_a_null_is_empty(spark):
    assert spark.sql("SELECT * FROM VALUES (1), (2) AS v(a) WHERE a NOT IN (SELECT * FROM VALUES (1), (NULL) AS w(b))").isEmpty()


def test_groups_frame(spark):
    df = spark.createDataFrame([("p", 1, 10), ("p", 1, 1), ("p", 5, 100), ("p", None, 7), ("q", 2, 3)], "g string, o int, v int")
    got = windows.groups_frame(df, "s", F.sum("v"), ["o"], 1, 0, ["g"])
    assert rows(got.select("g", "o", "s")) == sorted([("p", None, 7), ("p", 1, 18), ("p", 1, 18), ("p", 5, 111), ("q", 2, 3)], key=str)


def test_top_per_group_and_distinct_on(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", None)], "k string, v int")
    assert rows(windows.top_per_group(df, ["k"], [F.desc("v")], 2)) == [("a", 2), ("a", 3), ("b", None)]
    assert rows(windows.distinct_on(df.limit(0), ["k"], ["v"])) == []


def test_sorted_aggregates(spark):
    df = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (1, None, 3), (2, "z", 1)], "k int, v string, o int")
    out = df.groupBy("k").agg(aggregates.array_agg("v", "o").alias("a"), aggregates.string_agg("v", "-", "o", descending=True).alias("s"), aggregates.first_by("v", "o").alias("f"), aggregates.last_by("v", "o").alias("l"))
    assert rows(out) == [(1, ["y", "x", None], "x-y", "y", None), (2, ["z"], "z", "z", "z")]


def test_sets(spark):
    a, b = spark.createDataFrame([(1,), (1,), (None,), (2,)], "x int"), spark.createDataFrame([(1,), (None,), (None,)], "x int")
    want = {("union", True): 7, ("union", False): 3, ("intersect", True): 2, ("intersect", False): 2, ("except", True): 2, ("except", False): 1}
    assert {k: sets.combine(a, b, *k).count() for k in want} == want
    with pytest.raises(ValueError):
        sets.combine(a, b, "minus")


def test_unnest_without_nulls(spark):
    df = spark.sql("SELECT * FROM VALUES (1, array(1, NULL)), (2, CAST(NULL AS array<int>)), (3, CAST(array() AS array<int>)) AS v(id, x)")
    assert rows(sets.unnest(df, ["x"], preserve_nulls=False)) == [(1, 1), (1, None)]
    assert rows(sets.unnest(df, ["x"])) == [(1, 1), (1, None), (2, None), (3, None)]


def test_sort_keys(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    order = lambda key: [r[0] for r in sorts.top(df, 3, key).collect()]
    assert order(sorts.key("x")) == [1, 3, None] and order(sorts.key("x", True)) == [None, 3, 1]
    assert order(sorts.key("x", nulls_first=True)) == [None, 1, 3] and order(sorts.key("x", True, False)) == [3, 1, None]


def test_truth(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    b = F.col("b")
    assert [tuple(r) for r in df.select(scalars.is_true(b), scalars.is_not_true(b), scalars.is_unknown(b), scalars.is_distinct_from(b, F.lit(None))).collect()] == [(True, False, False, True), (False, True, False, True), (False, True, True, False)]
    assert df.select(scalars.trunc(F.lit(-2.79), 1)).first()[0] == -2.7


def test_stream_windows_agree_with_the_table(spark, folder, tmp_path):
    table = spark.read.parquet(f"{folder}/events.parquet")
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events.read(spark, f"{tmp_path}/in", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", 1)
    counts = lambda df: events.windowed(df, "1 day", F.count("*").alias("n"), keys=("event_type",), late="60 days")
    query = counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(spark.table("counts")) == rows(counts(table))


def test_stream_to_files_once(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        events.write(events.read(spark, f"{tmp_path}/in", "id long"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10


def test_matched_events(spark):
    a = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00'), (2, timestamp'2024-01-01 00:00:00') AS v(u, t)")
    b = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:05:00'), (2, timestamp'2024-01-01 02:00:00') AS v(w, s)")
    assert events.matched(a, b, "u", "w", "t", "s", "10 minutes", "1 hour").count() == 1
