"""The session, its lazy queries and its options."""

import asyncio
import functools
import http.server
import threading

import pyarrow as pa
import pytest
from conftest import plain

from sparkweave import Query, Session, Validator, prettify
from sparkweave.frame import chunked
from sparkweave.sources import files, readers
from sparkweave.streaming import events


@pytest.fixture()
def session(spark, folder):
    with Session(spark=spark.newSession()) as s:
        s.register_parquet("orders", f"{folder}/orders.parquet")
        s.register_parquet("customer", f"{folder}/customer.parquet")
        yield s


def test_batches_are_cut_to_the_limit(spark):
    assert [b.num_rows for b in chunked(pa.table({"a": list(range(8))}), 3)] == [3, 3, 2]
    query = Query(spark.range(8).coalesce(1), batch_size=3)
    assert [b.num_rows for b in query.collect()] == [3, 3, 2]
    assert [b.num_rows for b in Query(spark.range(8), 3).batches()] == [3, 3, 2]


def test_batches_as_an_async_stream(spark):
    async def lengths():
        stream = Query(spark.range(8), 3).batches()
        assert stream.schema.names == ["id"]
        return [b.num_rows async for b in stream]

    assert asyncio.run(lengths()) == [3, 3, 2]


def test_an_empty_result_is_remembered(session, monkeypatch):
    query = session.sql("SELECT * FROM orders WHERE 1 = 0")
    assert query.collect() == []
    monkeypatch.setattr(query, "df", None)
    assert query.collect() == []


def test_schema_plans_and_stages(session):
    query = session.sql("SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey ORDER BY n DESC")
    assert query.schema().names == ["c_nationkey", "n"]
    assert "Join" in query.logical_plan() and "Join" in query.optimized_logical_plan() and "Join" in query.execution_plan()
    assert "PushedFilters" in query.display_execution_plan()
    stages = query.stages()
    assert len(stages) >= 3 and stages[-1].child_stage_ids and all(s.num_output_partitions >= 1 for s in stages)
    assert all(child < s.stage_id for s in stages for child in s.child_stage_ids)
    assert query.stages() is stages


def test_results_agree_with_the_validator(session, folder):
    validator = Validator()
    validator.register_parquet("orders", f"{folder}/orders.parquet")
    text = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus ORDER BY o_orderstatus"
    rows = lambda batches: [plain(tuple(r.values())) for b in batches for r in b.to_pylist()]
    assert rows(session.sql(text).collect()) == rows(validator.collect_sql(text))


def test_show_prints_all_rows(session, capsys):
    session.sql("SELECT 1 AS a, NULL AS b, true AS c UNION ALL SELECT 22, 'x', false ORDER BY a").show()
    assert capsys.readouterr().out.strip().splitlines()[1:5] == ["| a  | b | c     |", "+----+---+-------+", "| 1  |   | true  |", "| 22 | x | false |"]
    assert prettify([]) == "++\n++"


def test_options(session):
    session.set("engine.execution.target_partitions", "7")
    assert session.get_target_partitions() == 7
    session.set("optimizer.enable_round_robin_repartition", "false")
    session.set("spark.sql.shuffle.partitions", "5")
    assert session.get_target_partitions() == 5
    with pytest.raises(ValueError, match="unknown option"):
        session.set("no.such.option", "1")


def test_views_statements_and_files(session, tmp_path):
    queries = session.run("CREATE VIEW v (k, n) AS SELECT o_orderstatus, count(*) FROM orders GROUP BY 1; SELECT ';' AS semi, k FROM v ORDER BY k; -- end;\n DROP VIEW v")
    assert len(queries) == 3 and queries[1].collect()[0].column("semi")[0].as_py() == ";"
    session.sql(f"COPY (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 9) TO '{tmp_path}/out' STORED AS CSV PARTITIONED BY (o_orderstatus)")
    session.sql(f"CREATE EXTERNAL TABLE few STORED AS CSV LOCATION '{tmp_path}/out'")
    assert sum(b.num_rows for b in session.sql("SELECT * FROM few").collect()) == 9
    with pytest.raises(ValueError, match="exists"):
        session.sql(f"CREATE EXTERNAL TABLE few STORED AS CSV LOCATION '{tmp_path}/out'")
    session.sql(f"CREATE EXTERNAL TABLE IF NOT EXISTS few STORED AS CSV LOCATION '{tmp_path}/out'")


def test_tables_of_files_change(session, tmp_path):
    name = f"changing_{tmp_path.name.replace('-', '_')}"
    rows = lambda: sorted(tuple(r) for r in session.sql(f"SELECT * FROM {name}").df.collect())
    session.sql(f"CREATE TABLE {name} USING parquet AS SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(k, x)")
    session.sql(f"INSERT INTO {name} VALUES (4, 'd')")
    session.sql(f"UPDATE {name} SET x = concat(x, '!'), k = k + 10 WHERE x = 'b' OR k = 4")
    assert rows() == [(1, "a"), (3, None), (12, "b!"), (14, "d!")]
    session.sql(f"DELETE FROM {name} WHERE x LIKE 'b%'")
    assert rows() == [(1, "a"), (3, None), (14, "d!")]
    session.sql(f"INSERT OVERWRITE TABLE {name} SELECT 9, 'z'")
    session.sql(f"UPDATE {name} SET x = NULL")
    assert rows() == [(9, None)]
    session.sql(f"DELETE FROM {name}")
    assert rows() == []
    session.sql(f"DROP TABLE {name}")


def test_sources(session, spark, folder, tmp_path):
    spark.range(3).write.json(f"{tmp_path}/j")
    session.register_json("j", f"{tmp_path}/j")
    assert sum(b.num_rows for b in session.sql("SELECT id FROM j").collect()) == 3
    with pa.OSFile(f"{tmp_path}/a.arrow", "wb") as file, pa.ipc.new_file(file, pa.schema([("x", pa.int64())])) as out:
        out.write_table(pa.table({"x": [1, None, 3]}))
    session.register_arrow("a", f"{tmp_path}/a.arrow")
    assert session.sql("SELECT sum(x) AS s FROM a").collect()[0].column("s")[0].as_py() == 4
    (tmp_path / "c.csv").write_text("a,b\n1,x\n,y\n")
    session.register_csv("c", f"{tmp_path}/c.csv")
    assert session.sql("SELECT a, b FROM c ORDER BY b").collect()[0].to_pylist() == [{"a": 1, "b": "x"}, {"a": None, "b": "y"}]
    session.register_listing_table("l", folder, "region.parquet")
    assert sum(b.num_rows for b in session.sql("SELECT * FROM l").collect()) == 5


def test_close_drops_own_tables(spark, folder):
    session = Session(spark=spark.newSession())
    session.register_parquet("mine", f"{folder}/region.parquet")
    session.close()
    assert not session.spark.catalog.tableExists("mine")


def test_columns_of_one_name_stay_apart(session):
    query = session.sql("SELECT 1 AS a, 2 AS a, 'x' AS b, CAST('2024-01-02 03:04:05' AS TIMESTAMP) AS t, array(1, NULL) AS l, named_struct('k', 1.50BD) AS s UNION ALL SELECT 3, 4, NULL, NULL, NULL, named_struct('k', 2.50BD)")
    streamed = list(query.batches())
    assert pa.Table.from_batches(streamed).equals(pa.Table.from_batches(query.collect()))
    assert sorted(streamed[0].column(1).to_pylist() + [v for b in streamed[1:] for v in b.column(1).to_pylist()]) == [2, 4]


def test_a_view_is_replaced_only_on_request(session):
    session.sql("CREATE VIEW v AS SELECT 1 AS a")
    with pytest.raises(ValueError, match="exists"):
        session.sql("CREATE VIEW v AS SELECT 2 AS a")
    session.sql("CREATE OR REPLACE VIEW v AS SELECT 3 AS a")
    assert session.sql("SELECT a FROM v").df.collect() == [(3,)]


def test_explain_analyze_measures_the_query(session):
    text = session.sql("EXPLAIN ANALYZE SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus").df.first()[0]
    orders, groups = session.table("orders").df.count(), session.sql("SELECT DISTINCT o_orderstatus FROM orders").df.count()
    scan, last = next(line for line in text.splitlines() if "FileScan parquet" in line), text.splitlines()[-1]
    assert f"numOutputRows={orders}" in scan and last == f"output rows: {groups}" and text.count("HashAggregate") == 2


def test_unbounded_external_tables(session, spark, tmp_path):
    spark.range(5).selectExpr("id AS k", "id * 2 AS v").write.parquet(str(tmp_path / "in"))
    session.sql(f"CREATE UNBOUNDED EXTERNAL TABLE grows STORED AS PARQUET LOCATION '{tmp_path}/in'")
    df = session.sql("SELECT k, v + 1 AS w FROM grows WHERE k > 1").df
    assert df.isStreaming
    for _ in range(2):  # the second run sees only what is new
        events.write(df, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
        spark.range(7, 8).selectExpr("id AS k", "id * 2 AS v").write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(2, 5), (3, 7), (4, 9), (7, 15)]
    with pytest.raises(ValueError, match="no stream"):
        session.sql(f"CREATE UNBOUNDED EXTERNAL TABLE other STORED AS ARROW LOCATION '{tmp_path}/in'")


def test_arrow_files_are_read_by_batch(session, spark, tmp_path):
    table = pa.table({"a": list(range(10)), "b": [None, "x"] * 5})
    for name, new in (("one.arrow", pa.ipc.new_file), ("two.arrows", pa.ipc.new_stream)):
        with new(str(tmp_path / name), table.schema) as out:
            out.write_table(table, max_chunksize=3)
    with pa.ipc.new_file(str(tmp_path / "empty.arrow"), table.schema):
        pass
    df = readers.arrow(spark, str(tmp_path))
    assert sorted(r["a"] for r in df.collect()) == sorted(2 * list(range(10))) and df.columns == ["a", "b"]
    assert readers.arrow(spark, str(tmp_path / "empty.arrow")).collect() == []


def test_files_over_http(session, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "t.json").write_text('{"a": 1}\n{"a": 2}\n')
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        session.register_csv("remote", f"http://127.0.0.1:{server.server_port}/t.csv")
        session.register_json("remote_json", f"http://127.0.0.1:{server.server_port}/t.json")
        assert sorted(map(tuple, session.sql("SELECT a, b FROM remote").df.collect())) == [(1, "x"), (2, "y")]
        assert session.sql("SELECT sum(a) AS n FROM remote_json").df.collect() == [(3,)]
        server.shutdown()


def test_files_helper(tmp_path):
    at = f"file://{tmp_path}/x"
    assert files.names(at) == [] and files.marked(at) == [] and not files.exists(at)
    for name in ("b/_SUCCESS", "a/_SUCCESS", "c/part", "d/e/_SUCCESS"):
        files.write(f"{at}/{name}")
    assert files.names(at) == ["a", "b", "c", "d"] and files.marked(at) == ["a", "b"]
    files.remove(f"{at}/a")
    files.remove(f"{at}/a")
    assert files.marked(at) == ["b"] and files.exists(f"{at}/c/part")
