"""Scans, sinks, projections, filters, joins and subqueries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.operators import joins, scalars
from sparkweave.plans.registry import Registry
from sparkweave.plans.tables import Tables
from sparkweave.session import Session
from sparkweave.sources import files, readers, writers
from sparkweave.sources.shared import shared_dir

R = Registry()
c = F.col


def scratch(t: Tables, name: str) -> str:
    """A new folder to write to, below the shared one."""
    return f"{shared_dir(t.spark)}/sparkweave/{name}-{uuid.uuid4().hex[:8]}"


# scans and sinks
R.sql("scan_parquet", "SELECT r_regionkey, r_name FROM region")
R.sql("scan_parquet_pruned", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 490000 AND o_orderstatus = 'F'")
R.sql("values_relation", "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) AS v(id, name)")
R.sql("empty_relation", "SELECT n_nationkey, n_name FROM nation WHERE 1 = 0")

_NATIONS, _ORDERS = "SELECT n_nationkey, n_name, n_regionkey FROM nation", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"


def _orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")


@R.plan("scan_listing_dir", _NATIONS)
def _listing(t: Tables) -> DataFrame:
    at = scratch(t, "listing")
    writers.write(t.nation, at)
    session = Session(spark=t.spark)
    session.register_listing_table("nation_files", at, "parquet")
    return session.sql("SELECT n_nationkey, n_name, n_regionkey FROM nation_files").df


@R.plan("scan_csv_roundtrip", _NATIONS)
def _csv_inferred(t: Tables) -> DataFrame:
    at = scratch(t, "csv")
    writers.write(t.nation, at, "csv")
    return readers.csv(t.spark, at)


@R.plan("scan_arrow_ipc", "SELECT r_regionkey, r_name FROM region")
def _arrow(t: Tables) -> DataFrame:
    """A table of five rows as an Arrow IPC file, written by the driver."""
    import pyarrow as pa

    table, sink = t.region.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    at = scratch(t, "ipc") + ".arrow"
    files.write(at, sink.getvalue().to_pybytes())
    return readers.arrow(t.spark, at)


@R.plan("scan_external_table", _NATIONS)
def _external(t: Tables) -> DataFrame:
    at, name = scratch(t, "external"), f"ext_{uuid.uuid4().hex[:8]}"
    writers.write(t.nation, at, "csv")
    session = Session(spark=t.spark)
    session.sql(f"CREATE EXTERNAL TABLE {name} (n_nationkey INT, n_name STRING, n_regionkey INT) STORED AS CSV WITH HEADER ROW LOCATION '{at}'")
    return session.table(name).df


@R.plan("sink_parquet_roundtrip", _ORDERS)
def _parquet(t: Tables) -> DataFrame:
    at = scratch(t, "parquet")
    writers.write(_orders(t), at, compression="zstd")
    return readers.parquet(t.spark, at)


@R.plan("sink_csv_roundtrip", _ORDERS)
def _csv(t: Tables) -> DataFrame:
    at = scratch(t, "csv")
    writers.write(_orders(t), at, "csv", compression="gzip")
    return readers.csv(t.spark, at, "o_orderkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE")


@R.plan("sink_json_roundtrip", _ORDERS)
def _json(t: Tables) -> DataFrame:
    at = scratch(t, "json")
    writers.write(_orders(t), at, "json")
    return readers.json(t.spark, at, "o_orderkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE")


@R.plan("sink_partitioned", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _partitioned(t: Tables) -> DataFrame:
    """Written by a column, whose folders alone are read back."""
    at = scratch(t, "parts")
    writers.write(_orders(t), at, partition_by=["o_orderstatus"])
    return readers.listing(t.spark, at).where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus", "o_totalprice")


@R.plan("sink_append_overwrite", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def _modes(t: Tables) -> DataFrame:
    at = scratch(t, "modes")
    writers.write(t.nation, at)
    writers.write(t.region, at, mode="overwrite")
    writers.write(t.region, at, mode="append")
    return readers.parquet(t.spark, at)


@R.plan("sink_copy_to", _ORDERS)
def _copy(t: Tables) -> DataFrame:
    at, session = scratch(t, "copy"), Session(spark=t.spark)
    session.register_dataframe("all_orders", _orders(t))
    session.sql(f"COPY (SELECT * FROM all_orders) TO '{at}' STORED AS PARQUET OPTIONS ('compression' 'zstd')")
    return readers.parquet(t.spark, at)


@R.plan("dml_statements", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT 99, 'new', 4")
def _dml(t: Tables) -> DataFrame:
    """CREATE TABLE AS, INSERT, UPDATE and DELETE; the table goes once its rows are on their way."""
    session, name, at = Session(spark=t.spark), f"dml_{uuid.uuid4().hex[:8]}", scratch(t, "dml")
    session.register_dataframe("all_nations", t.nation)
    session.run(f"CREATE TABLE {name} USING parquet AS SELECT * FROM all_nations; INSERT INTO {name} VALUES (99, 'new', 4); UPDATE {name} SET n_name = upper(n_name) || '!' WHERE n_regionkey = 1; DELETE FROM {name} WHERE n_regionkey = 0")
    writers.write(t.spark.table(name), at)
    session.sql(f"DROP TABLE {name}")
    return readers.parquet(t.spark, at)


# projections and filters
R.sql("project_expr", "SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS twice, -l_quantity AS negative, l_linenumber % 3 AS rest, l_returnflag || '-' || l_linestatus AS flags FROM lineitem")
R.sql("project_bits", "SELECT l_linenumber, l_linenumber & 3 AS both_bits, l_linenumber | 8 AS any_bits, l_linenumber << 2 AS shifted, l_linenumber >> 1 AS halved, count(*) AS n FROM lineitem GROUP BY l_linenumber")
R.sql("filter_compare", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 300000 AND o_totalprice <> 300001 AND NOT (o_orderstatus = 'O')")
R.sql("filter_between", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-02-01'", None)
R.sql("filter_in", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 21) AND p_type IN ('PROMO', 'SMALL')")
R.sql("filter_not_in", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3, 4, 5) AND p_type NOT IN ('PROMO', 'SMALL', 'LARGE')")
R.sql("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' OR p_name LIKE 'sm_ll%'")
R.sql("filter_not_like", "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%r%'")
R.sql("filter_ilike", "SELECT p_partkey FROM part WHERE p_name ILIKE '%RING%'")
R.sql("filter_similar_to", "SELECT p_partkey, p_name FROM part WHERE p_name SIMILAR TO '(small|blue) (ring|b_lt)%'", "SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, '(small|blue) (ring|b.lt).*')")
_HOLES = "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 3 = 1 END AS flag, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 5 END AS five FROM orders)"
R.sql("filter_null_tests", f"SELECT o_orderkey, five IS NULL AS absent, five IS NOT NULL AS present FROM {_HOLES} AS h WHERE flag IS NOT NULL OR five IS NULL")
R.sql("filter_truth_tests", f"SELECT o_orderkey, flag IS TRUE AS t, flag IS FALSE AS f, flag IS NULL AS u, flag IS NOT TRUE AS nt, flag IS NOT FALSE AS nf FROM {_HOLES} AS h")
R.sql("filter_distinct_from", f"SELECT o_orderkey FROM {_HOLES} AS h WHERE five IS DISTINCT FROM 2 AND five IS NOT DISTINCT FROM five")
R.sql("filter_disjunction", "SELECT count(*) AS n FROM lineitem, part WHERE (p_partkey = l_partkey AND p_size < 5 AND l_quantity < 10) OR (p_partkey = l_partkey AND p_size > 45 AND l_quantity > 40)")
R.sql("case_simple", "SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
R.sql("case_searched", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' END AS size_class FROM part")
R.sql("cast", "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS as_text, CAST(o_custkey AS INT) AS as_int, CAST(o_orderdate AS DATE) AS as_date, CAST('12' AS BIGINT) AS as_long FROM orders")
R.sql("try_cast", "SELECT n_nationkey, TRY_CAST(split_part(n_name, '_', 2) AS INT) AS number, TRY_CAST(n_name AS INT) AS none FROM nation")
R.sql("interval_arith", "SELECT o_orderkey, o_orderdate + INTERVAL '3' MONTH AS quarter_on, o_orderdate - INTERVAL '90' DAY AS before, o_orderdate + INTERVAL '1' YEAR AS next_year FROM orders")
R.sql("project_alias_wildcard", "SELECT n.*, n.n_name AS again FROM nation AS n")


@R.plan("filter_similar_to_column", "SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '(red|green) .*')")
def _similar(t: Tables) -> DataFrame:
    return t.part.where(scalars.similar_to(c("p_name"), "(red|green) %")).select("p_partkey")


# joins
_PAIR = "SELECT n_nationkey AS k, n_name FROM nation"
_LEFT, _RIGHT = f"({_PAIR})", "(SELECT r_regionkey * 7 AS k, r_name FROM region)"
R.sql("join_inner", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 3")
for _kind in ("left", "right", "full"):
    R.sql(f"join_{_kind}", f"SELECT a.k AS lk, a.n_name, b.k AS rk, b.r_name FROM {_LEFT} AS a {_kind.upper()} OUTER JOIN {_RIGHT} AS b ON a.k = b.k")
R.sql("join_left_residual", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000")
R.sql("join_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 400000)")
R.sql("join_semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)")
R.sql("join_anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
R.sql("join_anti_not_in", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
R.sql("join_anti_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey = 0 THEN NULL ELSE r_regionkey END FROM region)")
R.sql("join_semi_residual", "SELECT a.l_orderkey, a.l_linenumber FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey AND b.l_quantity > a.l_quantity)")
R.sql("join_anti_residual", "SELECT a.l_orderkey, a.l_linenumber FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey AND b.l_quantity > a.l_quantity)")
R.sql("join_mark_or", "SELECT c_custkey FROM customer WHERE c_acctbal > 9800 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)")
R.sql("join_self", "SELECT a.n_name AS one, b.n_name AS other FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
R.sql("join_composite_key", "SELECT a.l_partkey, a.l_suppkey, count(*) AS n FROM lineitem a JOIN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity = 50) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey GROUP BY a.l_partkey, a.l_suppkey")
R.sql("join_using", f"SELECT k, n_name, r_name FROM {_LEFT} AS a JOIN {_RIGHT} AS b USING (k)")
R.sql("join_natural", f"SELECT k, n_name, r_name FROM {_LEFT} AS a NATURAL JOIN {_RIGHT} AS b")
R.sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
R.sql("join_theta", "SELECT a.n_nationkey AS low, b.r_regionkey AS high FROM nation a JOIN region b ON a.n_nationkey < b.r_regionkey")
R.sql("join_null_safe", "SELECT a.x AS ax, b.x AS bx FROM (VALUES (1), (NULL), (2)) a(x) JOIN (VALUES (NULL), (2), (3)) b(x) ON a.x IS NOT DISTINCT FROM b.x")
R.sql("join_lateral", "SELECT r_name, top.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_nationkey LIMIT 2) AS top")
_BY_NATION = "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
for _strategy in ("broadcast", "shuffle_hash", "merge"):

    def _hinted(t: Tables, strategy=_strategy) -> DataFrame:
        sized = joins.with_strategy(t.nation, strategy)
        return joins.join(t.customer, sized, c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))

    R.plan("join_sort_merge" if _strategy == "merge" else f"join_{_strategy}", _BY_NATION)(_hinted)


@R.plan("join_right_semi", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def _right_semi(t: Tables) -> DataFrame:
    return joins.join(t.supplier.where("s_acctbal < 0"), t.nation, c("s_nationkey") == c("n_nationkey"), "right_semi").select("n_nationkey", "n_name")


@R.plan("join_right_anti", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def _right_anti(t: Tables) -> DataFrame:
    return joins.join(t.supplier.where("s_acctbal < 0"), t.nation, c("s_nationkey") == c("n_nationkey"), "right_anti").select("n_nationkey", "n_name")


@R.plan("join_left_mark", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) AS mark FROM customer")
def _mark(t: Tables) -> DataFrame:
    return joins.join(t.customer.select("c_custkey"), t.orders.where("o_totalprice > 450000"), [("c_custkey", "o_custkey")], "left_mark")


@R.plan("join_salted", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _salted(t: Tables) -> DataFrame:
    left, right = t.customer.withColumnRenamed("c_nationkey", "k"), t.nation.withColumnRenamed("n_nationkey", "k")
    return joins.salted(left, right, "k").groupBy("n_name").agg(F.count("*").alias("n"))


# subqueries
R.sql("subq_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")
R.sql("subq_scalar_correlated", "SELECT p_partkey FROM part p WHERE p_retailprice = (SELECT max(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)")
R.sql("subq_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT count(*) / 1000.0 + 3 FROM orders)")
R.sql("subq_nested_in", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) AND l_quantity > 48)")
R.sql("derived_table_alias", "SELECT n, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) AS c_orders (who, n) GROUP BY n")
_EARNED = "SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_suppkey"
R.sql(
    "view_create_query_drop",
    "CREATE VIEW earned (supplier_no, total) AS SELECT l_suppkey, round(sum(l_extendedprice), 2) FROM lineitem GROUP BY l_suppkey; SELECT supplier_no, total FROM earned",
    _EARNED,
)
R.sql("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 400000), each AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM each GROUP BY n")
R.sql("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
