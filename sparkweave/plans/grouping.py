"""Aggregates, windows, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.operators import aggregates, sets, sorts, windows
from sparkweave.plans.registry import Registry
from sparkweave.plans.tables import Tables

R = Registry()
c = F.col

# aggregates
R.sql("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 6) AS mean FROM orders")
R.sql("agg_global_empty", "SELECT count(*) AS n, sum(o_totalprice) AS total, min(o_orderkey) AS low FROM orders WHERE o_orderkey < 0")
R.sql("agg_group", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
R.sql("agg_multi_key", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber")
R.sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15 AND max(o_totalprice) > 100000")
R.sql("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities, count(*) AS n FROM orders GROUP BY o_orderstatus")
R.sql("agg_sum_distinct", "SELECT l_returnflag, sum(DISTINCT l_linenumber) AS numbers FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, sum(DISTINCT l_linenumber)::BIGINT AS numbers FROM lineitem GROUP BY l_returnflag")
R.sql("agg_filter_clause", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 250000) AS large, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS urgent FROM orders GROUP BY o_orderstatus")
R.sql("agg_two_level", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) AS x GROUP BY n")
R.sql("agg_ratio", "SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 8) AS part FROM lineitem GROUP BY l_returnflag")
_G = "count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY"
R.sql("agg_grouping_sets", f"SELECT l_returnflag, l_linestatus, {_G} GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
R.sql("agg_cube", f"SELECT l_returnflag, l_linestatus, {_G} CUBE (l_returnflag, l_linestatus)")
R.sql("agg_rollup", f"SELECT l_returnflag, l_linestatus, {_G} ROLLUP (l_returnflag, l_linestatus)")
R.sql("agg_grouping_fn", f"SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS no_flag, CAST(grouping(l_linestatus) AS BIGINT) AS no_status, {_G} CUBE (l_returnflag, l_linestatus)")
R.sql("agg_stats", "SELECT l_returnflag, " + ", ".join(f"round({f}(l_quantity), 6) AS {f}_q" for f in ("stddev", "stddev_pop", "stddev_samp", "var_pop", "var_samp", "variance")) + ", " + ", ".join(f"round({f}(l_quantity, l_extendedprice), 6) AS {f}_qp" for f in ("corr", "covar_pop", "covar_samp")) + " FROM lineitem GROUP BY l_returnflag")
R.sql("agg_regr", "SELECT l_returnflag, " + ", ".join(f"round({f}(l_extendedprice, l_quantity), 4) AS {f}_x" for f in ("regr_avgx", "regr_avgy", "regr_intercept", "regr_r2", "regr_slope", "regr_sxx")) + ", regr_count(l_extendedprice, l_quantity) AS pairs, round(regr_sxy(l_extendedprice, l_quantity) / 1000, 3) AS sxy, round(regr_syy(l_extendedprice, l_quantity) / 1000000, 3) AS syy FROM lineitem GROUP BY l_returnflag")
R.sql("agg_bit_bool", "SELECT l_returnflag, bit_and(l_orderkey) AS a, bit_or(l_orderkey) AS o, bit_xor(l_orderkey) AS x, bool_and(l_quantity > 0) AS all_pos, bool_or(l_quantity > 49) AS any_large FROM lineitem GROUP BY l_returnflag")
R.sql("agg_median", "SELECT o_orderstatus, median(o_totalprice) AS middle FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(median(o_totalprice), 6) AS middle FROM orders GROUP BY o_orderstatus")
R.sql("agg_percentile", "SELECT l_returnflag, round(percentile(l_quantity, 0.9), 6) AS p90, round(percentile(l_extendedprice, 0.25), 4) AS p25 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25 FROM lineitem GROUP BY l_returnflag")
R.sql("agg_first_last", "SELECT o_custkey, min_by(o_orderkey, o_totalprice) AS cheapest, max_by(o_orderkey, o_totalprice) AS dearest FROM orders GROUP BY o_custkey")
R.sql("agg_ordered", "SELECT o_custkey, array_agg(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS ks, string_agg(o_orderstatus, ',' ORDER BY o_orderdate, o_orderkey) AS statuses, first_value(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_key FROM orders GROUP BY o_custkey", "SELECT o_custkey, array_agg(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS ks, string_agg(o_orderstatus, ',' ORDER BY o_orderdate, o_orderkey) AS statuses, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_key FROM orders GROUP BY o_custkey")
R.sql("agg_string_within_group", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
R.sql("agg_approx_distinct", "SELECT o_orderstatus, abs(approx_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.1 * count(DISTINCT o_custkey) AS near FROM orders GROUP BY o_orderstatus", "SELECT DISTINCT o_orderstatus, true AS near FROM orders")
_NEAR = "SELECT DISTINCT l_returnflag, true AS near FROM lineitem"
R.sql("agg_approx_percentile", "SELECT l_returnflag, approx_percentile_cont(l_extendedprice, 0.9) BETWEEN percentile(l_extendedprice, 0.89) AND percentile(l_extendedprice, 0.91) AS near FROM lineitem GROUP BY l_returnflag", _NEAR)
R.sql("agg_approx_median", "SELECT l_returnflag, approx_median(l_extendedprice) BETWEEN percentile(l_extendedprice, 0.49) AND percentile(l_extendedprice, 0.51) AS near FROM lineitem GROUP BY l_returnflag", _NEAR)
R.sql("agg_approx_weighted", "SELECT l_returnflag, approx_percentile_cont_with_weight(l_linenumber, CAST(l_quantity AS BIGINT), 0.5) = percentile(l_linenumber, 0.5, CAST(l_quantity AS BIGINT)) AS near FROM lineitem GROUP BY l_returnflag", _NEAR)
R.sql("agg_covar_names", "SELECT l_returnflag, round(covar(l_quantity, l_linenumber), 6) AS c, round(var_population(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(covar_samp(l_quantity, l_linenumber), 6) AS c, round(var_pop(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag")
R.sql("agg_percentile_weighted", "SELECT l_returnflag, percentile(l_linenumber, 0.5, CAST(l_quantity AS BIGINT)) AS middle FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, median(l_linenumber)::DOUBLE AS middle FROM (SELECT l_returnflag, l_linenumber, unnest(range(l_quantity::BIGINT)) FROM lineitem) GROUP BY l_returnflag")
R.sql("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
R.sql("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")


@R.plan("agg_array_sorted", "SELECT o_custkey, array_agg(o_orderkey ORDER BY o_totalprice, o_orderkey) AS keys FROM orders GROUP BY o_custkey")
def _array(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(aggregates.array_agg("o_orderkey", "o_totalprice", "o_orderkey").alias("keys"))


@R.plan("agg_string_sorted", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def _string(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(aggregates.string_agg("n_name", "|", "n_nationkey").alias("names"))


@R.plan("agg_grouping_sets_frame", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def _sets(t: Tables) -> DataFrame:
    return aggregates.grouping_sets(t.orders, [["o_orderstatus"], ["o_orderpriority"]], F.count("*").alias("n")).select("o_orderstatus", "o_orderpriority", "n")


@R.plan("distinct_on_frame", "SELECT DISTINCT ON (l_partkey) l_partkey, l_orderkey, l_linenumber FROM lineitem ORDER BY l_partkey, l_quantity DESC, l_orderkey, l_linenumber")
def _distinct_on(t: Tables) -> DataFrame:
    return windows.distinct_on(t.lineitem, ["l_partkey"], [F.desc("l_quantity"), "l_orderkey", "l_linenumber"]).select("l_partkey", "l_orderkey", "l_linenumber")


# windows
_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)"
_PEERS = "OVER (PARTITION BY l_returnflag ORDER BY l_linenumber)"
for _name, _call in (("row_number", "row_number()"), ("percent_rank", "round(percent_rank() {o}, 9)"), ("cume_dist", "round(cume_dist() {o}, 9)"), ("ntile", "ntile(3)")):
    _text = _call.format(o=_OVER) if "{o}" in _call else f"{_call} {_OVER}"
    R.sql(f"win_{_name}", f"SELECT o_orderkey, {_text} AS r FROM orders", f"SELECT o_orderkey, {_text}{'' if '{o}' in _call else '::INT'} AS r FROM orders")
for _name in ("rank", "dense_rank"):
    _rows = "FROM (SELECT DISTINCT l_returnflag, l_linenumber, l_quantity FROM lineitem) AS d"
    R.sql(f"win_{_name}", f"SELECT l_returnflag, l_linenumber, l_quantity, {_name}() {_PEERS} AS r {_rows}", f"SELECT l_returnflag, l_linenumber, l_quantity, ({_name}() {_PEERS})::INT AS r {_rows}")
R.sql("win_lag_lead", f"SELECT o_orderkey, lag(o_orderkey) {_OVER} AS prev, lead(o_orderkey, 2) {_OVER} AS next2, lag(o_totalprice, 1, 0.0) {_OVER} AS prev_price FROM orders", f"SELECT o_orderkey, lag(o_orderkey) {_OVER} AS prev, lead(o_orderkey, 2) {_OVER} AS next2, lag(o_totalprice, 1, 0.0::DOUBLE) {_OVER} AS prev_price FROM orders")
_WHOLE = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
R.sql("win_first_last", f"SELECT o_orderkey, first_value(o_orderkey) {_WHOLE} AS f, last_value(o_orderkey) {_WHOLE} AS l FROM orders")
R.sql("win_nth_value", f"SELECT o_orderkey, nth_value(o_orderkey, 2) {_WHOLE} AS second FROM orders")
R.sql("win_agg_running", f"SELECT o_orderkey, round(sum(o_totalprice) {_OVER}, 2) AS running, count(*) {_OVER} AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most FROM orders")
R.sql("win_rows_frame", f"SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS near FROM orders")
R.sql("win_range_frame", f"SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 50000 PRECEDING AND 50000 FOLLOWING) AS near FROM orders")
R.sql("win_range_interval", f"SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '300' DAY PRECEDING AND CURRENT ROW) AS month FROM orders")
R.sql("win_ignore_nulls", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM events", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM events")
R.sql("win_qualify", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
_GROUPS = "SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS s FROM orders"


_PEER_SUMS = "sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING){} AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus GROUPS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM orders WHERE o_totalprice > 0"
R.sql("win_groups_sql", f"SELECT o_orderkey, {_PEER_SUMS.format('')}", f"SELECT o_orderkey, {_PEER_SUMS.format('::BIGINT')}")


@R.plan("win_groups_frame", _GROUPS)
def _groups(t: Tables) -> DataFrame:
    return windows.groups_frame(t.orders, "s", F.sum("o_orderkey"), ["o_orderpriority"], 1, 0, ["o_custkey"]).select("o_orderkey", "s")


@R.plan("win_top_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def _top_per_group(t: Tables) -> DataFrame:
    return windows.top_per_group(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 3).select("l_suppkey", "l_orderkey", "l_linenumber")


# sorts and limits
_HOLES = "(SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS nation FROM customer)"
R.sql("sort_multi_dir", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey DESC, c_acctbal ASC, c_custkey")
R.sql("sort_nulls_first_last", f"SELECT c_custkey, nation FROM {_HOLES} AS h ORDER BY nation DESC NULLS LAST, c_custkey")
R.sql("sort_nulls_largest", f"SELECT c_custkey, nation FROM {_HOLES} AS h ORDER BY nation DESC, c_custkey", f"SELECT c_custkey, nation FROM {_HOLES} AS h ORDER BY nation DESC NULLS FIRST, c_custkey")
R.sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
R.sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")


@R.plan("topk_frame", f"SELECT c_custkey, nation FROM {_HOLES} ORDER BY nation ASC NULLS FIRST, c_custkey DESC LIMIT 20 OFFSET 5")
def _topk(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.when(c("c_custkey") % 7 != 0, c("c_nationkey")).alias("nation"))
    return sorts.top(rows, 20, sorts.key("nation", nulls_first=True), sorts.key("c_custkey", True), offset=5)


_COUNTED = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"
R.plan("repartition_hash", _COUNTED)(lambda t: sorts.repartition(t.orders, 6, "o_orderstatus").groupBy("o_orderstatus").agg(F.count("*").alias("n")))
R.plan("repartition_round_robin", _COUNTED)(lambda t: sorts.repartition(t.orders, 6).groupBy("o_orderstatus").agg(F.count("*").alias("n")))
R.plan("coalesce_single", _COUNTED)(lambda t: sorts.gather(t.orders).groupBy("o_orderstatus").agg(F.count("*").alias("n")))

# set operations
_A, _B = "SELECT o_custkey AS k FROM orders", "SELECT s_suppkey AS k FROM supplier"
for _name, _operation in (("union_all", "UNION ALL"), ("union_distinct", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    R.sql(_name, f"{_A} {_operation} {_B}")


@R.plan("union_by_name", "SELECT 1 AS a, 2 AS b UNION ALL BY NAME SELECT 4 AS b, 3 AS a")
def _by_name(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT 1 AS a, 2 AS b").unionByName(t.spark.sql("SELECT 4 AS b, 3 AS a"))


@R.plan("set_operations_frame", f"({_A} EXCEPT ALL {_B}) UNION ALL ({_A} INTERSECT {_B})")
def _set_frames(t: Tables) -> DataFrame:
    a, b = t.orders.select(c("o_custkey").alias("k")), t.supplier.select(c("s_suppkey").alias("k"))
    return sets.combine(sets.combine(a, b, "except", True), sets.combine(a, b, "intersect"), "union", True)
