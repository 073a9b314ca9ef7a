"""The 22 decision-support questions as DuckDB SQL, to check the programs against."""

_PS = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, sum(l_quantity) AS ps_availqty, min(l_extendedprice / l_quantity) AS ps_supplycost FROM lineitem GROUP BY ALL) AS ps"
_REV = "l_extendedprice * (1 - l_discount)"
_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"

SQL: dict[str, str] = {
    "tpch_q01": f"""
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_base_price,
               round(sum({_REV}), 4) AS sum_disc_price, round(sum({_REV} * (1 + l_tax)), 5) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty,
               round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "tpch_q02": f"""
        WITH w AS (SELECT * FROM {_PS} JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
                   JOIN region ON n_regionkey = r_regionkey JOIN part ON ps_partkey = p_partkey WHERE r_name = 'ASIA' AND p_size = 15)
        SELECT s_acctbal, s_name, n_name, p_partkey FROM w WHERE ps_supplycost = (SELECT min(ps_supplycost) FROM w AS x WHERE x.p_partkey = w.p_partkey)
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q03": f"""
        SELECT l_orderkey, o_orderdate, round(sum({_REV}), 4) AS revenue FROM {_LINES}
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-03-15' AND l_shipdate > TIMESTAMP '1997-03-15'
        GROUP BY ALL ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "tpch_q04": """
        SELECT o_orderpriority, count(*) AS order_count FROM orders
        WHERE o_orderdate >= TIMESTAMP '1996-04-01' AND o_orderdate < TIMESTAMP '1996-07-01'
          AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY ALL""",
    "tpch_q05": f"""
        SELECT n_name, round(sum({_REV}), 4) AS revenue FROM {_LINES} JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY ALL""",
    "tpch_q06": """
        SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.03::DOUBLE AND 0.05::DOUBLE AND l_quantity < 24""",
    "tpch_q07": f"""
        SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, year(l_shipdate) AS l_year, round(sum({_REV}), 4) AS revenue
        FROM {_LINES} JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey
        WHERE (a.n_name, b.n_name) IN (('NATION_1', 'NATION_2'), ('NATION_2', 'NATION_1')) GROUP BY ALL""",
    "tpch_q08": f"""
        SELECT year(o_orderdate) AS o_year, round(sum(CASE WHEN b.n_name = 'NATION_7' THEN {_REV} ELSE 0 END) / sum({_REV}), 6) AS mkt_share
        FROM {_LINES} JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey
        JOIN region ON a.n_regionkey = r_regionkey JOIN nation b ON s_nationkey = b.n_nationkey
        WHERE r_name = 'AMERICA' AND p_type = 'PROMO' GROUP BY ALL""",
    "tpch_q09": f"""
        SELECT n_name AS nation, year(o_orderdate) AS o_year, round(sum({_REV} - ps_supplycost * l_quantity), 3) AS sum_profit
        FROM lineitem JOIN {_PS} ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey JOIN part ON l_partkey = p_partkey
        JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        WHERE p_name LIKE '%ring%' GROUP BY ALL""",
    "tpch_q10": f"""
        SELECT c_custkey, c_name, c_acctbal, n_name, round(sum({_REV}), 4) AS revenue FROM {_LINES} JOIN nation ON c_nationkey = n_nationkey
        WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1996-07-01' AND o_orderdate < TIMESTAMP '1996-10-01'
        GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": f"""
        WITH w AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS worth FROM {_PS} JOIN supplier ON ps_suppkey = s_suppkey
                   JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3')
        SELECT ps_partkey, round(sum(worth), 3) AS value FROM w GROUP BY ALL HAVING sum(worth) > (SELECT sum(worth) * 0.001::DOUBLE FROM w)""",
    "tpch_q12": """
        SELECT l_returnflag, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high_line_count,
               count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low_line_count
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus IN ('O', 'F') AND o_orderdate < l_shipdate
          AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY ALL""",
    "tpch_q13": """
        SELECT c_count, count(*) AS custdist FROM (
            SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY ALL)
        GROUP BY ALL""",
    "tpch_q14": f"""
        SELECT round(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_REV} ELSE 0 END) / sum({_REV}), 6) AS promo_revenue
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1996-02-01' AND l_shipdate < TIMESTAMP '1996-03-01'""",
    "tpch_q15": f"""
        WITH r AS (SELECT l_suppkey, round(sum({_REV}), 4) AS total_revenue FROM lineitem
                   WHERE l_shipdate >= TIMESTAMP '1996-08-01' AND l_shipdate < TIMESTAMP '1996-11-01' GROUP BY ALL)
        SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE total_revenue = (SELECT max(total_revenue) FROM r)""",
    "tpch_q16": f"""
        SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM {_PS} JOIN part ON ps_partkey = p_partkey
        WHERE p_brand <> 'Brand#14' AND p_type NOT LIKE 'SMALL%' AND p_size IN (14, 6, 5, 31, 49, 15, 41, 47)
          AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY ALL""",
    "tpch_q17": """
        SELECT round(sum(l_extendedprice) / 7.0::DOUBLE, 6) AS avg_yearly FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE p_brand = 'Brand#4' AND l_quantity < (SELECT 0.2::DOUBLE * avg(x.l_quantity) FROM lineitem x WHERE x.l_partkey = p_partkey)""",
    "tpch_q18": """
        SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS sum_qty
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        GROUP BY ALL HAVING sum(l_quantity) > 200 ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "tpch_q19": f"""
        SELECT round(sum({_REV}), 4) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE (p_brand = 'Brand#4' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 20)
           OR (p_brand = 'Brand#8' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)""",
    "tpch_q20": f"""
        SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey < 8 AND s_suppkey IN (
            SELECT ps_suppkey FROM {_PS} WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%')
              AND ps_availqty > (SELECT 0.5::DOUBLE * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey
                                 AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'))""",
    "tpch_q21": """
        SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
        WHERE o_orderstatus = 'F' AND l_shipdate > o_orderdate
          AND EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_suppkey <> l.l_suppkey)
          AND NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = l.l_orderkey AND y.l_suppkey <> l.l_suppkey AND y.l_shipdate > TIMESTAMP '1998-06-01')
        GROUP BY ALL ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q22": """
        SELECT substring(c_name, 15, 2) AS cntrycode, count(*) AS numcust, round(sum(c_acctbal), 4) AS totacctbal FROM customer
        WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
          AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') GROUP BY ALL""",
    "example_ratio_avg": "SELECT l_returnflag, l_linestatus, round(avg(l_discount / l_quantity), 8) AS mean_ratio FROM lineitem GROUP BY ALL",
    "example_limit": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5",
    "stage_join_group_limit": "SELECT c_name, round(sum(o_totalprice), 4) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL ORDER BY total DESC, c_name LIMIT 1",
}
