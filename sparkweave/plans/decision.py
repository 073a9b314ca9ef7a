"""The 22 decision-support questions as DataFrame programs, adapted to the columns at hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.plans.tables import Tables

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
c = F.col


def _plan(name: str):
    def add(build: Callable[[Tables], DataFrame]):
        PLANS[name] = lambda spark, folder: build(Tables(spark, folder))
        return build

    return add


def day(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def between(column: str, first: str, after: str) -> Column:
    """From a day up to, but without, another."""
    return (c(column) >= day(first)) & (c(column) < day(after))


def total(x: Column, name: str, places: int = 4) -> Column:
    """A sum of money, rounded so that the order of addition does not show."""
    return F.round(F.sum(x), places).alias(name)


def revenue() -> Column:
    return c("l_extendedprice") * (1 - c("l_discount"))


def in_region(t: Tables, name: str) -> DataFrame:
    """The nations of a region."""
    return t.nation.join(t.region.where(c("r_name") == name), c("n_regionkey") == c("r_regionkey")).select("n_nationkey", "n_name")


@_plan("tpch_q01")
def pricing_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.where(c("l_shipdate") <= day("1998-12-01") - F.expr("interval '90' day"))
    avg = lambda x, name: F.round(F.avg(x), 6).alias(name)
    sums = [total(c("l_quantity"), "sum_qty"), total(c("l_extendedprice"), "sum_base_price"), total(revenue(), "sum_disc_price"), total(revenue() * (1 + c("l_tax")), "sum_charge", 5)]
    means = [avg("l_quantity", "avg_qty"), avg("l_extendedprice", "avg_price"), avg("l_discount", "avg_disc")]
    return rows.groupBy("l_returnflag", "l_linestatus").agg(*sums, *means, F.count("*").alias("count_order")).orderBy("l_returnflag", "l_linestatus")


@_plan("tpch_q02")
def cheapest_supplier(t: Tables) -> DataFrame:
    sellers = t.supplier.join(in_region(t, "ASIA"), c("s_nationkey") == c("n_nationkey"))
    parts = t.part.where(c("p_size") == 15).select("p_partkey")
    lines = t.lineitem.join(parts, c("l_partkey") == c("p_partkey"), "left_semi").join(sellers, c("l_suppkey") == c("s_suppkey"))
    offers = lines.select(c("l_partkey").alias("p_partkey"), "s_acctbal", "s_name", "n_name", "s_suppkey", (c("l_extendedprice") / c("l_quantity")).alias("cost"))
    # one shuffle serves the costs of a supplier and the least of a part
    cost = offers.repartition("p_partkey").groupBy("p_partkey", "s_suppkey").agg(F.min("cost").alias("cost"), *[F.first(x).alias(x) for x in ("s_acctbal", "s_name", "n_name")])
    best = cost.withColumn("least", F.min("cost").over(Window.partitionBy("p_partkey"))).where(c("cost") == c("least"))
    return best.select("s_acctbal", "s_name", "n_name", "p_partkey").orderBy(F.desc("s_acctbal"), "n_name", "s_name", "p_partkey").limit(100)


@_plan("tpch_q03")
def unshipped_orders(t: Tables) -> DataFrame:
    cut = day("1997-03-15")
    orders = t.orders.where(c("o_orderdate") < cut).join(t.customer.where(c("c_mktsegment") == "BUILDING"), c("o_custkey") == c("c_custkey"))
    lines = orders.join(t.lineitem.where(c("l_shipdate") > cut), c("o_orderkey") == c("l_orderkey"))
    return lines.groupBy("l_orderkey", "o_orderdate").agg(total(revenue(), "revenue")).orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10)


@_plan("tpch_q04")
def order_priorities(t: Tables) -> DataFrame:
    late = (c("l_orderkey") == c("o_orderkey")) & (c("l_shipdate") > c("o_orderdate"))
    orders = t.orders.where(between("o_orderdate", "1996-04-01", "1996-07-01")).join(t.lineitem, late, "left_semi")
    return orders.groupBy("o_orderpriority").agg(F.count("*").alias("order_count")).orderBy("o_orderpriority")


@_plan("tpch_q05")
def local_suppliers(t: Tables) -> DataFrame:
    orders = t.orders.where(between("o_orderdate", "1996-01-01", "1998-01-01")).join(t.customer, c("o_custkey") == c("c_custkey"))
    local = (c("l_suppkey") == c("s_suppkey")) & (c("c_nationkey") == c("s_nationkey"))
    sold = orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey")).join(t.supplier, local).join(in_region(t, "ASIA"), c("s_nationkey") == c("n_nationkey"))
    return sold.groupBy("n_name").agg(total(revenue(), "revenue")).orderBy(F.desc("revenue"), "n_name")


@_plan("tpch_q06")
def forecast_revenue(t: Tables) -> DataFrame:
    rows = t.lineitem.where(between("l_shipdate", "1996-01-01", "1997-01-01") & c("l_discount").between(0.03, 0.05) & (c("l_quantity") < 24))
    return rows.agg(total(c("l_extendedprice") * c("l_discount"), "revenue"))


@_plan("tpch_q07")
def trade_between_nations(t: Tables) -> DataFrame:
    one = t.nation.select(c("n_nationkey").alias("s_nation"), c("n_name").alias("supp_nation"))
    two = t.nation.select(c("n_nationkey").alias("c_nation"), c("n_name").alias("cust_nation"))
    pair = ((c("supp_nation") == "NATION_1") & (c("cust_nation") == "NATION_2")) | ((c("supp_nation") == "NATION_2") & (c("cust_nation") == "NATION_1"))
    lines = t.lineitem.join(t.supplier, c("l_suppkey") == c("s_suppkey")).join(one, c("s_nationkey") == c("s_nation"))
    bought = lines.join(t.orders, c("l_orderkey") == c("o_orderkey")).join(t.customer, c("o_custkey") == c("c_custkey")).join(two, c("c_nationkey") == c("c_nation"))
    years = bought.where(pair).select("supp_nation", "cust_nation", F.year("l_shipdate").cast("long").alias("l_year"), revenue().alias("volume"))
    keys = ["supp_nation", "cust_nation", "l_year"]
    return years.groupBy(*keys).agg(total(c("volume"), "revenue")).orderBy(*keys)


@_plan("tpch_q08")
def market_share(t: Tables) -> DataFrame:
    buyers = t.customer.join(in_region(t, "AMERICA"), c("c_nationkey") == c("n_nationkey")).select("c_custkey")
    orders = t.orders.join(buyers, c("o_custkey") == c("c_custkey"))
    lines = t.lineitem.join(t.part.where(c("p_type") == "PROMO"), c("l_partkey") == c("p_partkey")).join(orders, c("l_orderkey") == c("o_orderkey"))
    sellers = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).select("s_suppkey", c("n_name").alias("nation"))
    all_ = lines.join(sellers, c("l_suppkey") == c("s_suppkey")).select(F.year("o_orderdate").cast("long").alias("o_year"), revenue().alias("volume"), "nation")
    share = F.sum(F.when(c("nation") == "NATION_7", c("volume")).otherwise(0.0)) / F.sum("volume")
    return all_.groupBy("o_year").agg(F.round(share, 6).alias("mkt_share")).orderBy("o_year")


@_plan("tpch_q09")
def product_profit(t: Tables) -> DataFrame:
    parts = t.part.where(c("p_name").contains("ring")).select("p_partkey")
    lines = t.lineitem.join(parts, c("l_partkey") == c("p_partkey"))
    # the supply of these parts is derived from the same lines: one scan
    supplied = lines.withColumn("ps_supplycost", F.min(c("l_extendedprice") / c("l_quantity")).over(Window.partitionBy("l_partkey", "l_suppkey")))
    sold = supplied.join(t.orders, c("l_orderkey") == c("o_orderkey")).join(t.supplier, c("l_suppkey") == c("s_suppkey")).join(t.nation, c("s_nationkey") == c("n_nationkey"))
    amount = revenue() - c("ps_supplycost") * c("l_quantity")
    years = sold.select(c("n_name").alias("nation"), F.year("o_orderdate").cast("long").alias("o_year"), amount.alias("amount"))
    return years.groupBy("nation", "o_year").agg(total(c("amount"), "sum_profit", 3)).orderBy("nation", F.desc("o_year"))


@_plan("tpch_q10")
def returned_items(t: Tables) -> DataFrame:
    orders = t.orders.where(between("o_orderdate", "1996-07-01", "1996-10-01"))
    lines = t.lineitem.where(c("l_returnflag") == "R").join(orders, c("l_orderkey") == c("o_orderkey"))
    whole = lines.join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey"))
    return whole.groupBy("c_custkey", "c_name", "c_acctbal", "n_name").agg(total(revenue(), "revenue")).orderBy(F.desc("revenue"), "c_custkey").limit(20)


@_plan("tpch_q11")
def important_stock(t: Tables) -> DataFrame:
    own = t.supplier.join(t.nation.where(c("n_name") == "NATION_3"), c("s_nationkey") == c("n_nationkey")).select("s_suppkey")
    worth = t.supply(suppliers=own).select("ps_partkey", (c("ps_supplycost") * c("ps_availqty")).alias("worth"))
    limit = worth.agg((F.sum("worth") * 0.001).alias("limit"))
    parts = worth.groupBy("ps_partkey").agg(F.sum("worth").alias("sum_worth"))
    return parts.join(limit, c("sum_worth") > c("limit")).select("ps_partkey", F.round("sum_worth", 3).alias("value")).orderBy(F.desc("value"), "ps_partkey")


@_plan("tpch_q12")
def shipping_and_priority(t: Tables) -> DataFrame:
    lines = t.lineitem.where(between("l_shipdate", "1996-01-01", "1997-01-01") & c("l_linestatus").isin("O", "F"))
    both = lines.join(t.orders, (c("l_orderkey") == c("o_orderkey")) & (c("o_orderdate") < c("l_shipdate")))
    urgent = c("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return both.groupBy("l_returnflag").agg(F.count(F.when(urgent, 1)).alias("high_line_count"), F.count(F.when(~urgent, 1)).alias("low_line_count")).orderBy("l_returnflag")


@_plan("tpch_q13")
def orders_for_each_customer(t: Tables) -> DataFrame:
    on = (c("c_custkey") == c("o_custkey")) & ~c("o_orderpriority").like("%URGENT%")
    counts = t.customer.join(t.orders, on, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("c_count"))
    return counts.groupBy("c_count").agg(F.count("*").alias("custdist")).orderBy(F.desc("custdist"), F.desc("c_count"))


@_plan("tpch_q14")
def promotion_effect(t: Tables) -> DataFrame:
    lines = t.lineitem.where(between("l_shipdate", "1996-02-01", "1996-03-01")).join(t.part, c("l_partkey") == c("p_partkey"))
    promo = F.sum(F.when(c("p_type").startswith("PROMO"), revenue()).otherwise(0.0))
    return lines.agg(F.round(100 * promo / F.sum(revenue()), 6).alias("promo_revenue"))


@_plan("tpch_q15")
def top_supplier(t: Tables) -> DataFrame:
    earned = t.lineitem.where(between("l_shipdate", "1996-08-01", "1996-11-01")).groupBy("l_suppkey").agg(total(revenue(), "total_revenue"))
    most = earned.agg(F.max("total_revenue").alias("most"))
    return earned.join(most, c("total_revenue") == c("most")).join(t.supplier, c("l_suppkey") == c("s_suppkey")).select("s_suppkey", "s_name", "total_revenue").orderBy("s_suppkey")


@_plan("tpch_q16")
def supplier_counts(t: Tables) -> DataFrame:
    kept = (c("p_brand") != "Brand#14") & ~c("p_type").like("SMALL%") & c("p_size").isin(14, 6, 5, 31, 49, 15, 41, 47)
    bad = t.supplier.where(c("s_acctbal") < 0).select("s_suppkey")
    parts = t.part.where(kept)
    offers = t.supply(parts).join(parts, c("ps_partkey") == c("p_partkey")).join(bad, c("ps_suppkey") == c("s_suppkey"), "left_anti")
    keys = ["p_brand", "p_type", "p_size"]
    return offers.groupBy(*keys).agg(F.count_distinct("ps_suppkey").alias("supplier_cnt")).orderBy(F.desc("supplier_cnt"), *keys)


@_plan("tpch_q17")
def small_orders(t: Tables) -> DataFrame:
    parts = t.part.where(c("p_brand") == "Brand#4").select("p_partkey")
    lines = t.lineitem.join(parts, c("l_partkey") == c("p_partkey"))
    means = lines.groupBy(c("l_partkey").alias("of_part")).agg((0.2 * F.avg("l_quantity")).alias("limit"))
    small = lines.join(means, (c("l_partkey") == c("of_part")) & (c("l_quantity") < c("limit")))
    return small.agg(F.round(F.sum("l_extendedprice") / 7.0, 6).alias("avg_yearly"))


@_plan("tpch_q18")
def large_orders(t: Tables) -> DataFrame:
    large = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("sum_qty")).where(c("sum_qty") > 200)
    orders = large.join(t.orders, c("l_orderkey") == c("o_orderkey")).join(t.customer, c("o_custkey") == c("c_custkey"))
    return orders.select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "sum_qty").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(100)


@_plan("tpch_q19")
def discounted_revenue(t: Tables) -> DataFrame:
    one = (c("p_brand") == "Brand#4") & c("l_quantity").between(1, 11) & c("p_size").between(1, 20)
    two = (c("p_brand") == "Brand#8") & c("l_quantity").between(10, 20) & c("p_size").between(1, 30)
    return t.lineitem.join(t.part, (c("l_partkey") == c("p_partkey")) & (one | two)).agg(total(revenue(), "revenue"))


@_plan("tpch_q20")
def surplus_suppliers(t: Tables) -> DataFrame:
    parts = t.part.where(c("p_name").startswith("small")).select("p_partkey")
    sold = t.lineitem.where(between("l_shipdate", "1996-01-01", "1999-01-01")).join(parts, c("l_partkey") == c("p_partkey"), "left_semi").groupBy(c("l_partkey").alias("part"), c("l_suppkey").alias("supp")).agg((0.5 * F.sum("l_quantity")).alias("half"))
    rich = t.supply(parts).join(sold, (c("ps_partkey") == c("part")) & (c("ps_suppkey") == c("supp")) & (c("ps_availqty") > c("half")))
    near = t.supplier.join(t.nation.where(c("n_nationkey") < 8), c("s_nationkey") == c("n_nationkey"))
    return near.join(rich, c("s_suppkey") == c("ps_suppkey"), "left_semi").select("s_suppkey", "s_name").orderBy("s_name")


@_plan("tpch_q21")
def suppliers_kept_waiting(t: Tables) -> DataFrame:
    late = t.lineitem.join(t.orders.where(c("o_orderstatus") == "F"), (c("l_orderkey") == c("o_orderkey")) & (c("l_shipdate") > c("o_orderdate")))
    others = lambda p: t.lineitem.select(c("l_orderkey").alias(f"{p}_order"), c("l_suppkey").alias(f"{p}_supp"), c("l_shipdate").alias(f"{p}_ship"))
    another = (c("l_orderkey") == c("x_order")) & (c("l_suppkey") != c("x_supp"))
    later = (c("l_orderkey") == c("y_order")) & (c("l_suppkey") != c("y_supp"))
    alone = late.join(others("x"), another, "left_semi").join(others("y").where(c("y_ship") > day("1998-06-01")), later, "left_anti")
    named = alone.join(t.supplier, c("l_suppkey") == c("s_suppkey"))
    return named.groupBy("s_name").agg(F.count("*").alias("numwait")).orderBy(F.desc("numwait"), "s_name").limit(100)


@_plan("tpch_q22")
def idle_customers(t: Tables) -> DataFrame:
    coded = t.customer.select("c_custkey", "c_acctbal", F.substring("c_name", 15, 2).alias("cntrycode"))
    mean = coded.where(c("c_acctbal") > 0.0).agg(F.avg("c_acctbal").alias("mean"))
    idle = coded.join(mean, c("c_acctbal") > c("mean")).join(t.orders.where(c("o_orderstatus") == "F"), c("c_custkey") == c("o_custkey"), "left_anti")
    return idle.groupBy("cntrycode").agg(F.count("*").alias("numcust"), total(c("c_acctbal"), "totacctbal")).orderBy("cntrycode")


@_plan("example_ratio_avg")
def mean_ratio(t: Tables) -> DataFrame:
    """The mean of a ratio in groups."""
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg(c("l_discount") / c("l_quantity")), 8).alias("mean_ratio")).orderBy("l_returnflag", "l_linestatus")


@_plan("example_limit")
def some_columns(t: Tables) -> DataFrame:
    """A few columns of the first rows; ordered, so that they are always the same."""
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").limit(5)


@_plan("stage_join_group_limit")
def largest_customer(t: Tables) -> DataFrame:
    """A join, a group and one row."""
    spent = t.customer.join(t.orders, c("c_custkey") == c("o_custkey")).groupBy("c_name").agg(total(c("o_totalprice"), "total"))
    return spent.orderBy(F.desc("total"), "c_name").limit(1)
