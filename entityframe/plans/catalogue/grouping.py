"""Aggregates and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import aggregates
from ...operators.windows import NamedWindow
from .base import Tables, query

c = F.col


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_discount), 6) AS a, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem")
def agg_all(t: Tables):
    r = lambda x, d: F.round(x, d)
    return t.lineitem.agg(aggregates.named("count").alias("n"), r(aggregates.named("sum", "l_quantity"), 2).alias("s"), r(aggregates.named("avg", "l_discount"), 6).alias("a"), aggregates.named("min", "l_extendedprice").alias("lo"), aggregates.named("max", "l_extendedprice").alias("hi"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(t: Tables):
    rows = t.lineitem.where(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 2) AS mean FROM customer GROUP BY c_mktsegment HAVING count(*) > 5 AND max(c_acctbal) > 0")
def group_having(t: Tables):
    return t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 2).alias("mean"), F.max("c_acctbal").alias("m")).where("n > 5 AND m > 0").drop("m")


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def count_distinct(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"))


@query("SELECT count(*) FILTER (WHERE p_size = 7) AS n FROM part")
def count_where(t: Tables):
    return t.part.agg(aggregates.count_where(p_size="7").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INTEGER) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_grouping(t: Tables):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("int").alias("g"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(t: Tables):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(t: Tables):
    return t.orders.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0), 2) AS o FROM orders GROUP BY o_orderpriority")
def filter_agg(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(F.count_if(c("o_orderstatus") == "F").alias("f"), F.round(F.coalesce(F.sum(F.when(c("o_orderstatus") == "O", c("o_totalprice"))), F.lit(0.0)), 2).alias("o"))


@query("SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def string_agg_ordered(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(aggregates.joined("n_name", "; ").alias("names"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY n_regionkey")
def string_agg_by_key(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(aggregates.joined("n_name", ",", by=-c("n_nationkey")).alias("names"))


@query("SELECT n_regionkey, CAST(list(n_nationkey ORDER BY n_nationkey) AS VARCHAR) AS keys FROM nation GROUP BY n_regionkey")
def array_agg_sorted(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("n_nationkey")), ", "), F.lit("]")).alias("keys"))


@query("SELECT l_returnflag, round(median(l_quantity), 4) AS med, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag")
def median_stddev(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.median("l_quantity"), 4).alias("med"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"))


@query("SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS obj FROM nation GROUP BY n_regionkey")
def json_object_agg(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))))).alias("obj"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def group_by_expr_month(t: Tables):
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT nullif(c_mktsegment, 'BUILDING') AS seg, round(sum(c_acctbal), 2) AS s FROM customer GROUP BY 1")
def client_group_by(t: Tables):
    rows = t.customer.withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return aggregates.group_by(rows, "seg", s=F.round(aggregates.total("c_acctbal"), 2))


@query("SELECT count(DISTINCT nullif(c_mktsegment, 'BUILDING')) + 1 AS n FROM customer")
def client_distinct_with_null(t: Tables):
    rows = t.customer.withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return rows.agg(aggregates.distinct("seg").alias("n"))


@query("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def row_number_rank(t: Tables):
    w, v = NamedWindow("o_custkey").order_by(c("o_orderdate"), c("o_orderkey")), NamedWindow("o_custkey").order_by(c("o_orderpriority"))
    return t.orders.select("o_orderkey", w.rank(F.row_number()).cast("long").alias("rn"), v.rank(F.rank()).cast("long").alias("rk"))


@query("SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS nt, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS pr FROM part")
def dense_ntile_percent(t: Tables):
    w, v = NamedWindow("p_brand").order_by(c("p_size")), NamedWindow("p_brand").order_by(c("p_size"), c("p_partkey"))
    return t.part.select("p_partkey", w.rank(F.dense_rank()).cast("long").alias("dr"), v.rank(F.ntile(4)).cast("long").alias("nt"), F.round(w.rank(F.percent_rank()), 6).alias("pr"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders")
def running_sum_rows(t: Tables):
    return t.orders.select("o_orderkey", F.round(NamedWindow("o_custkey").order_by(c("o_orderdate"), c("o_orderkey")).rows(-2, 0).apply(F.sum("o_totalprice")), 2).alias("s"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM part")
def range_frame(t: Tables):
    return t.part.select("p_partkey", NamedWindow("p_brand").order_by(c("p_size")).range(-5, 5).apply(F.count("*")).alias("n"))


@query("SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS later FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def lag_lead(t: Tables):
    w = NamedWindow("o_custkey").order_by(c("o_orderdate"), c("o_orderkey"))
    return t.orders.select("o_orderkey", w.rank(F.lag("o_orderkey")).alias("before"), w.rank(F.lead("o_orderkey", 2)).alias("later"))


@query("SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, nth_value(o_orderkey, 2) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def first_nth_value(t: Tables):
    w = NamedWindow("o_custkey").order_by(c("o_orderdate"), c("o_orderkey")).rows(-(1 << 63), (1 << 63) - 1)
    return t.orders.select("o_orderkey", w.apply(F.first("o_orderkey")).alias("f"), w.apply(F.nth_value("o_orderkey", 2)).alias("s"))


@query("SELECT o_orderkey, count(*) OVER w AS n, round(avg(o_totalprice) OVER w, 2) AS a FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def named_window(t: Tables):
    w = NamedWindow("o_custkey")
    return t.orders.select("o_orderkey", w.apply(F.count("*")).alias("n"), F.round(w.apply(F.avg("o_totalprice")), 2).alias("a"))


@query("SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n FROM orders")
def conditional_count_over(t: Tables):
    return t.orders.select("o_orderkey", NamedWindow("o_custkey").count_where(c("o_orderstatus") == "F").alias("n"))


@query("SELECT l_returnflag, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY l_returnflag")
def custom_aggregation(t: Tables):
    aggregates.register("spread", lambda name: F.max(name) - F.min(name))
    return t.lineitem.groupBy("l_returnflag").agg(aggregates.named("spread", "l_quantity").alias("spread"))


@query("SELECT n_regionkey, count(*) AS n, min(n_name) AS first_name FROM nation GROUP BY n_regionkey")
def grouped_reduce(t: Tables):
    import pandas as pd

    def reduce(rows):
        return pd.DataFrame({"n_regionkey": [rows["n_regionkey"].iloc[0]], "n": [len(rows)], "first_name": [rows["n_name"].min()]})

    return aggregates.reduce_groups(t.nation, ["n_regionkey"], reduce, "n_regionkey int, n bigint, first_name string")
