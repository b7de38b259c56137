"""Projection, filters, orders, pages, set operations and common table expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import relations, ordering, predicates
from ...operators.sets import SetChain
from .base import Tables, query

c = F.col


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def project_columns(t: Tables):
    return t.orders.select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def computed_expr(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (c("l_extendedprice") * (1 - c("l_discount"))).alias("net"))


@query("SELECT c_custkey AS id, c_name AS title FROM customer")
def alias_rename(t: Tables):
    return t.customer.select(c("c_custkey").alias("id"), c("c_name").alias("title"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(t: Tables):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def distinct_on_latest_order(t: Tables):
    return ordering.first_by(t.orders, ["o_custkey"], c("o_orderdate").desc(), c("o_orderkey").desc()).select("o_custkey", "o_orderkey")


def _orders(sql: str):
    return f"SELECT o_orderkey FROM orders WHERE {sql}"


@query(_orders("o_orderstatus = 'F'"))
def filter_eq(t: Tables):
    return t.orders.where(predicates.condition(c("o_orderstatus"), "eq", "F")).select("o_orderkey")


@query(_orders("o_totalprice >= 1000 AND o_totalprice < 50000 AND o_orderdate >= TIMESTAMP '1996-01-01'"))
def filter_range(t: Tables):
    return t.orders.where((c("o_totalprice") >= 1000) & (c("o_totalprice") < 50000) & (c("o_orderdate") >= F.lit("1996-01-01").cast("timestamp"))).select("o_orderkey")


@query(_orders("o_orderpriority IN ('1-URGENT', '2-HIGH')"))
def in_list(t: Tables):
    return t.orders.where(predicates.condition(c("o_orderpriority"), "in", ["1-URGENT", "2-HIGH"])).select("o_orderkey")


@query(_orders("o_orderstatus NOT IN ('F', 'P')"))
def not_in_list(t: Tables):
    return t.orders.where(predicates.condition(c("o_orderstatus"), "not_in", ["F", "P"])).select("o_orderkey")


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') IS NULL AS missing FROM customer")
def is_null(t: Tables):
    return t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).isNull().alias("missing"))


@query("SELECT p_partkey FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE '%$%%' ESCAPE '$'")
def like_escape(t: Tables):
    return t.part.where(predicates.condition(c("p_type"), "like", "%A%") & ~predicates.search_pattern(c("p_name"), "%")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%'")
def ilike(t: Tables):
    return t.customer.where(predicates.condition(c("c_mktsegment"), "ilike", "b%")).select("c_custkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def between(t: Tables):
    return t.part.where(predicates.condition(c("p_size"), "between", (10, 20))).select("p_partkey", "p_size")


@query(_orders("(o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_totalprice > 10000"))
def or_group(t: Tables):
    return t.orders.where(predicates.all_of(predicates.any_of(c("o_orderstatus") == "F", c("o_orderpriority") == "1-URGENT"), c("o_totalprice") > 10000)).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[1-2][1-3]')")
def regexp(t: Tables):
    return t.part.where(predicates.condition(c("p_brand"), "regexp", "#[1-2][1-3]")).select("p_partkey")


@query("SELECT p_partkey, p_size & 6 AS low, p_size | 8 AS high FROM part WHERE (p_size & 1) = 1")
def bitand(t: Tables):
    return t.part.where(c("p_size").bitwiseAND(1) == 1).select("p_partkey", c("p_size").bitwiseAND(6).alias("low"), c("p_size").bitwiseOR(8).alias("high"))


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), '00001') OR contains(lower(c_mktsegment), '00001')")
def table_search(t: Tables):
    return t.customer.where(predicates.search(t.customer, "00001", ["c_name", "c_mktsegment"])).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT NULL AND nullif(c_mktsegment, 'BUILDING') <> 'MACHINERY'")
def cached_not_equal(t: Tables):
    rows = t.customer.withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return rows.where(predicates.cached_condition(c("seg"), rows.schema["seg"].dataType, "ne", "MACHINERY")).select("c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(t: Tables):
    return t.orders.orderBy(c("o_totalprice").desc(), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 50")
def page_2(t: Tables):
    return ordering.page(t.orders.orderBy("o_orderkey").select("o_orderkey"), 2)


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7 OFFSET 13")
def window_offset_limit(t: Tables):
    return ordering.window(t.customer.orderBy(c("c_acctbal").desc(), "c_custkey").select("c_custkey"), 13, 7)


@query("SELECT c_custkey FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 20")
def page_after_key(t: Tables):
    return ordering.after(t.customer.select("c_custkey"), "c_custkey", 100, 20)


@query("SELECT c_custkey, seg FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) ORDER BY seg DESC NULLS LAST, c_custkey LIMIT 30")
def nulls_order(t: Tables):
    rows = t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    return rows.orderBy(*ordering.view_order("seg", "c_custkey", descending=True)).limit(30)


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
def union_all(t: Tables):
    return SetChain(t.customer.select(c("c_nationkey").alias("k"))).union_all(t.supplier.select("s_nationkey")).df


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
def union_distinct(t: Tables):
    return SetChain(t.customer.select(c("c_nationkey").alias("k"))).union(t.supplier.select("s_nationkey")).df


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 48")
def except_distinct(t: Tables):
    return SetChain(t.part.select(c("p_partkey").alias("k"))).except_(t.lineitem.where("l_quantity > 48").select("l_partkey")).df


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 100000")
def intersect(t: Tables):
    return SetChain(t.customer.select(c("c_custkey").alias("k"))).intersect(t.orders.where("o_totalprice > 100000").select("o_custkey")).df


@query("SELECT l_returnflag AS k FROM lineitem EXCEPT ALL SELECT o_orderstatus AS k FROM orders")
def except_all(t: Tables):
    return SetChain(t.lineitem.select(c("l_returnflag").alias("k"))).except_all(t.orders.select("o_orderstatus")).df


@query("((SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1) INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey <> 2")
def mixed_chain(t: Tables):
    chain = SetChain(t.customer.where("c_acctbal > 0").select(c("c_nationkey").alias("k"))).union(t.supplier.select("s_nationkey"))
    return chain.except_(t.nation.where("n_regionkey = 1").select("n_nationkey")).intersect(t.nation.where("n_regionkey <> 2").select("n_nationkey")).df


@query("""WITH big AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey),
top AS (SELECT * FROM big WHERE n >= 5)
SELECT c_custkey, c_mktsegment, n, spent FROM top JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def cte_chain(t: Tables):
    big = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    top = big.where("n >= 5")
    return top.join(t.customer, c("c_custkey") == c("o_custkey")).where(c("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment", "n", "spent")


_TREE = """WITH RECURSIVE r AS (
  SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS path, 0 AS depth FROM part WHERE p_partkey = 1
  UNION ALL
  SELECT p.p_partkey, r.path || '/' || p.p_partkey, r.depth + 1 FROM part AS p JOIN r ON CAST(floor(p.p_partkey / 2) AS BIGINT) = r.id WHERE p.p_partkey > 1)
SELECT id, path, depth FROM r"""


def _tree(t: Tables):
    """Each part below part 1 under the one of half its number, down to the last child."""
    nodes = t.part.where("p_partkey > 1").select(c("p_partkey").alias("id"), F.expr("p_partkey DIV 2").alias("parent"))
    roots = t.part.where("p_partkey = 1").select(c("p_partkey").alias("id"), c("p_partkey").cast("string").alias("path"), F.lit(0).alias("depth"))
    child = lambda rows: rows.select("id", F.concat("up.path", F.lit("/"), c("id").cast("string")).alias("path"), (c("up.depth") + 1).alias("depth"))
    return relations.descend(nodes, "id", "parent", roots, child)


@query(_TREE)
def recursive_tree(t: Tables):
    return _tree(t)


@query(_TREE)
def recursive_tree_all(t: Tables):
    return _tree(t)


@query("SELECT o_orderstatus, n FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus) AS d WHERE n <> 1")
def derived_table(t: Tables):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).where("n <> 1")
