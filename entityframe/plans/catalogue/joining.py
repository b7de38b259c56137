"""Joins, relations, nested rows and graph hops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import relations
from .base import Tables, query

c = F.col


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
def inner_join(t: Tables):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), c("c_custkey") == c("o_custkey")).select("c_custkey", "o_orderkey")


LEFT_COALESCE = """SELECT c_custkey, c_name, round(coalesce(sum(o_totalprice), 0), 2) AS spent, count(o_orderkey) AS n_orders
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY c_custkey, c_name"""


@query(LEFT_COALESCE)
def left_join_coalesce(t: Tables):
    sums = t.orders.where("o_orderstatus = 'F' AND o_totalprice > 100000").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    joined = t.customer.join(sums, c("c_custkey") == c("o_custkey"), "left")  # grouped before the join: fewer rows are moved
    return joined.select("c_custkey", "c_name", F.round(F.coalesce("s", F.lit(0.0)), 2).alias("spent"), F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 200000")
def right_join(t: Tables):
    return t.orders.where("o_totalprice > 200000").join(t.customer, c("o_custkey") == c("c_custkey"), "right").select("o_orderkey", "c_custkey")


@query("""SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 4000) AS s
FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 2000) AS k ON s_suppkey = c_custkey""")
def full_outer(t: Tables):
    return t.supplier.where("s_acctbal > 4000").join(t.customer.where("c_acctbal > 2000"), c("s_suppkey") == c("c_custkey"), "full").select("s_suppkey", "c_custkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(t: Tables):
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def theta_join(t: Tables):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_nationkey").alias("a"), c("b.n_nationkey").alias("b"))


@query("SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer AS a JOIN customer AS b ON a.c_custkey + 1 = b.c_custkey AND a.c_mktsegment = b.c_mktsegment")
def self_join(t: Tables):
    a, b = t.customer.alias("a"), t.customer.alias("b")
    return a.join(b, (c("a.c_custkey") + 1 == c("b.c_custkey")) & (c("a.c_mktsegment") == c("b.c_mktsegment"))).select(c("a.c_custkey").alias("a"), c("b.c_custkey").alias("b"))


@query("""SELECT n_name, c_custkey FROM nation JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) ON c_nationkey = n_nationkey WHERE n <= 2""")
def lateral_top2(t: Tables):
    """The two best rows for each outer row: ranked once by key instead of a lateral pass for each."""
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey").orderBy(c("c_acctbal").desc(), "c_custkey")
    best = t.customer.withColumn("n", F.row_number().over(w)).where("n <= 2")
    return t.nation.join(best, c("c_nationkey") == c("n_nationkey")).select("n_name", "c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_exists(t: Tables):
    return relations.referenced(t.customer, "c_custkey", t.orders.where("o_totalprice > 400000"), "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_not_exists(t: Tables):
    return t.customer.join(t.orders.where("o_totalprice > 400000"), c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT n_nationkey FROM nation WHERE nullif(n_nationkey, 3) NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 5)")
def not_in_null_aware(t: Tables):
    rows = t.nation.withColumn("k", F.nullif("n_nationkey", F.lit(3)))
    return relations.not_in(rows, "k", t.supplier.where("s_suppkey < 5"), "s_nationkey").select("n_nationkey")


@query("SELECT o_orderkey, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderkey HAVING sum(l_quantity) > 100")
def join_group_having(t: Tables):
    sums = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).where("q > 100")
    return t.orders.where("o_orderpriority = '1-URGENT'").join(sums, c("l_orderkey") == c("o_orderkey")).select("o_orderkey", F.round("q", 2).alias("quantity"))


@query("SELECT DISTINCT c_custkey, p_brand FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size IN (1, 2, 3) AND c_name LIKE '%1'")
def three_way_distinct(t: Tables):
    lines = t.lineitem.join(t.part.where("p_size IN (1, 2, 3)"), c("p_partkey") == c("l_partkey"))
    return t.customer.where("c_name LIKE '%1'").join(t.orders, c("o_custkey") == c("c_custkey")).join(lines, c("l_orderkey") == c("o_orderkey")).select("c_custkey", "p_brand").distinct()


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def import_two_steps(t: Tables):
    nation = relations.imported(t.nation, "n_regionkey", t.region, "r_regionkey", r_name="r_name")
    return relations.imported(t.customer, "c_nationkey", nation, "n_nationkey", n_name="n_name", r_name="r_name").select("c_custkey", "n_name", "r_name")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, avg_q FROM lineitem JOIN (SELECT l_partkey AS pk, l_suppkey AS sk, round(avg(l_quantity), 4) AS avg_q FROM lineitem GROUP BY 1, 2) ON pk = l_partkey AND sk = l_suppkey WHERE l_quantity < 3""")
def multi_key_relation(t: Tables):
    few = t.lineitem.where("l_quantity < 3").select(c("l_partkey").alias("wp"), c("l_suppkey").alias("ws"))
    asked = t.lineitem.join(few, (c("l_partkey") == c("wp")) & (c("l_suppkey") == c("ws")), "left_semi")  # only what is asked for is aggregated
    means = asked.groupBy(c("l_partkey").alias("pk"), c("l_suppkey").alias("sk")).agg(F.round(F.avg("l_quantity"), 4).alias("avg_q"))
    return t.lineitem.where("l_quantity < 3").join(means, (c("pk") == c("l_partkey")) & (c("sk") == c("l_suppkey"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "avg_q")


@query("""SELECT s_suppkey, CASE WHEN c_custkey IS NOT NULL THEN c_name ELSE s_name END AS s_name FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 2000) ON s_suppkey = c_custkey""")
def augment_lookup(t: Tables):
    detail = t.customer.where("c_acctbal > 2000").withColumnsRenamed({"c_name": "s_name"})
    return relations.augment(t.supplier, detail, {"s_suppkey": "c_custkey"}, ["s_name"]).select("s_suppkey", "s_name")


@query("""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INTEGER) AS position, l_partkey, l_quantity
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def contained_many(t: Tables):
    return _nested_lines(t.orders, t.lineitem)


@query("""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INTEGER) AS position, l_partkey, l_quantity
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def contained_many_all(t: Tables):
    """The lines of every order."""
    return _nested_lines(t.orders, t.lineitem)


def _nested_lines(orders, lineitem):
    lines = lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("lines"))
    rows = orders.join(lines, c("o_orderkey") == c("l_orderkey")).select("o_orderkey", "lines")
    return relations.contained_many(rows, ["o_orderkey"], "lines").select("o_orderkey", "position", "l_partkey", "l_quantity")


@query("SELECT p_partkey, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)")
def split_unnest(t: Tables):
    return t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


_EDGES = "SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


@query(f"""WITH e AS ({_EDGES}) SELECT DISTINCT y.a AS node FROM e AS x JOIN e AS y ON x.b = y.b WHERE x.a = 7""")
def graph_two_hop(t: Tables):
    edges = t.orders.join(t.lineitem, c("l_orderkey") == c("o_orderkey")).select(c("o_custkey").alias("a"), c("l_suppkey").alias("b"))  # the small frontier is made distinct, not all edges
    start = t.customer.where("c_custkey = 7").select(c("c_custkey").alias("node"))
    return relations.hop(relations.hop(start, "node", edges, "a", "b"), "node", edges, "b", "a")


@query("""WITH RECURSIVE r AS (
  SELECT n_nationkey AS root, n_nationkey AS node, 0 AS depth FROM nation WHERE n_nationkey < 3
  UNION SELECT root, (node * 2 + 1) % 25, depth + 1 FROM r WHERE depth < 4
) SELECT root, node, depth FROM r WHERE depth >= 1""")
def graph_recursive(t: Tables):
    edges = t.nation.select(c("n_nationkey").alias("a"), ((c("n_nationkey") * 2 + 1) % 25).alias("b"))
    return relations.reachable(t.nation.where("n_nationkey < 3"), "n_nationkey", edges, "a", "b", 1, 4)
