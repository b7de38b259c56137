"""The table model, writes, declared tables and the token language."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import aggregates, writes
from ..declared import Catalog
from ..table import Table
from ..tokens import query as tokens
from .base import Tables, query

c = F.col


def catalog(t: Tables) -> Catalog:
    out = Catalog(t.spark)
    load = lambda name: getattr(t, name)
    out.declare({"name": "regions", "source": "region", "columns": {"r_regionkey": {"flags": ["id"]}, "r_name": {"flags": ["title", "searchable"]}}, "references": {"nations": {"table": "nations", "kind": "has_many", "key": "n_regionkey"}}}, load)
    out.declare({"name": "nations", "source": "nation", "columns": {"n_nationkey": {"flags": ["id"]}, "n_name": {"flags": ["searchable"]}}, "references": {"region": {"table": "regions", "key": "n_regionkey"}, "customers": {"table": "customers", "kind": "has_many", "key": "c_nationkey"}}}, load)
    out.declare({"name": "customers", "source": "customer", "columns": {"c_custkey": {"flags": ["id"]}, "c_name": {"flags": ["searchable"]}, "in_debt": {"expr": "c_acctbal < 0"}, "label": {"lazy": "concat(c_name, ':', c_mktsegment)"}}, "references": {"nation": {"table": "nations", "key": "c_nationkey"}, "orders": {"table": "orders", "kind": "has_many", "key": "o_custkey"}}}, load)
    out.declare({"name": "orders", "source": "orders", "columns": {"o_orderkey": {"flags": ["id"]}}, "references": {"customer": {"table": "customers", "key": "o_custkey"}}}, load)
    return out


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def ref_has_many(t: Tables):
    return catalog(t)["customers"].where("c_mktsegment", "eq", "BUILDING").get_ref("orders").df.select("o_orderkey")


@query("SELECT c_custkey, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def ref_has_one_import(t: Tables):
    return catalog(t)["customers"].with_active_columns("nation.region.r_name").df.withColumnRenamed("nation.region.r_name", "region")


@query("SELECT c_custkey, c_acctbal < 0 AS in_debt, c_name || ':' || c_mktsegment AS label FROM customer WHERE c_acctbal < 0")
def lazy_expression(t: Tables):
    return catalog(t)["customers"].where("in_debt", "eq", True).df.select("c_custkey", "in_debt", "label")


@query("SELECT c_custkey, round(coalesce(s, 0), 2) AS spent FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS s FROM orders WHERE o_totalprice > 200000 GROUP BY 1) ON o_custkey = c_custkey")
def related_aggregate(t: Tables):
    customers, orders = catalog(t)["customers"], catalog(t)["orders"].where("o_totalprice", "gt", 200000)
    table = customers.has_many("big_orders", "o_custkey", lambda: orders)
    return table.related_aggregate("s", "big_orders", F.sum("o_totalprice")).select("c_custkey", F.round(F.coalesce("s", F.lit(0.0)), 2).alias("spent"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '12') ORDER BY c_custkey DESC LIMIT 5 OFFSET 5")
def model_page(t: Tables):
    table = catalog(t)["customers"].with_search("12").with_order(c("c_custkey").desc())
    return table.with_page(2, 5).df.select("c_custkey", "c_name")


@query("SELECT count(*) AS count FROM customer WHERE c_mktsegment = 'BUILDING'")
def model_count(t: Tables):
    return catalog(t)["customers"].where("c_mktsegment", "eq", "BUILDING").with_page(3).count()


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) > 1")
def derived_model(t: Tables):
    base = catalog(t)["nations"]
    return Table.derived("by_region", base, lambda df: df.groupBy("n_regionkey").agg(F.count("*").alias("n")), []).where("n", "gt", 1).df


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def qlang_filter_sort_slice(t: Tables):
    return tokens(catalog(t), "orders", "o_orderstatus:in=F,O", "[-o_totalprice:0:10]", "=o_orderkey,o_totalprice")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def qlang_relation(t: Tables):
    return tokens(catalog(t), "region", "id=2", ":nations", "=n_nationkey,n_name")


@query("SELECT max(o_totalprice) AS max FROM orders WHERE o_orderstatus = 'F'")
def qlang_aggregate(t: Tables):
    return tokens(catalog(t), "orders", "o_orderstatus=F", "@max:o_totalprice")


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'nation_1')")
def qlang_search(t: Tables):
    return tokens(catalog(t), "nations", "?NATION_1", "=n_nationkey,n_name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer UNION SELECT -c_custkey, 'new' FROM customer WHERE c_custkey <= 5")
def upsert_replace(t: Tables):
    table = t.customer.select("c_custkey", "c_name")
    rows = table.where("c_custkey % 3 = 0").unionByName(table.where("c_custkey <= 5").withColumn("c_custkey", -c("c_custkey"))).withColumn("c_name", F.lit("new"))
    return writes.replace(table, rows, "c_custkey")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def patch_rows(t: Tables):
    table = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    return writes.patch(table, table.where("c_custkey % 4 = 1").select("c_custkey", F.lit(None).cast("string").alias("c_mktsegment")), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT coalesce(nullif(c_mktsegment, 'BUILDING') = 'MACHINERY', false)")
def delete_where(t: Tables):
    return writes.delete(t.customer, F.nullif("c_mktsegment", F.lit("BUILDING")) == "MACHINERY").select("c_custkey")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, 4 FROM nation WHERE n_regionkey IS NULL OR n_regionkey = 4")
def invariant_fill(t: Tables):
    rows = t.nation.where("n_regionkey = 4").select((c("n_nationkey") + 100).alias("n_nationkey"), "n_name", F.when(c("n_nationkey") % 2 == 0, c("n_regionkey")).alias("n_regionkey"))
    return writes.WritePath(invariants={"n_regionkey": 4}).insert(t.nation, rows)


@query("SELECT n_nationkey, n_regionkey = 1 AS is_deleted FROM nation")
def soft_delete(t: Tables):
    table = t.nation.withColumn("is_deleted", F.lit(False))
    path = writes.WritePath(before_delete=lambda rows: rows.withColumn("is_deleted", F.lit(True)))
    return path.delete(table, c("n_regionkey") == 1).select("n_nationkey", "is_deleted")


@query("SELECT s_suppkey, s_name, round(s_acctbal + 1, 2) AS s_acctbal FROM supplier WHERE s_suppkey % 2 = 0")
def patch_changed(t: Tables):
    old = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    new = old.withColumn("s_acctbal", F.when(c("s_suppkey") % 2 == 0, F.round(c("s_acctbal") + 1, 2)).otherwise(c("s_acctbal")))
    return writes.changed(old, new, "s_suppkey")


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS s FROM customer GROUP BY c_mktsegment")
def aggregate_spec(t: Tables):
    keys = ("c_mktsegment",)
    out = aggregates.computed(t.customer, aggregates.AggregateSpec("count", alias="n", group_by=keys), aggregates.AggregateSpec("sum", "c_acctbal", "s", keys))
    return out.withColumn("s", F.round("s", 2))
