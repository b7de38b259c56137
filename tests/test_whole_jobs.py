"""Queries over whole tables: no row is left out."""

from pyspark.sql import functions as F

from entityframe.plans.catalogue import QUERIES


def test_every_line_is_nested(spark, sf_dir):
    rows = QUERIES["contained_many_all"](spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert rows.count() == lines.count() and rows.select("o_orderkey").distinct().count() == lines.select("l_orderkey").distinct().count()


def test_tree_reaches_every_part(spark, sf_dir):
    rows = QUERIES["recursive_tree_all"](spark, sf_dir)
    ids = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey >= 1").select("p_partkey")  # 0 is its own parent
    assert rows.select("id").exceptAll(ids).isEmpty() and ids.exceptAll(rows.select("id")).isEmpty()
    assert rows.agg(F.max("depth")).first()[0] == ids.count().bit_length() - 1


def test_every_event_is_counted(spark, sf_dir):
    rows = QUERIES["generate_series_zero_fill_all"](spark, sf_dir)
    assert rows.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert rows.where("n = 0").count() > 0  # days before and after the events


def test_every_change_is_applied(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").collect()
    table = {i: ("old", 0.0) for e in events for i in (e.user_id, -e.user_id)}
    for e in events:
        table[e.user_id] = (e.event_type, e.value)
    table = {i: v for i, v in table.items() if v[0] != "click"}
    rows = QUERIES["change_apply_latest_all"](spark, sf_dir).collect()
    assert len(rows) == len(table) and {r.id: (r.kind, r.value) for r in rows} == table
    assert any(e.event_id % 3 == 0 and table.get(e.user_id) == (e.event_type, e.value) for e in events)
