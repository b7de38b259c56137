"""The decisions where dialects and the in-process computations differ."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityframe.functions import temporal, text, values
from entityframe.operators import aggregates, ordering, predicates, relations, writes
from entityframe.plans.declared import Catalog
from entityframe.plans.table import Table
from entityframe.plans.tokens import query, typed
from entityframe.sources import files, paged
from entityframe.streaming import changes, views

c = F.col


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def clients(spark):
    return spark.createDataFrame([("marty", True, 150.0, "hv"), ("doc", True, 500.5, "hv"), ("biff", False, -50.25, None)], "id string, paying boolean, balance double, bakery_id string")


def test_cached_conditions_never_match_null_or_another_type(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x long")
    on = lambda op, v: [r[0] for r in rows(df.where(predicates.cached_condition(c("x"), T.LongType(), op, v)).orderBy("x"))]
    assert on("eq", 1) == [1] and on("ne", 1) == [2] and on("not_in", [1]) == [2]
    assert on("eq", 1.0) == [] and on("ne", 1.0) == [1, 2]
    assert on("in", "no list") == [] and on("not_in", "no list") == [1, 2]
    assert rows(df.where(predicates.text_equal(c("x"), "1"))) == [(1,)]


def test_age_counts_fractions_of_seconds(spark, tmp_path):
    import duckdb
    from compare import same_rows

    from entityframe.plans.catalogue import QUERIES, SQL

    times = ["2024-01-11 00:00:00.636583", "2024-01-11 00:00:00", "2024-02-29 00:00:00.000001", "2024-02-29 19:00:00", "2024-03-01 00:00:00", "2024-03-01 07:00:00", "2024-05-07 00:00:00.5", "1969-12-31 23:59:59.9", None]
    spark.createDataFrame(list(enumerate(times)), "event_id long, t string").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    same_rows(QUERIES["rfc3339_and_age"](spark, str(tmp_path)), con, SQL["rfc3339_and_age"])
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    ages = spark.createDataFrame([(t,) for t in times], "t string").select(temporal.age(c("t").cast("timestamp"), now))
    assert [r[0] for r in ages.collect()] == ["49d", "50d", "23h", "5h", "0s", "0s", "0s", "19783d", None]


def test_search_and_quick_search(spark):
    df = spark.createDataFrame([(1, "Ab", ("Zed", 12), ["q%", "w"]), (2, None, None, None)], "id long, a string, s struct<key:string,n:long>, l array<string>")
    hit = lambda cond: [r.id for r in df.where(cond).collect()]
    assert hit(predicates.search(df, "aB", ["a"])) == [1] and hit(predicates.search(df, "x", [])) == []
    assert hit(predicates.quick_search(df, "zed")) == [1] and hit(predicates.quick_search(df, "key")) == []
    assert hit(predicates.quick_search(df, "12")) == [1] and hit(predicates.quick_search(df, "12", text_only=True)) == []
    assert hit(predicates.quick_search(df, " ")) == [1, 2]
    assert hit(F.exists("l", lambda x: predicates.search_pattern(x, "%"))) == [1]


def test_nulls_last_both_ways_and_pages(spark):
    df = spark.createDataFrame([("a", 2), ("b", None), ("c", 1), ("d", 2)], "id string, x int")
    assert [r.id for r in df.orderBy(*ordering.view_order("x", "id")).collect()] == ["c", "a", "d", "b"]
    assert [r.id for r in df.orderBy(*ordering.view_order("x", "id", True)).collect()] == ["a", "d", "c", "b"]
    assert [r.id for r in ordering.page(df.orderBy("id"), 0, 2).collect()] == ["a", "b"]
    assert [r.id for r in ordering.after(df, "id", "b", 5).collect()] == ["c", "d"]


def test_aggregates_of_the_client_library(spark):
    df = spark.createDataFrame([("a", 1.0, "1"), ("a", None, None), (None, 0.0, "x"), ("b", 2.5, "2.5")], "k string, v double, t string")
    got = df.agg(aggregates.total("v").alias("s"), aggregates.average("v").alias("a"), aggregates.distinct("v").alias("d"), aggregates.count_where(k="a").alias("n")).first()
    assert tuple(got) == (3.5, pytest.approx(3.5 / 3), 4, 2)
    # text is no number, whatever it looks like
    assert tuple(df.agg(aggregates.total("t"), aggregates.average("t"), aggregates.greatest("t")).first()) == (0.0, None, None)
    assert df.where("false").agg(aggregates.total("v")).first()[0] == 0
    assert rows(aggregates.group_by(df, "k", n=aggregates.count())) == [(None, 1), ("a", 2), ("b", 1)]
    assert rows(aggregates.group_by(df, "k", skip_nulls=True, n=aggregates.count())) == [("a", 2), ("b", 1)]
    assert aggregates.narrow(3.0) == 3 and isinstance(aggregates.narrow(3.0), int) and aggregates.narrow(2.5) == 2.5
    with pytest.raises(ValueError):
        aggregates.named("nope")
    whole = spark.createDataFrame([(1.0,), (2.5,)], "x double")
    with pytest.raises(Exception, match="whole number"):
        whole.agg(aggregates.sum_integers("x")).collect()


def test_max_recovers_when_the_extreme_row_goes(clients):
    assert clients.agg(aggregates.greatest("balance")).first()[0] == 500.5
    assert writes.delete(clients, c("id") == "doc").agg(aggregates.greatest("balance")).first()[0] == 150.0


def test_text_and_dates(spark):
    one = spark.range(1)
    value = lambda x: one.select(x).first()[0]
    assert value(text.concat_ws("-", F.lit("a"), F.lit(None), F.lit("b"))) == "a-b"
    assert value(text.concat_ws("-", F.lit("a"), F.lit(None), skip_nulls=False)) is None
    assert text._jaro_winkler("marty", "marti") == pytest.approx(0.92) and text._jaro_winkler("", "a") == 0 and text._jaro_winkler(None, "a") is None
    assert str(value(temporal.add_interval(F.lit("2024-01-31").cast("date"), 1, "month").cast("date"))) == "2024-02-29"
    assert str(value(temporal.add_interval(F.lit("2024-01-31").cast("date"), 1, "month", calendar=False))) == "2024-03-01"
    assert value(temporal.day_of_week(F.lit("2024-01-01").cast("date"))) == 1
    assert value(temporal.date_format(F.lit("2024-01-05").cast("date"), "%Y it's %%")) == "2024 it's %"
    assert tuple(value(temporal.months_and_days(F.lit("2024-03-05").cast("date"), F.lit("2024-01-31").cast("date")))) == (1, 5)


def test_values(spark):
    one = spark.range(1)
    value = lambda x: one.select(x).first()[0]
    doc = F.lit('{"a": {"b": [1, "x"]}}')
    assert value(values.json_extract(doc, "a", "b", 1)) == "x" and value(values.json_extract(doc, "z")) is None
    assert value(values.json_extract(doc, "a", "b", as_json=True)) == '[1,"x"]'
    with pytest.raises(ValueError):
        values.json_extract(doc)
    assert value(values.cpu_millicores(F.lit("250m"))) == 250 and value(values.cpu_millicores(F.lit("2"))) == 2000 and value(values.cpu_millicores(F.lit("x"))) is None
    assert value(values.memory_bytes(F.lit("64Mi"))) == 64 << 20 and value(values.memory_bytes(F.lit("1k"))) == 1000
    assert value(values.in_network(F.lit("10.1.2.3"), "10.0.0.0/8")) and not value(values.in_network(F.lit("11.1.2.3"), "10.0.0.0/8"))


def test_relations(spark, clients):
    bakeries = spark.createDataFrame([("hv", "Hill Valley", 1), ("x", "X", 2)], "id string, name string, n int")
    got = relations.imported(clients, "bakery_id", bakeries, "id", bakery="name").select("id", "bakery")
    assert set(rows(got)) == {("marty", "Hill Valley"), ("doc", "Hill Valley"), ("biff", None)}
    over = relations.augment(clients, bakeries.withColumn("balance", c("n") * 1.0), {"bakery_id": "id"}, ["balance"])
    assert set(rows(over.select("id", "balance"))) == {("marty", 1.0), ("doc", 1.0), ("biff", -50.25)}
    nulls = spark.createDataFrame([(None,), ("hv",)], "k string")
    assert relations.not_in(bakeries, "id", nulls, "k").count() == 0
    assert relations.not_in(clients, "bakery_id", nulls.where("false"), "k").count() == 3
    orders = spark.createDataFrame([("o1", [("p", 2), ("q", 1)]), ("o2", [])], "id string, lines array<struct<product:string,quantity:int>>")
    assert rows(relations.contained_many(orders, ["id"], "lines")) == [("o1", 1, "p", 2), ("o1", 2, "q", 1)]


def test_table_model(spark, clients):
    bakery = Table("bakery", spark.createDataFrame([("hv", "Hill Valley")], "id string, name string")).with_column("id", "id")
    table = Table("client", clients).with_column("id", "id").with_column("balance").has_one("bakery", "bakery_id", lambda: bakery)
    paying = table.where("paying", "eq", True)
    assert paying.count().first()[0] == 2 and table.count().first()[0] == 3
    assert paying.with_page(5).count().first()[0] == 2
    handle = table.add_temporary(c("balance") < 0)
    assert table.count().first()[0] == 1
    table.remove_temporary(handle)
    assert table.count().first()[0] == 3
    assert rows(paying.get_ref("bakery").df) == [("hv", "Hill Valley")]
    got = table.with_active_columns("bakery.name").df
    assert got.columns == ["id", "bakery.name"] and ("biff", None) in rows(got)
    lazy = table.with_lazy_expression("a", lambda df: df["balance"] * 2).with_lazy_expression("b", lambda df: df["a"] + 1)
    assert lazy.where("id", "eq", "doc").df.first()["b"] == 1002.0
    assert table.with_id("doc").invariants == {"id": "doc"}
    with pytest.raises(ValueError):
        _ = table.with_active_columns("nope.name").df
    child = table.get_ref_from_row("bakery", clients.where("id = 'doc'").first())
    assert rows(child.df) == [("hv", "Hill Valley")]


def test_tokens(spark, clients):
    catalog = Catalog(spark)
    catalog.declare({"name": "clients", "columns": {"id": {"flags": ["id"]}}, "references": {"bakery": {"table": "bakeries", "key": "bakery_id"}}}, lambda _: clients)
    catalog.declare({"name": "bakeries", "columns": {"id": {"flags": ["id"]}}}, lambda _: spark.createDataFrame([("hv", 1)], "id string, n int"))
    assert rows(query(catalog, "client", "id=doc", ":bakery")) == [("hv", 1)]
    assert rows(query(catalog, "clients", "[+balance]", "[1]", "=id")) == [("marty",)]
    assert rows(query(catalog, "clients", "bakery_id:null", "=id")) == [("biff",)]
    assert rows(query(catalog, "clients", "balance:gt=0", "@sum:balance")) == [(650.5,)]
    for bad in (["@sum"], [":bakery"], ["nope=1"], ["@count", "id=doc"], ["!!"]):
        with pytest.raises(ValueError):
            query(catalog, "clients", *bad)
    assert typed("1") == 1 and typed("1.5") == 1.5 and typed("true") is True and typed("x") == "x" and typed("#[1]") == [1] and typed("1", T.StringType()) == "1"


def test_writes(spark, clients):
    new = spark.createDataFrame([("doc", 1.0), ("new", 2.0)], "id string, balance double")
    assert {r.id: (r.balance, r.paying) for r in writes.replace(clients, new, "id").collect()}["doc"] == (1.0, None)
    patched = {r.id: (r.balance, r.paying) for r in writes.patch(clients, new, "id").collect()}
    assert patched["doc"] == (1.0, True) and "new" not in patched
    assert {r.id for r in writes.delete(clients, c("bakery_id") == "hv").collect()} == {"biff"}
    path = writes.WritePath(invariants={"bakery_id": "hv"}, before={"normalize": [lambda d: d.withColumn("id", F.lower("id"))], "populate": [writes.with_ids("id")], "validate": []})
    got = path.insert(clients, spark.createDataFrame([("NEW", None), (None, "hv")], "id string, bakery_id string"))
    assert got.count() == 5 and got.where("bakery_id = 'hv'").count() == 4 and got.where("id IS NULL").count() == 0
    with pytest.raises(Exception, match="conflicts"):
        path.insert(clients, spark.createDataFrame([("n", "other")], "id string, bakery_id string")).collect()
    parent, child = writes.split_nested(spark.createDataFrame([("o", 1, 2)], "id string, `line.a` int, `line.b` int"), "line", "id")
    assert parent.columns == ["id"] and rows(child) == [("o", 1, 2)]
    assert writes.with_audit()(clients).where("created_at IS NOT NULL AND updated_at IS NOT NULL").count() == 3


def test_lenient_csv_and_log(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,n,ok,meta\na,1,true,"{""k"": 2}"\nb,x,yes,\n')
    df = files.csv(spark, str(tmp_path / "c.csv"), {"n": "bigint", "ok": "bool", "meta": "json"}, keep_raw=True)
    a, b = df.orderBy("id").collect()
    assert (a.n, a.ok, b.n, b.n_raw, b.ok) == (1, True, None, "x", None)
    assert df.select(F.try_variant_get("meta", "$.k", "bigint").alias("k")).orderBy(c("k").desc_nulls_last()).first()[0] == 2
    for _ in range(2):
        files.append_log(spark.range(2), str(tmp_path / "log"))
    assert files.json_lines(spark, str(tmp_path / "log"), "id long").count() == 4
    assert set(rows(files.generated(spark, 100, 7))) == set(rows(files.generated(spark, 100, 7, partitions=3)))


def test_paged_source(spark):
    class Fake(paged.PagedSource):
        @classmethod
        def name(cls):
            return "fake_pages"

        fetch = staticmethod(lambda url: '{"rows": [{"id": "%s", "n": 1}]}' % url)

    spark.dataSource.register(Fake)
    df = spark.read.format("fake_pages").option("url", "p{page}-{offset}").option("pages", 3).option("limit", 10).option("wrapped", "rows").schema("id string, n int").load()
    assert sorted(rows(df)) == [("p1-0", 1), ("p2-10", 1), ("p3-20", 1)]
    tries = []

    def flaky(url):
        tries.append(url)
        if len(tries) < 3:
            raise OSError
        return "[]"

    assert paged.patient(flaky, "u", sleep=lambda s: None) == "[]" and len(tries) == 3


def test_changes_are_idempotent_and_ordered(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    log = spark.createDataFrame([(3, "updated", "a", 9), (1, "updated", "a", 5), (2, "deleted", "b", None), (4, "inserted", "c", 7)], "seq long, op string, id string, v int")
    once = changes.applied(table, log)
    assert set(rows(once)) == {("a", 9), ("c", 7)} and set(rows(changes.applied(once, log))) == {("a", 9), ("c", 7)}
    broken = log.unionByName(spark.createDataFrame([(3, "invalidated", None, None)], log.schema))
    assert set(rows(changes.last_changes(broken).select("id"))) == {("c",)}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.select("event_id", "user_id", "event_type", "value").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id long, event_type string, value double").parquet(str(tmp_path / "in"))
    state = changes.TableState(spark, str(tmp_path / "live"), spark.createDataFrame([], "event_type string, n long"))
    q = views.kept_up(views.live_groups(stream, ["event_type"], n=F.count("*")), state, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert set(rows(state.current())) == set(rows(views.live_groups(events, ["event_type"], n=F.count("*"))))


def test_state_and_derived_views(spark, tmp_path):
    empty = spark.createDataFrame([], "id string, v int")
    reloaded = spark.createDataFrame([("z", 0)], "id string, v int")
    state = changes.TableState(spark, str(tmp_path / "state"), empty, lambda: reloaded)
    schema = "seq long, op string, id string, v int"
    published = []
    react = views.derived(state.current, lambda df: df.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("s")), lambda df: published.append(df.first()[0]))
    for epoch, batch in enumerate([[(1, "inserted", "a", 4)], [(2, "inserted", "b", 0)], [(3, "invalidated", None, None), (4, "updated", "a", 5)]]):
        state.batch(spark.createDataFrame(batch, schema), epoch)
        react(None, epoch)
    assert published == [4, 5]
    assert set(rows(state.current())) == {("z", 0), ("a", 5)}
    # a restart goes on from the newest version
    again = changes.TableState(spark, str(tmp_path / "state"), empty)
    again.batch(spark.createDataFrame([(9, "inserted", "n", 1)], schema), 7)
    assert set(rows(again.current())) == {("z", 0), ("a", 5), ("n", 1)}


def test_repeated_ids_and_moved_values(spark):
    table = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id int, x string, y string")
    new = spark.createDataFrame([(1, 1, "old"), (1, 2, "new")], "id int, seq int, x string")
    assert set(rows(writes.replace(table, new, "id", "seq").select("id", "x"))) == {(1, "new"), (2, "b")}
    assert set(rows(writes.patch(table, new, "id", "seq"))) == {(1, "new", None), (2, "b", None)}
    assert writes.replace(table, new.drop("seq"), "id").count() == 2
    moved = spark.createDataFrame([(1, None, "a"), (2, "b", None)], table.schema)
    assert rows(writes.changed(table, moved, "id")) == [(1, None, "a")]
    write, gone = writes.reconciled(table, moved.where("id = 1"), "id")
    assert rows(write) == [(1, None, "a")] and rows(gone) == [(2,)]
    with pytest.raises(ValueError):
        writes.patch(table, table.withColumnRenamed("x", "bakery.name"), "id")
    nested = spark.createDataFrame([("o", [("p", 2), ("q", 1)])], "id string, lines array<struct<product:string,quantity:int>>")
    parent, children = writes.split_nested_many(nested, "lines", "id")
    assert rows(parent) == [("o",)] and rows(children) == [("o", 1, "p", 2), ("o", 2, "q", 1)]
    assert rows(spark.createDataFrame([((1, 2),)], "s struct<a:int,b:int>").select(writes.merged_struct("s", {"b": F.lit(9)}).alias("s")).select("s.*")) == [(1, 9)]


def test_lookups_are_single(spark, clients):
    twice = spark.createDataFrame([("hv", "A"), ("hv", "B")], "id string, name string")
    with pytest.raises(Exception, match="several rows"):
        relations.imported(clients, "bakery_id", twice, "id", bakery="name").collect()
    with pytest.raises(Exception, match="several rows"):
        relations.augment(clients, twice, {"bakery_id": "id"}, ["name"]).collect()


def test_slices(spark):
    catalog = Catalog(spark)
    catalog.declare({"name": "numbers", "columns": {"id": {"flags": ["id"]}}}, lambda _: spark.range(10))
    ids = lambda *t: [r.id for r in query(catalog, "numbers", *t).collect()]
    assert ids("[+id]", "[:3]") == [0, 1, 2] and ids("[-id:2:4]") == [7, 6] and ids("[+id:7:]") == [7, 8, 9] and ids("[-id:1]") == [8]
    for bad in ("[]", "[99]", "[+id:99]"):
        with pytest.raises(ValueError):
            query(catalog, "numbers", bad)
    assert [r.id for r in query(catalog, "number:4").collect()] == [4]


def test_row_index(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.csv").write_text("n\n" + "".join(f"{i}{j}\n" for j in range(4)))
    got = files.csv(spark, str(tmp_path)).collect()
    assert sorted(int(r.id) for r in got) == list(range(12))


def test_pages_to_the_end_and_graphs(spark):
    pages = {0: "[1,2]", 2: "[3,4]", 4: "[5]"}

    class Open(paged.PagedSource):
        @classmethod
        def name(cls):
            return "open_pages"

        fetch = staticmethod(lambda url: '{"things": [%s]}' % ",".join('{"id": %s}' % x for x in pages[int(url)][1:-1].split(",")))

    spark.dataSource.register(Open)
    assert sorted(rows(spark.read.format("open_pages").option("url", "{offset}").option("limit", 2).schema("id int").load())) == [(i,) for i in range(1, 6)]

    class Graph(paged.GraphSource):
        @classmethod
        def name(cls):
            return "fake_graph"

        @staticmethod
        def fetch(url):
            assert "books(limit: 5, offset: 0) { id author { name } }" in url
            return '{"data": {"books": [{"id": 1, "author": {"name": "x"}}, {"id": 2, "author": null}]}}'

    spark.dataSource.register(Graph)
    graph = spark.read.format("fake_graph").option("url", "u").option("root", "books").option("limit", 5).schema("id int, `author.name` string").load()
    assert sorted(rows(graph)) == [(1, "x"), (2, None)]
    refused = OSError("no")
    refused.code, tries = 404, []

    def fetch(url):
        tries.append(url)
        raise refused

    with pytest.raises(OSError):
        paged.patient(fetch, "u", sleep=lambda s: None)
    assert len(tries) == 1


def test_trees_end(spark):
    nodes = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id int, parent int")
    roots = spark.createDataFrame([(1, 0)], "id int, depth int")
    child = lambda d: d.select("id", (c("up.depth") + 1).alias("depth"))
    assert relations.descend(nodes.where("id > 1"), "id", "parent", roots, child).count() == 3
    assert writes.vanished(nodes, nodes.where("id > 1"), "id").count() == 1


def test_addresses_beyond_their_range(spark):
    from entityframe.functions import values

    rows = spark.createDataFrame([("10.0.0.1",), ("10.0.0.256",), ("10.0.0",), (None,)], "a string")
    assert [r[0] for r in rows.select(values.in_network(F.col("a"), "10.0.0.0/8")).collect()] == [True, None, None, None]


def test_boolean_search(spark):
    from entityframe.functions import text

    rows = spark.createDataFrame([("big red cat",), ("red dog",), ("",), (None,)], "t string")
    hits = lambda q: [r[0] for r in rows.select(text.fulltext_matches(F.col("t"), q)).collect()]
    assert hits("+red -dog") == [True, False, False, False]
    assert hits("do* cat") == [True, True, False, False]
    assert hits("-dog") == hits("") == [False] * 4


def test_aggregates_of_one_pass_share_keys(spark):
    from entityframe.operators.aggregates import AggregateSpec, computed

    with pytest.raises(ValueError, match="same keys"):
        computed(spark.range(1), AggregateSpec("count"), AggregateSpec("sum", "id", group_by=("id",)))
