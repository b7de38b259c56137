"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import temporal, text, values
from .base import Tables, query

c = F.col


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS done FROM orders")
def case_iif(t: Tables):
    size = values.case((c("o_totalprice") > 200000, "big"), (c("o_totalprice") > 50000, "mid"), otherwise="small")
    return t.orders.select("o_orderkey", size.alias("size"), values.iif(c("o_orderstatus") == "F", 1, 0).alias("done"))


@query("SELECT c_custkey, concat_ws('-', c_name, nullif(c_mktsegment, 'BUILDING')) AS skipping, c_name || '-' || nullif(c_mktsegment, 'BUILDING') AS strict FROM customer")
def concat_ws(t: Tables):
    seg = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return t.customer.select("c_custkey", text.concat_ws("-", c("c_name"), seg).alias("skipping"), text.concat_ws("-", c("c_name"), seg, skip_nulls=False).alias("strict"))


@query("SELECT p_partkey, nullif(p_size, 5) AS size, CAST(p_size AS VARCHAR) AS as_text, TRY_CAST(substr(p_brand, 7) AS BIGINT) AS brand_no FROM part")
def nullif_cast(t: Tables):
    return t.part.select("p_partkey", F.nullif("p_size", F.lit(5)).alias("size"), c("p_size").cast("string").alias("as_text"), F.substring("p_brand", 7, 100).try_cast("bigint").alias("brand_no"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y at %H:%M:%S') AS d FROM orders")
def date_format(t: Tables):
    return t.orders.select("o_orderkey", temporal.date_format(c("o_orderdate"), "%d/%m/%Y at %H:%M:%S").alias("d"))


@query("SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, CAST(extract(dow FROM o_orderdate) AS INTEGER) AS dow, CAST(epoch(o_orderdate) AS BIGINT) AS secs FROM orders")
def date_trunc_extract(t: Tables):
    d = c("o_orderdate")
    return t.orders.select("o_orderkey", F.date_format(F.date_trunc("month", d), "yyyy-MM-dd").alias("m"), F.year(d).alias("y"), temporal.day_of_week(d).alias("dow"), F.unix_timestamp(d).alias("secs"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS later, strftime(CAST(o_orderdate AS DATE) + 60, '%Y-%m-%d') AS days_later FROM orders")
def interval_add(t: Tables):
    later, days = temporal.add_interval(c("o_orderdate"), 1, "month"), temporal.add_interval(c("o_orderdate"), 2, "month", calendar=False)
    return t.orders.select("o_orderkey", F.date_format(later, "yyyy-MM-dd").alias("later"), F.date_format(days, "yyyy-MM-dd").alias("days_later"))


@query("SELECT o_orderkey, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS days FROM orders")
def last_day_diff(t: Tables):
    return t.orders.select("o_orderkey", F.date_format(F.last_day("o_orderdate"), "yyyy-MM-dd").alias("month_end"), F.datediff(F.lit("2002-01-01").cast("date"), "o_orderdate").alias("days"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(t: Tables):
    return t.events.select("event_id", values.json_extract(c("props"), "k").cast("bigint").alias("k"))


@query("SELECT event_id, k, coalesce(k, -1) % 2 AS odd FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def json_table(t: Tables):
    rows = t.events.select("event_id", F.from_json("props", "k bigint").alias("j")).select("event_id", "j.k")
    return rows.withColumn("odd", F.coalesce("k", F.lit(-1)) % 2)


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS norm2, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive FROM embeddings")
def array_fold_map_filter(t: Tables):
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    return t.embeddings.select("vec_id", F.round(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x), 4).alias("norm2"), F.size(F.filter("embedding", lambda x: x > 0)).alias("positive"))


@query("SELECT p_partkey, CAST(i AS INTEGER) AS i, w[i] AS word FROM (SELECT p_partkey, string_split(p_name, ' ') AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)")
def explode_ordinality(t: Tables):
    return t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "word")).withColumn("i", c("i") + 1)


@query("SELECT p_partkey, round(p_retailprice, 1) AS r, p_size // 7 AS q, p_size % 7 AS m, round(sqrt(p_size), 6) AS root FROM part")
def round_math(t: Tables):
    return t.part.select("p_partkey", F.round("p_retailprice", 1).alias("r"), F.floor(c("p_size") / 7).cast("int").alias("q"), (c("p_size") % 7).alias("m"), F.round(F.sqrt("p_size"), 6).alias("root"))


@query("SELECT p_partkey, to_hex(CAST(p_size AS BIGINT)) AS h, to_binary(CAST(p_size AS BIGINT)) AS b, CAST(bit_count(p_size) AS INTEGER) AS n FROM part")
def hex_bit(t: Tables):
    return t.part.select("p_partkey", F.hex("p_size").alias("h"), F.bin("p_size").alias("b"), F.bit_count("p_size").alias("n"))


@query("SELECT o_orderkey, CAST(coalesce(list_position(['F', 'O', 'P'], o_orderstatus), 0) AS INTEGER) AS at, CASE WHEN o_orderstatus IN ('O', 'P') THEN 1 ELSE 0 END AS listed FROM orders")
def find_in_set_field(t: Tables):
    return t.orders.select("o_orderkey", text.field_position(c("o_orderstatus"), "F", "O", "P").alias("at"), (F.find_in_set("o_orderstatus", F.lit("O,P")) > 0).cast("int").alias("listed"))


@query("""WITH d AS (SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(g, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS g) LEFT JOIN d ON d.day = strftime(g, '%Y-%m-%d')""")
def generate_series_zero_fill(t: Tables):
    return _daily_counts(t, t.events)


@query("""WITH d AS (SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(g, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS g) LEFT JOIN d ON d.day = strftime(g, '%Y-%m-%d')""")
def generate_series_zero_fill_all(t: Tables):
    """All events of each day."""
    return _daily_counts(t, t.events)


def _daily_counts(t: Tables, events):
    days = t.spark.range(1).select(F.explode(F.sequence(F.lit("2023-12-25").cast("date"), F.lit("2024-02-05").cast("date"))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    counts = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT a.n_name AS a, b.n_name AS b, round(jaro_winkler_similarity(a.n_name, b.n_name), 6) AS s FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey")
def jaro_winkler(t: Tables):
    pairs = t.nation.select(c("n_name").alias("a"), "n_regionkey").join(t.nation.select(c("n_name").alias("b"), c("n_regionkey").alias("k")), c("n_regionkey") == c("k"))
    return pairs.select("a", "b", F.round(text.jaro_winkler("a", "b"), 6).alias("s"))


@query("SELECT p_partkey, len(list_filter(list_distinct(string_split(lower(p_type), ' ')), lambda w: w IN ('a', 'economy', 'tin'))) AS score FROM part")
def fulltext_score(t: Tables):
    return t.part.select("p_partkey", text.fulltext_score(c("p_type"), "economy TIN a").cast("long").alias("score"))


@query("SELECT c_custkey, (c_custkey % 256) < 128 AS inside FROM customer")
def address_in_network(t: Tables):
    address = F.concat_ws(".", F.lit("10"), F.lit("1"), F.lit("2"), (c("c_custkey") % 256).cast("string"))
    return t.customer.select("c_custkey", values.in_network(address, "10.1.2.0/25").alias("inside"))


@query("SELECT p_partkey, CAST(p_size * 1048576 AS BIGINT) AS bytes, CAST(p_size AS BIGINT) AS millicores FROM part")
def quantities(t: Tables):
    size = c("p_size").cast("string")
    return t.part.select("p_partkey", values.memory_bytes(F.concat(size, F.lit("Mi"))).alias("bytes"), values.cpu_millicores(F.concat(size, F.lit("m"))).alias("millicores"))


@query("SELECT n_nationkey, CAST(round(2 * 6370986 * asin(sqrt(pow(sin(radians(n_nationkey * 2 - 10) / 2), 2) + cos(radians(10)) * cos(radians(n_nationkey * 2)) * pow(sin(radians(n_nationkey * 3 - 5) / 2), 2)))) AS BIGINT) AS metres FROM nation")
def sphere_distance(t: Tables):
    a = F.struct(F.lit(5.0).alias("x"), F.lit(10.0).alias("y"))
    b = F.struct((c("n_nationkey") * 3.0).alias("x"), (c("n_nationkey") * 2.0).alias("y"))
    return t.nation.select("n_nationkey", F.round(values.haversine(a, b)).cast("long").alias("metres"))


@query("SELECT o_orderkey, (CAST(o_orderdate AS DATE) < DATE '1996-06-01' AND DATE '1996-01-01' < CAST(o_orderdate AS DATE) + 30) AS meets FROM orders")
def date_ranges_overlap(t: Tables):
    d = c("o_orderdate").cast("date")
    own = F.struct(d.alias("lo"), F.date_add(d, 30).alias("hi"))
    other = F.struct(F.lit("1996-01-01").cast("date").alias("lo"), F.lit("1996-06-01").cast("date").alias("hi"))
    return t.orders.select("o_orderkey", temporal.ranges_overlap(own, other).alias("meets"))
