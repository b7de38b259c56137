"""File sources: parquet, delimited text with a lenient typed reading, JSON lines; the append-only log sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None, id_column: str | None = None, renamed: dict[str, str] | None = None, keep_raw: bool = False, multi_line: bool = False) -> DataFrame:
    """Delimited text with a header. Declared columns are read as their type; a cell that doesn't parse is null, and with
    `keep_raw` its text stays in `<column>_raw`. Truth values are `true` and `false` only; other columns stay text. Without
    an id column in the file, rows get their index from 0 as `id`. `multi_line` allows line breaks inside quotes, which
    makes every file one task.
    """
    df = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    df = df.withColumnsRenamed(renamed or {})
    for name, kind in (columns or {}).items():
        raw = F.col(f"`{name}`")
        match kind:
            case "bool" | "boolean":
                value = F.when(raw.isin("true", "false"), raw == "true")
            case "json":
                value = F.try_parse_json(raw)
            case "string":
                value = F.coalesce(raw, F.lit(""))
            case _:
                value = F.trim(raw).try_cast(kind)
        if keep_raw:
            df = df.withColumn(f"{name}_raw", raw)
        df = df.withColumn(name, value)
    if id_column is None and "id" not in df.columns:
        df = row_index(df, "id").withColumn("id", F.col("id").cast("string"))
    return df


def row_index(df: DataFrame, name: str) -> DataFrame:
    """Rows numbered from 0 in the order of the files: counts of the partitions first, then places within them."""
    counts = df.groupBy(F.spark_partition_id().alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = counts.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__base"))
    at = df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return at.join(F.broadcast(bases), "__part").withColumn(name, F.col("__at") + F.col("__base")).drop("__part", "__at", "__base")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows as JSON lines behind those that are there."""
    df.write.mode("append").json(path)


def memory(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def generated(spark: SparkSession, n: int, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """Seeded synthetic rows (id, name, amount, active), made where they are used."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    h = lambda k: F.xxhash64("id", F.lit(seed), F.lit(k))
    return ids.select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("name-"), F.lower(F.hex(F.pmod(h(1), F.lit(1 << 24))))).alias("name"),
        (F.pmod(h(2), F.lit(100_000)) / 100).alias("amount"), (F.pmod(h(3), F.lit(2)) == 0).alias("active"))
