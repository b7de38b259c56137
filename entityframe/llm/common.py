"""Helpers that the corpus operators share: the shared folder, written intermediate tables and prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import new_folder, shared_dir, written
from ..shipping import ship

__all__ = ["BLANKS", "new_folder", "prefix_sums", "read_table", "shared_dir", "ship", "written"]

#: Word separators of all operators on words.
BLANKS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefix_sums(df: DataFrame, order: str, value: str, out: str, within: tuple[str, ...] = (), tie: Column | None = None, bits: int = 12) -> DataFrame:
    """Adds `out`, the sum of `value` over all rows before this one in the order of the long column `order`.

    Three levels of windows over ranges of 2^bits and 2^(2 bits) order values replace the one window over all rows,
    so no task gets more than a range of the order, however large the table; only ranges' sums meet in the upper levels.
    The order values should span 3 * bits bits, as hashes cut to that length do: the uppermost level holds what is above
    2 * bits. Equal order values are ordered by `tie`.
    """
    block, top, base, high = f"__{out}_block", f"__{out}_top", f"__{out}_base", f"__{out}_high"
    df = df.withColumn(block, F.shiftright(order, bits))
    sums = df.groupBy(*within, block).agg(F.sum(value).alias("__v")).withColumn(top, F.shiftright(block, bits))
    tops = sums.groupBy(*within, top).agg(F.sum("__v").alias("__t"))
    before = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*[F.col(c).alias(f"__w_{c}") for c in within], F.col(top).alias("__top"), F.coalesce(F.sum("__t").over(before(*within, by=top)), F.lit(0)).alias(high))
    sums = sums.withColumn(base, F.coalesce(F.sum("__v").over(before(*within, top, by=block)), F.lit(0)))
    same = sums[top].eqNullSafe(tops["__top"])
    for c in within:
        same = same & sums[c].eqNullSafe(tops[f"__w_{c}"])
    sums = sums.join(tops, same).select(*[F.col(c).alias(f"__x_{c}") for c in within], F.col(block).alias("__block"), (F.col(base) + F.col(high)).alias("__before"))
    on = df[block].eqNullSafe(sums["__block"])
    for c in within:
        on = on & df[c].eqNullSafe(sums[f"__x_{c}"])
    w = Window.partitionBy(*within, block).orderBy(F.col(order), *([tie] if tie is not None else [])).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn(base, F.coalesce(F.sum(value).over(w), F.lit(0)))
        .join(sums, on)
        .withColumn(out, F.col(base) + F.col("__before"))
        .drop(block, base, "__block", "__before", *[f"__x_{c}" for c in within])
    )
