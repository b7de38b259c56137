"""Orders and pages. Pages need an order that is total: the id comes last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(column: Column | str, descending: bool = False, nulls: str | None = None) -> Column:
    """One sort key; nulls "first", "last" or None for Spark's own place (low)."""
    c = F.col(column) if isinstance(column, str) else column
    direction = "desc" if descending else "asc"
    return getattr(c, direction if nulls is None else f"{direction}_nulls_{nulls}")()


#: Where a dialect puts nulls in ascending order; descending turns it round.
NULLS_LOW = {"sqlite": True, "mysql": True, "postgres": False}


def dialect_order(column: Column | str, dialect: str, descending: bool = False) -> Column:
    return order(column, descending, "first" if NULLS_LOW[dialect] != descending else "last")


def view_order(column: str, id_column: str, descending: bool = False) -> list[Column]:
    """Of live views: nulls last in both directions, ties by id."""
    return [order(column, descending, "last"), order(id_column)]


def page(df: DataFrame, number: int, size: int = 50) -> DataFrame:
    """Page `number` from 1, smaller numbers count as 1; df is ordered."""
    return df.offset((max(1, number) - 1) * size).limit(size)


def window(df: DataFrame, offset: int, limit: int) -> DataFrame:
    return df.offset(max(0, offset)).limit(limit)


def after(df: DataFrame, id_column: str, last_id, size: int) -> DataFrame:
    """The next page by key: no rows before it are read again, however deep the page."""
    rows = df if last_id is None else df.where(F.col(id_column) > last_id)
    return rows.orderBy(id_column).limit(size)


def first_by(df: DataFrame, keys: list[str], *by: Column) -> DataFrame:
    """The first row of each key in an order (DISTINCT ON)."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("__rank = 1").drop("__rank")
