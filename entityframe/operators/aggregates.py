"""The named aggregates, with the client library's semantics, and user-defined reducers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import text_equal


def count(_: str | None = None) -> Column:
    return F.count(F.lit(1))


def count_where(**equal) -> Column:
    """Rows whose columns all equal the values, compared as text."""
    out = F.lit(True)
    for name, value in equal.items():
        out = out & text_equal(F.col(name), value)
    return F.count_if(out)


def numbers(name: str) -> Column:
    """A numeric column's cells as doubles; text and truth values are no numbers, whatever they look like."""
    c = F.col(name)
    return F.when(F.typeof(c).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$"), c.try_cast("double"))


def total(name: str) -> Column:
    """Sum as double, 0 without a number."""
    return F.coalesce(F.sum(numbers(name)), F.lit(0.0))


def average(name: str) -> Column:
    return F.avg(numbers(name))


def least(name: str) -> Column:
    return F.min(numbers(name))


def greatest(name: str) -> Column:
    return F.max(numbers(name))


def distinct(name: str) -> Column:
    """Distinct values; null counts as one value."""
    return F.count_distinct(name) + F.coalesce(F.max(F.col(name).isNull().cast("int")), F.lit(0))


def sum_integers(name: str) -> Column:
    """Sum of a cached view: an error for a value that isn't whole."""
    c = F.col(name).cast("double")
    return F.sum(F.when(c.isNull() | (c == F.floor(c)), c).otherwise(F.raise_error(F.lit(f"{name} holds a value that is no whole number")).cast("double"))).cast("long")


def whole(aggregate: Column) -> Column:
    """An aggregate rounded to a whole number, as some dialects cast sums and means."""
    return F.round(aggregate).cast("long")


CATALOGUE: dict[str, Callable[[str | None], Column]] = {"count": count, "sum": total, "avg": average, "min": least, "max": greatest, "distinct": distinct}


def register(name: str, build: Callable[[str | None], Column]) -> None:
    CATALOGUE[name] = build


def named(op: str, column: str | None = None) -> Column:
    if op not in CATALOGUE:
        raise ValueError(f"unknown aggregate {op}")
    return CATALOGUE[op](column)


def group_by(df: DataFrame, key: str, skip_nulls: bool = False, **aggregates: Column) -> DataFrame:
    """One row for each key, in the key's order; a null key forms a group unless skipped. The key's name wins."""
    rows = df.where(F.col(key).isNotNull()) if skip_nulls else df
    return rows.groupBy(key).agg(*[c.alias(n) for n, c in aggregates.items() if n != key]).orderBy(F.col(key).asc_nulls_first())


@dataclass(frozen=True)
class AggregateSpec:
    """An aggregate as data: operation, column, the name of the result and the keys that it is grouped by."""

    op: str
    column: str | None = None
    alias: str | None = None
    group_by: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return self.alias or (f"{self.op}_{self.column}" if self.column else self.op)


def computed(df: DataFrame, *specs: AggregateSpec) -> DataFrame:
    """The aggregates of one grouping in one pass; null keys form a group."""
    keys = {s.group_by for s in specs}
    if len(keys) != 1:
        raise ValueError("aggregates of one pass need the same keys")
    return df.groupBy(*keys.pop()).agg(*[named(s.op, s.column).alias(s.name) for s in specs])


def narrow(value: float | None) -> float | int | None:
    """A whole number as int, as scalar results are shown."""
    return int(value) if value is not None and value == int(value) and abs(value) < 2**53 else value


def reduce_groups(df: DataFrame, keys: list[str], reducer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's reducer over each group's rows; a group must fit a task, so built-in aggregates come first."""
    return df.groupBy(*keys).applyInPandas(reducer, schema)


def joined(column: Column | str, sep: str = ",", by: Column | None = None, unique: bool = False) -> Column:
    """A group's texts joined in order; by default in their own order."""
    c = F.col(column) if isinstance(column, str) else column
    rows = F.collect_set(c) if unique else F.collect_list(c)
    if by is None:
        return F.array_join(F.array_sort(rows), sep)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(by.alias("k"), c.alias("v")))), lambda x: x["v"])
    return F.array_join(F.array_distinct(ordered) if unique else ordered, sep)
