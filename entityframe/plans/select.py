"""A query that is put together in any order and compiles to one DataFrame in SQL's order."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import window
from .table import Table


def _rows(source: DataFrame | Table, alias: str | None) -> DataFrame:
    df = source.df if isinstance(source, Table) else source
    return df.alias(alias) if alias else df


@dataclass(frozen=True)
class Select:
    """Every method gives a new query: sources and joins, conditions, groups, having, fields, sets, order and window."""

    source: DataFrame
    joins: tuple = ()
    conditions: tuple[Column, ...] = ()
    groups: tuple[Column, ...] | None = None
    aggregates: tuple[Column, ...] = ()
    having_: tuple[Column, ...] = ()
    fields_: tuple[Column, ...] = ()
    omitted: tuple[str, ...] = ()
    unique: bool = False
    sets: tuple = ()
    orders: tuple[Column, ...] = ()
    slice_: tuple[int, int] | None = None

    @classmethod
    def from_(cls, source: DataFrame | Table | Select, alias: str | None = None) -> Select:
        return cls(_rows(source.df if isinstance(source, Select) else source, alias))

    def join(self, source: DataFrame | Table | Select, on: Column, how: str = "inner", alias: str | None = None) -> Select:
        return replace(self, joins=(*self.joins, (_rows(source.df if isinstance(source, Select) else source, alias), on, how)))

    def left_join(self, source: DataFrame | Table | Select, on: Column, alias: str | None = None) -> Select:
        return self.join(source, on, "left", alias)

    def where(self, *conditions: Column) -> Select:
        return replace(self, conditions=self.conditions + conditions)

    def fields(self, *fields: Column | str) -> Select:
        return replace(self, fields_=self.fields_ + tuple(F.col(f) if isinstance(f, str) else f for f in fields))

    def clear_fields(self) -> Select:
        return replace(self, fields_=())

    def without(self, *names: str) -> Select:
        """All fields but these."""
        return replace(self, omitted=self.omitted + names)

    def group_by(self, *keys: Column | str) -> Select:
        return replace(self, groups=(self.groups or ()) + tuple(F.col(k) if isinstance(k, str) else k for k in keys))

    def aggregate(self, **named: Column) -> Select:
        return replace(self, groups=self.groups or (), aggregates=self.aggregates + tuple(c.alias(n) for n, c in named.items()))

    def having(self, *conditions: Column) -> Select:
        """Over the names of keys and aggregates."""
        return replace(self, having_=self.having_ + conditions)

    def distinct(self) -> Select:
        return replace(self, unique=True)

    def union(self, other: Select | DataFrame, all: bool = False) -> Select:  # noqa: A002
        return replace(self, sets=(*self.sets, (other.df if isinstance(other, Select) else other, all)))

    def order_by(self, *keys: Column) -> Select:
        return replace(self, orders=self.orders + keys)

    def clear_orders(self) -> Select:
        return replace(self, orders=())

    def limit(self, n: int, offset: int = 0) -> Select:
        return replace(self, slice_=(offset, n))

    @property
    def df(self) -> DataFrame:
        df = self.source
        for other, on, how in self.joins:
            df = df.join(other, on, how)
        for condition in self.conditions:
            df = df.where(condition)
        if self.groups is not None:
            df = df.groupBy(*self.groups).agg(*self.aggregates) if self.aggregates else df.select(*self.groups).distinct()
            for condition in self.having_:
                df = df.where(condition)
        if self.fields_:
            df = df.select(*self.fields_)
        if self.omitted:
            df = df.drop(*self.omitted)
        if self.unique:
            df = df.distinct()
        for other, all_ in self.sets:
            df = df.unionAll(other) if all_ else df.unionAll(other).distinct()
        if self.orders:
            df = df.orderBy(*self.orders)
        return window(df, *self.slice_) if self.slice_ else df

    def value(self, name: str) -> DataFrame:
        """SELECT VALUE: one field alone."""
        return self.df.select(name)

    def only(self) -> DataFrame:
        """FROM ONLY: one row, an error if there are more; none stays none."""
        rows = self.df.limit(2)
        n = rows.agg(F.count(F.lit(1))).scalar()
        return rows.where(F.when(n <= 1, F.lit(True)).otherwise(F.raise_error(F.lit("the query has several rows")).cast("boolean")))

    def scalar(self) -> Column:
        """The query's one value as an expression of another query; null without a row."""
        return self.df.scalar()

    def exists(self) -> Column:
        return self.df.exists()

    def preview(self) -> str:
        """The optimised plan as text."""
        return self.df._jdf.queryExecution().optimizedPlan().toString()
