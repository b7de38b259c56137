"""A table: columns, conditions, orders, pages, computed columns, references. It compiles to one DataFrame."""

from __future__ import annotations

import copy
import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, predicates
from ..operators.ordering import page, window
from ..operators.relations import contained_many, contained_one, referenced


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    flags: frozenset[str] = frozenset()
    alias: str | None = None

    def has(self, flag: str) -> bool:
        return flag in self.flags


@dataclass(frozen=True)
class Reference:
    """has_one: own key to the target's id. has_many: own id to the target's key. Several keys: own names to theirs."""

    name: str
    many: bool
    key: str | dict[str, str]
    target: Callable[[], Table]

    def pairs(self, own: Table, target: Table) -> list[tuple[str, str]]:
        """Own columns and the target's that have to be equal."""
        if isinstance(self.key, dict):
            return list(self.key.items())
        return [(own._id(), self.key) if self.many else (self.key, target._id())]


def _matching(rows: DataFrame, others: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The rows whose columns all equal those of some other row."""
    keys = others.select(*[F.col(b).alias(f"__key{i}") for i, (_, b) in enumerate(pairs)])
    return rows.join(keys, [rows[a] == keys[f"__key{i}"] for i, (a, _) in enumerate(pairs)], "left_semi")


@dataclass
class Table:
    """Every `with_` method gives a new table; nothing is read before `df`."""

    name: str
    source: DataFrame
    id_column: str | None = None
    title_column: str | None = None
    columns: dict[str, ColumnSpec] = field(default_factory=dict)
    conditions: dict[int, Column | Callable[[DataFrame], Column]] = field(default_factory=dict)
    orders: dict[int, Column] = field(default_factory=dict)
    expressions: dict[str, Callable[[Table, DataFrame], Column]] = field(default_factory=dict)
    lazy: dict[str, Callable[[DataFrame], Column]] = field(default_factory=dict)
    references: dict[str, Reference] = field(default_factory=dict)
    contained: dict[str, bool] = field(default_factory=dict)
    active: tuple[str, ...] = ()
    paging: tuple[int, int] | None = None
    invariants: dict[str, object] = field(default_factory=dict)
    _handles: itertools.count = field(default_factory=itertools.count)

    def _with(self, **changes) -> Table:
        new = copy.copy(self)
        for k, v in changes.items():
            setattr(new, k, v)
        return new

    def with_column(self, name: str, *flags: str, alias: str | None = None) -> Table:
        """Flags: mandatory, hidden, id, title, searchable, indexed, orderable."""
        out = self._with(columns=self.columns | {name: ColumnSpec(name, frozenset(flags), alias)})
        if "id" in flags:
            out.id_column = name
        if "title" in flags:
            out.title_column = name
        return out

    def with_condition(self, condition: Column | Callable[[DataFrame], Column]) -> Table:
        return self._with(conditions=self.conditions | {next(self._handles): condition})

    def where(self, column: str, op: str, value=None) -> Table:
        return self.with_condition(predicates.condition(F.col(column), op, value))

    def with_id(self, value) -> Table:
        """One row; the id is an invariant of writes too."""
        return self.where(self._id(), "eq", value)._with(invariants=self.invariants | {self._id(): value})

    def add_temporary(self, condition: Column) -> int:
        """Adds a condition in place and gives a handle to remove it by."""
        handle = next(self._handles)
        self.conditions = self.conditions | {handle: condition}
        return handle

    def remove_temporary(self, handle: int) -> None:
        self.conditions = {k: v for k, v in self.conditions.items() if k != handle}

    def with_order(self, *keys: Column) -> Table:
        return self._with(orders=self.orders | {next(self._handles): k for k in keys})

    def without_orders(self) -> Table:
        return self._with(orders={})

    def with_expression(self, name: str, build: Callable[[Table, DataFrame], Column]) -> Table:
        """A column computed with the query; conditions and orders may use it."""
        return self._with(expressions=self.expressions | {name: build})

    def with_lazy_expression(self, name: str, build: Callable[[DataFrame], Column]) -> Table:
        """A column computed after the page is cut, in the order of declaration; it sees those before it."""
        return self._with(lazy=self.lazy | {name: build})

    def with_search(self, text: str) -> Table:
        """Searchable columns, or all declared ones."""
        names = [c.name for c in self.columns.values() if c.has("searchable")] or [c for c in self.columns] or self.source.columns
        return self.with_condition(lambda df: predicates.search(df, text, [n for n in names if "." not in n]))

    def with_page(self, number: int, size: int = 50) -> Table:
        return self._with(paging=((max(1, number) - 1) * size, size))

    def with_window(self, offset: int, limit: int) -> Table:
        return self._with(paging=(offset, limit))

    def has_one(self, name: str, key: str | dict[str, str], target: Callable[[], Table]) -> Table:
        return self._with(references=self.references | {name: Reference(name, False, key, target)})

    def has_many(self, name: str, key: str | dict[str, str], target: Callable[[], Table]) -> Table:
        return self._with(references=self.references | {name: Reference(name, True, key, target)})

    def contains(self, column: str, many: bool) -> Table:
        return self._with(contained=self.contained | {column: many})

    def with_active_columns(self, *names: str) -> Table:
        """Only these columns and the id; `a.b.c` is imported over has_one references."""
        return self._with(active=names)

    def _id(self) -> str:
        if self.id_column is None:
            raise ValueError(f"{self.name} has no id column")
        return self.id_column

    def _import(self, df: DataFrame, path: str) -> DataFrame:
        """A left join for each has_one step; the target's ids are unique, so rows stay as many."""
        *steps, last = path.split(".")
        table, key, at = self, None, df
        for i, step in enumerate(steps):
            ref = table.references.get(step)
            if ref is None or ref.many:
                raise ValueError(f"{table.name} has no single reference {step}")
            target, key = ref.target(), F.col(f"`{'__' + '.'.join(steps[:i]) + '.' + ref.key if i else ref.key}`")
            after = target.references.get(steps[i + 1]).key if i + 1 < len(steps) and target.references.get(steps[i + 1]) else last
            side = target.rows().select(F.col(target._id()).alias("__to"), F.col(after).alias("__value"))
            name = path if i + 1 == len(steps) else "__" + ".".join(steps[: i + 1]) + "." + after
            at = at.join(side, key == F.col("__to"), "left").drop("__to").withColumnRenamed("__value", name)
            table = target
        return at.drop(*[c for c in at.columns if c.startswith("__") and c not in df.columns])

    def rows(self) -> DataFrame:
        """Conditions and computed columns; no order, page or choice of columns."""
        df = self.source
        for name, build in self.expressions.items():
            df = df.withColumn(name, build(self, df))
        for c in self.conditions.values():
            df = df.where(c(df) if callable(c) else c)
        return df

    @property
    def df(self) -> DataFrame:
        df = self.rows()
        dotted = [c for c in self.active if "." in c]
        for path in dotted:
            df = self._import(df, path)
        if self.orders:
            df = df.orderBy(*self.orders.values())
        if self.paging:
            df = window(df, *self.paging)
        for name, build in self.lazy.items():
            df = df.withColumn(name, build(df))
        if self.active:
            own = ([self.id_column] if self.id_column and self.id_column not in self.active else []) + list(self.active)
            df = df.select(*[F.col(f"`{c}`") for c in own])
        renamed = {c.name: c.alias for c in self.columns.values() if c.alias}
        return df.withColumnsRenamed(renamed) if renamed else df

    def get_ref(self, name: str) -> Table:
        """The related rows of all rows of this table."""
        ref = self.references[name]
        target = ref.target()
        pairs = ref.pairs(self, target)
        if len(pairs) == 1:
            own, theirs = pairs[0]
            return target._with(source=referenced(target.source, theirs, self.rows(), own))
        return target._with(source=_matching(target.source, self.rows(), [(theirs, own) for own, theirs in pairs]))

    def get_ref_from_row(self, name: str, row) -> Table:
        """The related rows of one known row; written rows get its key."""
        ref = self.references[name]
        target = ref.target()
        for own, theirs in ref.pairs(self, target):
            target = target.where(theirs, "eq", row[own])
            if ref.many:
                target = target._with(invariants=target.invariants | {theirs: row[own]})
        return target

    def get_contained(self, column: str) -> DataFrame:
        keep = [self.id_column] if self.id_column else []
        return contained_many(self.rows(), keep, column) if self.contained[column] else contained_one(self.rows(), keep, column)

    def aggregate(self, **named: Column) -> DataFrame:
        """Over all rows that the conditions leave; pages don't count."""
        return self.rows().agg(*[c.alias(n) for n, c in named.items()])

    def count(self) -> DataFrame:
        return self.aggregate(count=aggregates.count())

    def related_aggregate(self, name: str, reference: str, value: Column) -> DataFrame:
        """Each row with an aggregate over its related rows: one grouped pass and a left join, not a subquery for each row."""
        ref = self.references[reference]
        target = ref.target()
        pairs, rows, theirs = ref.pairs(self, target), self.rows(), target.rows()
        if self.conditions:  # only what some row asks for is aggregated
            theirs = _matching(theirs, rows, [(b, a) for a, b in pairs])
        side = theirs.groupBy(*[F.col(b).alias(f"__key{i}") for i, (_, b) in enumerate(pairs)]).agg(value.alias(name))
        on = [rows[a] == side[f"__key{i}"] for i, (a, _) in enumerate(pairs)]
        return rows.join(side, on, "left").drop(*[f"__key{i}" for i in range(len(pairs))])

    def scalar(self, value: Column) -> Column:
        """An aggregate over all rows as an expression of another query."""
        return self.rows().agg(value).scalar()

    def add_temporary_order(self, key: Column) -> int:
        handle = next(self._handles)
        self.orders = self.orders | {handle: key}
        return handle

    def remove_temporary_order(self, handle: int) -> None:
        self.orders = {k: v for k, v in self.orders.items() if k != handle}

    def first(self) -> DataFrame:
        """The first row, or none."""
        return self.df.limit(1)

    @classmethod
    def derived(cls, name: str, base: Table, modify: Callable[[DataFrame], DataFrame], columns: list[str], references: list[str] = ()) -> Table:
        """A table over a transformed one; it inherits the listed columns and references only."""
        keep = {k: v for k, v in base.columns.items() if k in columns}
        refs = {k: v for k, v in base.references.items() if k in references}
        return cls(name, modify(base.rows()), base.id_column if base.id_column in columns else None, columns=keep, references=refs)

    def page(self, number: int, size: int = 50) -> DataFrame:
        df = self.with_window(0, 1 << 30)._with(paging=None).df
        return page(df, number, size)
