"""Conditions. Three families of equality are kept apart: SQL's, the strict one of cached rows, and that after rendering as text."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SQL_OPS = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def condition(column: Column, op: str, value) -> Column:
    """SQL semantics: eq, ne, gt, gte, lt, lte, in, not_in, like, ilike, regexp, contains, starts_with, between, inside,
    is_null, not_null; ne_or_null also holds for a null, and not negates a condition given as the column."""
    match op:
        case "in":
            return column.isin(list(value))
        case "not_in":
            return ~column.isin(list(value))
        case "like" | "ilike":
            return getattr(column, op)(value)
        case "regexp":
            return column.rlike(value)
        case "contains":
            return F.array_contains(column, value)
        case "starts_with":
            return column.startswith(value)
        case "between":
            return column.between(*value)
        case "inside":
            return F.array_contains(value, column) if isinstance(value, Column) else column.isin(list(value))
        case "ne_or_null":
            return column.isNull() | (column != value)
        case "not":
            return ~column
        case "is_null":
            return column.isNull()
        case "not_null":
            return column.isNotNull()
    if op not in SQL_OPS:
        raise ValueError(f"unknown operator {op}")
    return SQL_OPS[op](column, value)


def cached_condition(column: Column, kind: T.DataType, op: str, value) -> Column:
    """Of cached rows: nothing holds for a null, not even ne and not_in; values of another type than the column's are never equal."""
    fits = {T.StringType: str, T.BooleanType: bool, T.LongType: int, T.IntegerType: int, T.ShortType: int, T.DoubleType: float, T.FloatType: float}
    want = fits.get(type(kind), object)
    same = lambda v: (type(v) is want) if want is not object else True
    if op in ("in", "not_in"):
        if not isinstance(value, (list, tuple, set)):
            return F.lit(False) if op == "in" else column.isNotNull()
        own = [v for v in value if same(v)]
        hit = column.isin(own) if own else F.lit(False)
        return column.isNotNull() & (hit if op == "in" else ~hit)
    if op in ("eq", "ne") and not same(value):
        return F.lit(False) if op == "eq" else column.isNotNull()
    return column.isNotNull() & condition(column, op, value)


def text_equal(column: Column, value) -> Column:
    """Equal after both are rendered as text; never for null."""
    return F.coalesce(column.cast("string") == F.lit(value).cast("string"), F.lit(False))


def any_of(*conditions: Column) -> Column:
    return functools.reduce(operator.or_, conditions) if conditions else F.lit(False)


def all_of(*conditions: Column) -> Column:
    return functools.reduce(operator.and_, conditions) if conditions else F.lit(True)


def search(df: DataFrame, text: str, columns: list[str]) -> Column:
    """The text occurs in one of the columns, without regard to case; no columns: never."""
    return any_of(*[F.coalesce(F.lower(F.col(f"`{c}`").cast("string")).contains(text.lower()), F.lit(False)) for c in columns])


def search_pattern(column: Column, text: str, escape: str = "$") -> Column:
    """The case-sensitive LIKE form, with the text's own wildcards escaped."""
    for c in (escape, "%", "_"):
        text = text.replace(c, escape + c)
    return F.like(column.cast("string"), F.lit(f"%{text}%"), F.lit(escape))


def quick_search(df: DataFrame, text: str, text_only: bool = False) -> Column:
    """The text occurs in any value at any depth, keys left out; a blank text: always. text_only leaves other types out."""
    if not text.strip():
        return F.lit(True)
    needle = text.lower()

    def leaf(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return any_of(*[leaf(column.getField(f.name), f.dataType) for f in kind.fields])
        if isinstance(kind, T.ArrayType):
            return F.exists(column, lambda x: leaf(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.exists(F.map_values(column), lambda x: leaf(x, kind.valueType))
        if text_only and not isinstance(kind, T.StringType):
            return F.lit(False)
        return F.coalesce(F.lower(column.cast("string")).contains(needle), F.lit(False))

    return any_of(*[F.coalesce(leaf(F.col(f"`{f.name}`"), f.dataType), F.lit(False)) for f in df.schema.fields])
