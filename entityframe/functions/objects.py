"""Documents, arrays and objects; any function by its name."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F


def call(name: str, *args: object) -> Column:
    """Any function of the session by name; plain values become literals."""
    return F.call_function(name, *[a if isinstance(a, Column) else F.lit(a) for a in args])


def json_has_key(document: Column, key: str) -> Column:
    """Whether a JSON object has the key at its top, whatever its value; false for null or no object."""
    return F.coalesce(F.array_contains(F.json_object_keys(document), key), F.lit(False))


def json_contains(document: Column, part: object, path: str = "$") -> Column:
    """Whether a JSON text contains `part`: each of its keys with what that contains, each element somewhere in the array,
    and scalars as they are. Null or unreadable documents contain nothing."""
    return F.coalesce(_holds(F.variant_get(F.try_parse_json(document), path, "variant"), part), F.lit(False))


def _holds(value: Column, part: object) -> Column:
    kind = F.schema_of_variant(value)
    if isinstance(part, dict):
        each = [_holds(F.try_variant_get(value, f"$['{k}']", "variant"), v) for k, v in part.items()]
        return functools.reduce(operator.and_, each, kind.startswith("OBJECT"))
    if isinstance(part, (list, tuple)):
        items = F.try_variant_get(value, "$", "array<variant>")
        each = [F.exists(items, _element(v)) for v in part]
        return functools.reduce(operator.and_, each, kind.startswith("ARRAY"))
    if part is None:
        return F.is_variant_null(value)
    if isinstance(part, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == part)
    if isinstance(part, str):
        return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == part)
    return (kind != "STRING") & (F.try_variant_get(value, "$", "double") == float(part))


def json_table(document: Column, columns: dict[str, tuple[str, str] | tuple[str, str, object] | tuple[str, str, object, object]]) -> Column:
    """Rows of a JSON array as an array of structs, to be exploded: column: (path, type[, default on empty[, on error]]).

    A path that is absent or null gives the first default, a value that isn't of the type the second.
    """
    items = F.try_variant_get(F.try_parse_json(document), "$", "array<variant>")

    def field(item: Column, name: str, path: str, kind: str, empty: object = None, error: object = None) -> Column:
        raw = F.try_variant_get(item, path, "variant")
        value = F.try_variant_get(item, path, kind)
        absent = raw.isNull() | F.is_variant_null(raw)
        return F.when(absent, F.lit(empty).cast(kind)).when(value.isNull(), F.lit(error).cast(kind)).otherwise(value).alias(name)

    return F.transform(items, lambda x: F.struct(*[field(x, name, *spec) for name, spec in columns.items()]))


def array_first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def array_len(array: Column) -> Column:
    """Elements of an array; null for null."""
    return F.when(array.isNotNull(), F.size(array))


def index_at(array: Column, i: int) -> Column:
    """The element at an index from 0, from the end if negative; null beyond."""
    return F.get(array, F.lit(i)) if i >= 0 else F.get(array, F.size(array) + F.lit(i))


def array_group(arrays: Column) -> Column:
    """Arrays of a group as one, each element once, in their order."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(arrays))))


def array_contains_all(array: Column, values: list) -> Column:
    """`@>`: the array has each of the values."""
    return functools.reduce(operator.and_, [F.array_contains(array, v) for v in values], array.isNotNull())


def inside(value: Column, array: Column | list) -> Column:
    """Whether a value is one of an array's (INSIDE, = ANY)."""
    return F.array_contains(array, value) if isinstance(array, Column) else value.isin(list(array))


def object_literal(**fields: object) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def array_literal(*values: object) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])


def object_entries(document: Column) -> Column:
    """The entries of a JSON object as array<struct<key, value>>, values as JSON texts, in the order of keys."""
    return F.array_sort(F.map_entries(F.transform_values(F.from_json(document, "map<string,variant>"), lambda k, v: F.to_json(v))))


def object_values(document: Column) -> Column:
    """The values of a JSON object as JSON texts, in the order of keys."""
    return F.transform(object_entries(document), lambda e: e["value"])


def field(document: Column, path: str, kind: str = "string") -> Column:
    """A field of a JSON object: the key as it is, dots included, else the dotted path."""
    value = F.try_parse_json(document)
    dotted = "$" + "".join(f"['{p}']" for p in path.split("."))
    return F.coalesce(F.try_variant_get(value, f"$['{path}']", kind), F.try_variant_get(value, dotted, kind))


def _element(part: object):
    return lambda x: F.coalesce(_holds(x, part), F.lit(False))


#: Kinds of values from low to high.
KINDS = ("null", "bool", "number", "text", "bytes", "array", "map")


def cross_kind_key(document: Column) -> Column:
    """A sort key of JSON values of mixed kinds: null, truth values, numbers, texts, arrays, objects, each in its own order."""
    value = F.try_parse_json(document)
    kind = F.schema_of_variant(value)
    rank = F.when(value.isNull() | F.is_variant_null(value), 0).when(kind == "BOOLEAN", 1).when(kind == "STRING", 3).when(kind.startswith("ARRAY"), 5).when(kind.startswith("OBJECT"), 6).otherwise(2)
    return F.struct(
        rank.alias("kind"), F.when(rank == 1, F.try_variant_get(value, "$", "boolean")).alias("b"), F.when(rank == 2, F.try_variant_get(value, "$", "double")).alias("n"),
        F.when(rank == 3, F.try_variant_get(value, "$", "string")).when(rank > 3, F.to_json(value)).alias("t"))
