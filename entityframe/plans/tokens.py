"""A query as a few tokens from left to right: `orders o_orderstatus:in=F,O [-o_totalprice:0:10] =o_orderkey,o_totalprice`."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggregates, predicates
from ..operators.ordering import order
from .declared import Catalog
from .table import Table


def typed(text: str, kind: T.DataType | None = None):
    """A token's value as the column's type, else as whole number, number, truth value or text."""
    if text.startswith("#"):
        return json.loads(text[1:])
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BooleanType):
        return text == "true"
    for make in (int, float):
        try:
            return make(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text, text)


class Query:
    """What the tokens have built so far."""

    def __init__(self, catalog: Catalog, model: str):
        self.single = model not in catalog.names() and f"{model}s" in catalog.names()
        self.table: Table = catalog[f"{model}s" if self.single else model]
        self.columns: list[str] | None = None
        self.result: DataFrame | None = None
        self.must: str | None = None

    def kind(self, name: str) -> T.DataType | None:
        fields = {f.name: f.dataType for f in self.table.rows().schema.fields}
        if name not in fields:
            raise ValueError(f"{self.table.name} has no column {name}")
        return fields[name]

    def column(self, name: str) -> str:
        return self.table.id_column if name == "id" and self.table.id_column else name

    def apply(self, token: str) -> None:
        if self.result is not None:
            raise ValueError("an aggregate must come last")
        if m := re.fullmatch(r"@(count|sum|max|min|avg|distinct)(?::(\w+))?", token):
            op, name = m.groups()
            if op != "count" and not name:
                raise ValueError(f"@{op} needs a column")
            self.result = self.table.aggregate(**{op: aggregates.named(op, name)})
        elif token.startswith("?"):
            self.table = self.table.with_search(token[1:])
        elif token.startswith("="):
            self.columns = token[1:].split(",")
        elif token.startswith("["):
            self.slice(token)
        elif token.startswith(":"):
            self.traverse(token[1:])
        elif m := re.fullmatch(r"(\w+):(null|notnull)", token):
            self.table = self.table.where(self.column(m[1]), {"null": "is_null", "notnull": "not_null"}[m[2]])
        elif m := re.fullmatch(r"(\w+):(ne|lt|lte|gt|gte|like|in)=(.*)", token, re.S):
            name = self.column(m[1])
            value = [typed(x, self.kind(name)) for x in m[3].split(",")] if m[2] == "in" else typed(m[3], self.kind(name))
            self.table = self.table.where(name, m[2], value)
        elif m := re.fullmatch(r"(\w+)=(.*)", token, re.S):
            name = self.column(m[1])
            self.table = self.table.with_condition(predicates.condition(F.col(name), "eq", typed(m[2], self.kind(name))))
            self.single |= m[1] == "id"
        else:
            raise ValueError(f"unknown token {token}")

    def slice(self, token: str) -> None:
        m = re.fullmatch(r"\[(?:([+-])(\w+)(?::(?=\d|:))?)?(\d*)(:?)(\d*)\]", token)
        if not m or token == "[]":
            raise ValueError(f"unknown token {token}")
        sign, name, first, colon, last = m.groups()
        if name:
            self.table = self.table.without_orders().with_order(order(self.column(name), sign == "-", "last"), *([order(self.table.id_column)] if self.table.id_column else []))
        if colon:
            start = int(first or 0)
            self.table = self.table.with_window(start, max(0, int(last) - start) if last else (1 << 31) - 1 - start)
        elif first:
            self.table, self.single, self.must = self.table.with_window(int(first), 1), True, f"{token} is beyond the last row"

    def traverse(self, name: str) -> None:
        if not self.single:
            raise ValueError(f":{name} needs a single row before it")
        ref = self.table.references.get(name)
        if ref is None:
            raise ValueError(f"{self.table.name} has no reference {name}")
        one = self.table._with(source=self.table.df.limit(1), conditions={}, orders={}, paging=None, expressions={})
        self.table, self.single, self.columns = one.get_ref(name), not ref.many, None

    def df(self) -> DataFrame:
        if self.result is not None:
            return self.result
        out = self.table.df.limit(1) if self.single else self.table.df
        if self.must:
            if out.isEmpty():
                raise ValueError(self.must)
        return out.select(*self.columns) if self.columns else out


def query(catalog: Catalog, model: str, *tokens: str) -> DataFrame:
    model, _, located = model.partition(":")  # `orders:7` is the row with that id
    q = Query(catalog, model)
    if located:
        q.apply(f"id={located}")
    for t in tokens:
        q.apply(t)
    return q.df()
