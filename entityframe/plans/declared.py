"""Tables declared as YAML or dictionaries, and the catalogue that holds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .table import Table


def parse(text: str) -> dict:
    """A YAML declaration; needs a YAML library."""
    import yaml

    return yaml.safe_load(text)


class Catalog:
    """Names to tables, with relations across sources."""

    def __init__(self, spark: SparkSession):
        self.spark, self._tables, self._made = spark, {}, {}

    def register(self, name: str, make: Callable[[], Table]) -> None:
        self._tables[name] = make

    def declare(self, spec: dict, load: Callable[[str], DataFrame]) -> None:
        """{name, source, columns: {name: {flags, alias, expr, lazy}}, references: {name: {table, kind, key}}, contained: {column: one|many}}.

        `expr` is an SQL expression computed with the query, `lazy` one computed after the page is cut.
        """

        def make() -> Table:
            table = Table(spec["name"], load(spec.get("source", spec["name"])))
            for name, c in (spec.get("columns") or {}).items():
                c = c or {}
                if "expr" in c:
                    table = table.with_expression(name, lambda t, df, e=c["expr"]: F.expr(e))
                elif "lazy" in c:
                    table = table.with_lazy_expression(name, lambda df, e=c["lazy"]: F.expr(e))
                table = table.with_column(name, *c.get("flags", ()), alias=c.get("alias"))
            for name, r in (spec.get("references") or {}).items():
                add = table.has_many if r.get("kind", "has_one") == "has_many" else table.has_one
                table = add(name, r["key"], lambda t=r["table"]: self[t])
            for name, kind in (spec.get("contained") or {}).items():
                table = table.contains(name, kind == "many")
            return table

        self.register(spec["name"], make)

    def __getitem__(self, name: str) -> Table:
        if name not in self._tables:
            raise KeyError(f"no table {name}")
        if name not in self._made:
            self._made[name] = self._tables[name]()
        return self._made[name]

    def names(self) -> list[str]:
        return sorted(self._tables)


def preview(df: DataFrame) -> str:
    """The plan of a query as text, without running it."""
    return df._jdf.queryExecution().optimizedPlan().toString()
