"""Joins that relations stand for, graph hops, and rows inside rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def referenced(target: DataFrame, target_key: str, source: DataFrame, source_key: str) -> DataFrame:
    """Rows of the target whose key some row of the source has; keys may repeat on either side."""
    keys = source.select(F.col(source_key).alias("__key"))
    return target.join(keys, target[target_key] == keys["__key"], "left_semi")


def not_in(target: DataFrame, target_key: str, source: DataFrame, source_key: str) -> DataFrame:
    """SQL's NOT IN: no row at all if the source has a null, and none for a null of the target unless the source is empty."""
    keys = source.select(F.col(source_key).alias("__key"))
    left = target.join(keys, target[target_key] == keys["__key"], "left_anti")  # an equi-join; nulls are counted apart
    n, nulls = keys.agg(F.count(F.lit(1))).scalar(), keys.agg(F.count_if(F.col("__key").isNull())).scalar()
    return left.where((n == 0) | ((nulls == 0) & F.col(target_key).isNotNull()))


def single(side: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The rows of `side`, an error where a key repeats: a lookup may not multiply rows."""
    values = [c for c in side.columns if c not in keys]
    once = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(F.lit(True).alias("__one"), *values)).alias("__row"))
    row = F.when(F.col("__n") == 1, F.col("__row")).otherwise(F.raise_error(F.lit(f"{what} has several rows for one key")))
    return once.select(*keys, row.alias("__row")).select(*keys, *[F.col("__row").getField(v).alias(v) for v in values])


def imported(df: DataFrame, key: str, target: DataFrame, target_id: str, **columns: str) -> DataFrame:
    """Columns of the row that the key refers to, null without one; an id that repeats is an error."""
    side = single(target.select(F.col(target_id).alias("__id"), *[F.col(c).alias(n) for n, c in columns.items()]).where("__id IS NOT NULL"), ["__id"], target_id)
    return df.join(side, df[key] == side["__id"], "left").drop("__id")


def augment(df: DataFrame, detail: DataFrame, on: dict[str, str], columns: list[str]) -> DataFrame:
    """Lifts columns of at most one detail row, several are an error; where there is one its values win, nulls included."""
    side = detail.select(*[F.col(d).alias(f"__{d}") for d in on.values()], F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in columns])
    side = single(side, [f"__{d}" for d in on.values()], "the detail")
    cond = None
    for own, theirs in on.items():
        c = df[own] == side[f"__{theirs}"]
        cond = c if cond is None else cond & c
    out = df.join(side, cond, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(df[c]) if c in df.columns else F.col(f"__new_{c}"))
    return out.drop("__hit", *[f"__{d}" for d in on.values()], *[f"__new_{c}" for c in columns])


def contained_many(df: DataFrame, keep: list[str], column: str, position: str = "position", outer: bool = False) -> DataFrame:
    """The structs of an array column as rows of their own, with their place from 1."""
    explode = F.posexplode_outer if outer else F.posexplode
    rows = df.select(*keep, explode(column).alias("__at", "__row"))
    return rows.select(*keep, (F.col("__at") + 1).alias(position), "__row.*")


def contained_one(df: DataFrame, keep: list[str], column: str) -> DataFrame:
    """The struct column as a row of its own; rows without one go."""
    return df.where(F.col(column).isNotNull()).select(*keep, f"{column}.*")


def hop(nodes: DataFrame, node: str, edges: DataFrame, start: str, end: str) -> DataFrame:
    """The nodes one edge further on, each once."""
    side = edges.select(F.col(start).alias("__s"), F.col(end).alias("__e"))
    return nodes.join(side, nodes[node] == side["__s"]).select(F.col("__e").alias(node)).distinct()


def reachable(nodes: DataFrame, node: str, edges: DataFrame, start: str, end: str, least: int, most: int) -> DataFrame:
    """(root, node, depth) for least to most edges along; a path may revisit a node at another depth, so `most` bounds cycles."""
    side = edges.select(F.col(start).alias("__s"), F.col(end).alias("__e"))
    at, out = nodes.select(F.col(node).alias("root"), F.col(node).alias("node")), None
    for depth in range(1, most + 1):
        at = at.join(side, at["node"] == side["__s"]).select("root", F.col("__e").alias("node")).distinct()
        if depth >= least:
            part = at.withColumn("depth", F.lit(depth))
            out = part if out is None else out.unionByName(part)
    return out


def descend(nodes: DataFrame, key: str, parent: str, roots: DataFrame, keep: Callable[[DataFrame], DataFrame], name: str = "level") -> DataFrame:
    """A tree from its roots down to the last child, level by level, each a table of the shared folder.

    `roots` has `key`, `depth` and what paths need; `keep` makes a child's row from a joined one, in which the parent's
    columns are under `up` and the child's as they are. The loop ends with the first empty level; a cycle is an error.
    """
    level, out, most = written(roots, name), None, None
    while not level.isEmpty():
        out = level if out is None else out.unionByName(level)
        up = level.select(F.struct(*level.columns).alias("up"))
        level = written(keep(nodes.join(up, nodes[parent] == F.col(f"up.{key}"))), name)
        most = nodes.count() if most is None else most
        if level.count() > most:
            raise ValueError("the tree has a cycle")
    return roots if out is None else out


def lateral(df: DataFrame, detail: DataFrame, own: str, theirs: str, by: list[Column], most: int, outer: bool = False) -> DataFrame:
    """Each row with its `most` first detail rows (LATERAL ... LIMIT); with `outer`, rows without any stay (LEFT LATERAL)."""
    w = Window.partitionBy(theirs).orderBy(*by)
    best = detail.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
    return df.join(best, df[own] == best[theirs], "left" if outer else "inner")
