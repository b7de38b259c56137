"""Writes as rewrites of DataFrames: a new version of the table comes from the old one and the changes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Hook = Callable[[DataFrame], DataFrame]


def latest(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last of several rows with one id; combined where the rows lie, so a hot id is no hot task."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(sequence)).alias("__row"))
    return last.select(*[F.col("__row").getField(name).alias(name) for name in rows.columns])


def one_each(rows: DataFrame, key: str, sequence: str | None) -> DataFrame:
    """One row for each id: the last by `sequence`, which is then left out; without one the greatest row."""
    if sequence is not None:
        return latest(rows, key, sequence).drop(sequence)
    last = rows.groupBy(F.col(key).alias("__key")).agg(F.max(F.struct(*rows.columns)).alias("__row"))
    return last.select(*[F.col("__row").getField(name).alias(name) for name in rows.columns])


def replace(table: DataFrame, rows: DataFrame, key: str, sequence: str | None = None) -> DataFrame:
    """Upsert of whole rows, the last change of an id; columns that the new rows lack become null."""
    rows = one_each(rows, key, sequence)
    kept = table.join(rows.select(F.col(key).alias("__k")), table[key] == F.col("__k"), "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True).select(table.columns)


def insert_new(table: DataFrame, rows: DataFrame, key: str, sequence: str | None = None) -> DataFrame:
    """The table with the rows whose id it lacks (ON CONFLICT DO NOTHING); of several rows with one id, see one_each."""
    rows = one_each(rows, key, sequence)
    known = table.select(F.col(key).alias("__k"))
    return table.unionByName(rows.join(known, rows[key] == F.col("__k"), "left_anti"), allowMissingColumns=True).select(table.columns)


def patch(table: DataFrame, rows: DataFrame, key: str, sequence: str | None = None) -> DataFrame:
    """Sets the columns that `rows` has, for ids that the table has, by the last change of an id; a null there is a value.

    Columns of related rows (`a.b`) can't be patched.
    """
    if dotted := [name for name in rows.columns if "." in name]:
        raise ValueError(f"imported columns can't be patched: {', '.join(dotted)}")
    rows = one_each(rows, key, sequence)
    side = rows.select(F.col(key).alias("__k"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in rows.columns if c != key])
    out = table.join(side, table[key] == side["__k"], "left")
    return out.select(*[F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(table[c]).alias(c) if c in rows.columns and c != key else table[c] for c in table.columns])


def delete(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition doesn't hold; unknown counts as not."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def delete_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(F.col(key).alias("__k")), table[key] == F.col("__k"), "left_anti")


def changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` that differ from the old row with their id, or have none."""
    side = old.select(F.col(key).alias("__k"), F.struct(*old.columns).alias("__old"))
    out = new.join(side, new[key] == side["__k"], "left")
    return out.where(F.col("__old").isNull() | ~F.col("__old").eqNullSafe(F.struct(*[new[c] for c in old.columns]))).select([new[c] for c in new.columns])


def vanished(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Ids of `old` that `new` has no more."""
    return old.select(key).join(new.select(F.col(key).alias("__k")), old[key] == F.col("__k"), "left_anti")


def reconciled(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What makes `old` into `new`: rows to write (changed ones only) and ids to delete."""
    return changed(old, new, key), vanished(old, new, key)


@dataclass
class WritePath:
    """Hooks run in phases before a write (normalize, populate, validate), then invariants, then hooks after it."""

    invariants: dict[str, object] = field(default_factory=dict)
    before: dict[str, list[Hook]] = field(default_factory=lambda: {"normalize": [], "populate": [], "validate": []})
    after: list[Hook] = field(default_factory=list)
    before_delete: Callable[[DataFrame], DataFrame | None] | None = None

    def prepared(self, rows: DataFrame) -> DataFrame:
        for phase in ("normalize", "populate", "validate"):
            for hook in self.before[phase]:
                rows = hook(rows)
        for name, value in self.invariants.items():
            own = F.col(name) if name in rows.columns else F.lit(None)
            # null is filled, an equal value kept, any other refused
            rows = rows.withColumn(name, F.when(own.isNull(), F.lit(value)).when(own == F.lit(value), own).otherwise(F.raise_error(F.lit(f"{name} conflicts with the table's condition"))))
        # columns of related rows aren't written
        return rows.select(*[f"`{c}`" for c in rows.columns if "." not in c])

    def insert(self, table: DataFrame, rows: DataFrame) -> DataFrame:
        out = table.unionByName(self.prepared(rows), allowMissingColumns=True)
        for hook in self.after:
            out = hook(out)
        return out

    def delete(self, table: DataFrame, condition: Column) -> DataFrame:
        """A delete hook may handle the rows itself, as a soft delete does."""
        hit = table.where(F.coalesce(condition, F.lit(False)))
        handled = self.before_delete(hit) if self.before_delete else None
        kept = delete(table, condition)
        return kept if handled is None else kept.unionByName(handled)


def with_audit(created: str = "created_at", updated: str = "updated_at") -> Hook:
    """Fills the times of creation and change."""

    def hook(rows: DataFrame) -> DataFrame:
        now = F.current_timestamp()
        return rows.withColumn(created, F.coalesce(F.col(created), now) if created in rows.columns else now).withColumn(updated, now)

    return hook


def inserted_ids(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The ids that an insert has given (RETURNING id)."""
    return vanished(after, before, key)


def import_rows(target: DataFrame, source: DataFrame, path: WritePath, renamed: dict[str, str] | None = None) -> DataFrame:
    """The target with the rows of another set, whose columns are renamed first and cut to the target's."""
    rows = source.withColumnsRenamed(renamed or {})
    return path.insert(target, rows.select(*[c for c in rows.columns if c in target.columns]))


def merged_struct(column: str, changes: dict[str, Column]) -> Column:
    """A struct column with some fields set and the others kept (MERGE of nested rows); `a.b` sets a field of a field."""
    out = F.col(column)
    for path, value in changes.items():
        out = out.withField(path, value)
    return out


def with_ids(key: str) -> Hook:
    """Gives rows without an id a random one."""
    return lambda rows: rows.withColumn(key, F.coalesce(F.col(key), F.uuid()) if key in rows.columns else F.uuid())


def split_nested(rows: DataFrame, prefix: str, keep: str) -> tuple[DataFrame, DataFrame]:
    """Flat rows with columns `prefix.x` as parent rows and child rows with the parent's id."""
    inner = [c for c in rows.columns if c.startswith(prefix + ".")]
    parent = rows.select(*[f"`{c}`" for c in rows.columns if c not in inner])
    return parent, rows.select(F.col(keep).alias(f"parent_{keep}"), *[F.col(f"`{c}`").alias(c[len(prefix) + 1 :]) for c in inner])


def split_nested_many(rows: DataFrame, column: str, keep: str) -> tuple[DataFrame, DataFrame]:
    """Rows with an array of structs as parent rows and child rows (has-many) with the parent's id and their place from 1."""
    children = rows.select(F.col(keep).alias(f"parent_{keep}"), F.posexplode(column).alias("position", "__child"))
    return rows.drop(column), children.select(f"parent_{keep}", (F.col("position") + 1).alias("position"), "__child.*")
