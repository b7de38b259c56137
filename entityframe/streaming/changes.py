"""Change streams (seq, op, id, columns) applied to a table. op: inserted, updated, deleted, invalidated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.writes import latest


def last_changes(changes: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last change of each id; one after the last invalidation only, which has no id."""
    valid = changes.agg(F.coalesce(F.max(F.when(F.col("op") == "invalidated", F.col(seq))), F.lit(-1)).alias("__from"))
    rows = changes.where("op <> 'invalidated'").where(F.col(seq) > valid.scalar())
    return latest(rows, key, seq)


def applied(table: DataFrame, changes: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The table after the changes. Applying them again changes nothing, in whatever order they come."""
    last = last_changes(changes, key, seq).select("op", F.col(key).alias("__k"), F.struct(*table.columns).alias("__new"))
    # one join for rows that stay, go, are replaced or come
    both = table.select(F.struct(*table.columns).alias("__old"), F.col(key).alias("__id")).join(last, F.col("__id") == F.col("__k"), "full")
    row = F.when(F.col("op").isNull(), F.col("__old")).when(F.col("op") != "deleted", F.col("__new"))
    return both.select(row.alias("__row")).where("__row IS NOT NULL").select(*[F.col("__row").getField(name).alias(name) for name in table.columns])


class TableState:
    """Versions of a table in a folder, each written whole, so a lost job leaves the last one as it was."""

    def __init__(self, spark, folder: str, empty: DataFrame, reload: Callable[[], DataFrame] | None = None):
        self.spark, self.folder, self.empty, self.reload = spark, folder, empty, reload
        try:  # a restart goes on from the newest whole version
            self.version = spark.read.parquet(folder).agg(F.coalesce(F.max("v"), F.lit(-1))).first()[0]
        except AnalysisException:
            self.version = -1

    def current(self) -> DataFrame:
        return self.empty if self.version < 0 else self.spark.read.schema(self.empty.schema).parquet(f"{self.folder}/v={self.version}")

    def commit(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/v={version}")
        self.version = version

    def batch(self, changes: DataFrame, epoch: int) -> None:
        """For foreachBatch: an invalidation reads the source anew before later changes are applied."""
        base = self.current()
        if self.reload is not None and not changes.where("op = 'invalidated'").isEmpty():
            base = self.reload()
        self.commit(applied(base, changes), epoch)
