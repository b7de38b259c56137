"""Window specifications that are named once and used often."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


class NamedWindow:
    """Partition, order and frame; ranking functions leave the frame out, as Spark asks."""

    def __init__(self, *partition: Column | str):
        self.partition, self.keys, self.frame = partition, (), None

    def order_by(self, *keys: Column) -> NamedWindow:
        self.keys = keys
        return self

    def rows(self, start: int, end: int) -> NamedWindow:
        self.frame = ("rowsBetween", start, end)
        return self

    def range(self, start: int, end: int) -> NamedWindow:
        self.frame = ("rangeBetween", start, end)
        return self

    def spec(self, framed: bool = True) -> WindowSpec:
        w = Window.partitionBy(*self.partition).orderBy(*self.keys) if self.keys else Window.partitionBy(*self.partition)
        return getattr(w, self.frame[0])(*self.frame[1:]) if framed and self.frame else w

    def apply(self, function: Column) -> Column:
        return function.over(self.spec())

    def rank(self, function: Column) -> Column:
        """For row_number, rank, dense_rank, ntile, percent_rank, lag and lead."""
        return function.over(self.spec(framed=False))

    def count_where(self, condition: Column) -> Column:
        """COUNT(*) FILTER (WHERE ...) OVER, which Spark lacks."""
        return F.count(F.when(condition, 1)).over(self.spec())

    def joined(self, column: Column | str, sep: str = ",") -> Column:
        """GROUP_CONCAT OVER: the texts of the frame in the window's order; nulls are left out."""
        return F.array_join(F.collect_list(column).over(self.spec()), sep)
