"""Chains of set operations, applied strictly from left to right."""

from __future__ import annotations

from pyspark.sql import DataFrame


class SetChain:
    def __init__(self, first: DataFrame):
        self.df = first

    def union(self, other: DataFrame) -> SetChain:
        return SetChain(self.df.union(other).distinct())

    def union_all(self, other: DataFrame) -> SetChain:
        return SetChain(self.df.union(other))

    def except_(self, other: DataFrame) -> SetChain:
        return SetChain(self.df.subtract(other))

    def except_all(self, other: DataFrame) -> SetChain:
        return SetChain(self.df.exceptAll(other))

    def intersect(self, other: DataFrame) -> SetChain:
        return SetChain(self.df.intersect(other))

    def intersect_all(self, other: DataFrame) -> SetChain:
        return SetChain(self.df.intersectAll(other))
