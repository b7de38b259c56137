"""Connected components of an edge table by local union-find, small stars and pointer jumps.

Every round first contracts the edges of each partition where they lie, so a vertex has one parent a partition at most
and no vertex, however many edges it has, sends them all to one task. Then each vertex links all its parents to the
least one, and edges to a vertex that isn't a root go on to that vertex's own parent.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Vertices that a task holds at once; beyond them it passes its forest on and begins a new one.
HELD = 300_000


def _contracted(edges: DataFrame) -> DataFrame:
    """A forest of stars for each partition of the edges (u, v): rows (u, least vertex of its tree there)."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches):
        parent: dict = {}
        kinds = None

        def root(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = p
            return x

        def forest():
            out = [(x, r) for x in list(parent) if (r := root(x)) != x]
            parent.clear()
            for i in range(0, len(out), 10_000):
                part = out[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], kinds), pa.array([x[1] for x in part], kinds)], ["u", "v"])

        for batch in batches:
            kinds = batch.schema.field(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > HELD:
                yield from forest()
        if parent:
            yield from forest()

    return edges.mapInArrow(run, f"u {kind}, v {kind}")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, component) for every vertex of the edges (u, v) that isn't its component's least one; null ends don't count.

    u and v are of one type that has an order. An empty edge table gives no rows.
    """
    now = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v")
    while True:
        # as many parents as there are partitions at most
        kids = written(_contracted(now).groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("parents")), name)
        several = kids.where(F.size("parents") > 1)
        links = kids.select("u", F.col("m").alias("v")).unionByName(several.select(F.explode("parents").alias("u"), F.col("m").alias("v")).where("u <> v"))
        roots = links.select(F.col("v").alias("r")).distinct()
        up = links.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        up = written(up.join(roots, F.col("k") == F.col("r"), "left_semi"), f"{name}-up")
        if up.isEmpty() and several.isEmpty():
            return kids.select(F.col("u").alias("v"), F.col("m").alias("component"))
        now = links.join(up, F.col("v") == F.col("k"), "left").select("u", F.coalesce("m", "v").alias("v"))
