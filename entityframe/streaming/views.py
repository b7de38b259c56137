"""Aggregates over streams, kept whole (complete mode) or by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .changes import TableState


def live_groups(stream: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    return stream.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def tumbling(df: DataFrame, time: str, width: str, *keys: str, late: str | None = None, **aggregates: Column) -> DataFrame:
    """Groups by window of event time; on a stream, rows later than `late` are left out."""
    rows = df.withWatermark(time, late) if late and df.isStreaming else df
    out = rows.groupBy(F.window(time, width).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), *keys, *aggregates)


def sessions(df: DataFrame, time: str, gap: str, *keys: str, late: str | None = None, **aggregates: Column) -> DataFrame:
    rows = df.withWatermark(time, late) if late and df.isStreaming else df
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *aggregates)


def once(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Repeated events once, as long as the watermark remembers them."""
    if stream.isStreaming:
        return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def kept_up(stream: DataFrame, state: TableState, checkpoint: str) -> StreamingQuery:
    """Runs over what is there; each batch's whole result is a version of the state's table, so none goes to the driver."""
    return stream.writeStream.outputMode("complete").foreachBatch(state.commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def derived(source: Callable[[], DataFrame], reducer: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: computes the reducer over the whole state after each batch and publishes it only if it differs from the last."""
    seen: list[tuple] = []

    def batch(_: DataFrame, epoch: int) -> None:
        out = reducer(source()).persist()
        try:
            # a plain hash of columns leaves nulls out, so a value that moves to another column would go unseen
            marks = [x for name in out.columns for x in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))]
            mark = out.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*marks).cast("decimal(38,0)")).alias("h")).first()
            if seen != [tuple(mark)]:
                publish(out)
                seen[:] = [tuple(mark)]
        finally:
            out.unpersist()

    return batch
