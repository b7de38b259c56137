"""Rows as text, for people and for other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ndjson(df: DataFrame) -> DataFrame:
    """A JSON object for each row, nulls included; made in the tasks and written like any text table."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def json_text(df: DataFrame, most: int = 1000) -> str:
    """The first `most` rows as one JSON array."""
    return "[" + ",".join(r["value"] for r in ndjson(df.limit(most)).collect()) + "]"


def table_text(df: DataFrame, most: int = 50) -> str:
    """The first `most` rows as columns of equal width."""
    rows = [df.columns] + [["" if v is None else str(v) for v in r] for r in df.limit(most).collect()]
    wide = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() for r in rows)
