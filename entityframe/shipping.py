"""Sends this package to the executors, so that it need not be installed there."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each context; Spark's own file server takes the archive from the driver."""
    context = spark.sparkContext
    if getattr(context, "_entityframe_shipped", False):
        return
    package = Path(__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    path = Path(tempfile.mkdtemp()) / "entityframe.zip"
    path.write_bytes(data.getvalue())
    context.addPyFile(str(path))
    context._entityframe_shipped = True
