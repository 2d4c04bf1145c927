"""Gets the package to executors that can't import it from their own path."""

from __future__ import annotations

import functools
import io
import os
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Adds the package as an archive, once per context, unless the workers' PYTHONPATH already has it."""
    context = spark.sparkContext
    if str(PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_chronoloom_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    # The driver's file server hands it out; the file is the driver's own and needn't be shared.
    at = Path(context._temp_dir) / "chronoloom.zip"
    at.write_bytes(buffer.getvalue())
    context.addPyFile(str(at))
    context._chronoloom_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
