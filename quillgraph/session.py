"""Makes the package importable by Python workers that don't share the driver's search path."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per context. The archive is read by the driver alone and served from there."""
    context = spark.sparkContext
    if getattr(context, "_quillgraph_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quillgraph-")) / "quillgraph.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._quillgraph_shipped = True


def shipped(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, called with a session first, after that session has the package."""

    @wraps(f)
    def call(spark: SparkSession, *rest) -> DataFrame:
        ship(spark)
        return f(spark, *rest)

    return call
