"""Session settings and shipping of this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def build_session(name: str = "pointloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, adaptive execution."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, once per application.

    Nothing is done where the workers inherit a PYTHONPATH that holds the package.
    """
    package = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    inherited = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(package.parent) in inherited or context.applicationId in _SHIPPED:
        return
    target = Path(tempfile.mkdtemp(prefix="pointloom-ship-")) / "pointloom.zip"
    with zipfile.ZipFile(target, "w") as bundle:
        for path in sorted(package.rglob("*.py")):
            bundle.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def arrow_batches(spark: SparkSession, rows: int = 2000, size: int = 32 << 20) -> None:
    """Bound the rows and bytes of an Arrow batch, so that long texts fit a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
