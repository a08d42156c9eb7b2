"""Making this package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch for rows that are whole documents, against Spark's defaults.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304")}


def small_batches(spark: SparkSession) -> None:
    """Option of an application: hand documents to Python in batches of a thousand rows and 4 MB, as
    buffers of ten thousand texts stay with the JVM's allocator once grown. Sets two options of the
    session that the application has not set itself. No operator calls this; the registered queries do."""
    set_ = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for key, (default, ours) in BATCHES.items():
        if key not in set_ and spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lodestone-")
    path = os.path.join(folder, "lodestone-src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"{here.name}/{p.relative_to(here)}")
    context.addPyFile(path)
    _shipped.add(context.applicationId)
