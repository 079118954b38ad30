"""Makes the package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


#: Rows and bytes that a Python worker gets at once: texts and images can be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once an application, and bounds the session's Arrow batches."""
    context = spark.sparkContext
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    if context.applicationId not in _shipped:
        base = Path(tempfile.mkdtemp(prefix="ship")) / _PACKAGE.name
        context.addPyFile(shutil.make_archive(str(base), "zip", _PACKAGE.parent, _PACKAGE.name))
        _shipped.add(context.applicationId)
