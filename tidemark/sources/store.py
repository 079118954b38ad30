"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new path in this application's folder below spark.checkpoint.dir, which driver and executors share.

    The folder is deleted when the driver ends. Only a local master may do without that setting (tests).
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='shared')}"
        context.setCheckpointDir(root)
    if context.applicationId not in _folders:
        _folders[context.applicationId] = f"{root.rstrip('/')}/tables-{context.applicationId}"
        atexit.register(discard, context, _folders[context.applicationId])
    return f"{_folders[context.applicationId]}/{uuid.uuid4().hex}"


def discard(context: SparkContext, folder: str) -> None:
    """Deletes a folder of stored tables, if the application still runs."""
    if context._jsc is not None and context._jvm is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a task whose work on a row takes long.
SPREAD = 20_000


def spread(df: DataFrame, rows: int = SPREAD) -> DataFrame:
    """The rows of a stored table, dealt evenly to tasks of about `rows` rows: a small file can hold many rows that each take long."""
    return df.repartition(max(1, -(-df.count() // rows)))


#: For rows of megabytes: Parquet looks at a row group's size after every row and not after the first hundred, and ends it at 8 MB, as writers and readers hold a group whole.
LONG_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def stored(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts the lineage, computes once, outlives executors. options: of the writer."""
    path = scratch(df.sparkSession)
    df.write.options(**(options or {})).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
