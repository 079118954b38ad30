"""Explanations that can be stopped and taken up again: a stream over files of targets with a ledger.

A block of targets is a micro-batch. Its results are written as the folder of the batch's number, in
place of what an earlier attempt left there, and its rows are entered in the ledger after that. A batch
that was cut off is run again under the same number, so each target has one result, whenever the run
was killed. A target that an earlier batch has explained is left out. Results count once the ledger has
their batch.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sampling import reservoir
from tidemark.operators.scoring import filled_in
from tidemark.sources.store import SPREAD, stored


def targets(rejected: DataFrame, key: str, *, mode: str = "all", n: int | None = None, rows: list[int] | None = None, seed: int = 20260921) -> DataFrame:
    """The rows to explain: all, a sample of n, the first n by key, or the named ones."""
    if mode == "all":
        return rejected
    if mode == "sample":
        return reservoir(rejected, key, n, seed)
    if mode == "first":
        return rejected.orderBy(key).limit(n)
    if mode == "rows":
        return rejected.where(F.col(key).isin(*rows))
    raise ValueError(f"unknown mode {mode}")


class Explanations(NamedTuple):
    """Where a run keeps its results, ledger and progress."""

    folder: str

    @property
    def results_path(self) -> str:
        return f"{self.folder}/results"

    @property
    def ledger_path(self) -> str:
        return f"{self.folder}/ledger"

    def _table(self, spark: SparkSession, path: str) -> DataFrame | None:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def ledger(self, spark: SparkSession, key: str = "row_id") -> DataFrame:
        """(key, batch): the explained rows."""
        found = self._table(spark, self.ledger_path)
        return spark.createDataFrame([], f"{key} long, batch int") if found is None else found.select(key, F.col("batch").cast("int").alias("batch"))

    def results(self, spark: SparkSession, key: str = "row_id") -> DataFrame | None:
        """The results of the batches that the ledger has; None before the first."""
        found = self._table(spark, self.results_path)
        return None if found is None else found.join(self.ledger(spark, key).select("batch").distinct(), "batch", "left_semi")

    def run(self, stream: DataFrame, explain: Callable[[DataFrame], DataFrame], key: str = "row_id") -> None:
        """Explains what has come and stops; called again it goes on. explain: targets -> rows with the key, any number a target."""

        def block(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            done = self.ledger(spark, key).where(F.col("batch") != number).select(key)
            tasks = max(1, -(-batch.count() // SPREAD))  # adaptive execution would size them by bytes, but a row takes long
            todo = batch.dropDuplicates([key]).join(done, key, "left_anti").repartition(tasks, key)
            explain(todo).write.mode("overwrite").parquet(f"{self.results_path}/batch={number}")
            explained = spark.read.parquet(f"{self.results_path}/batch={number}").select(key).distinct()
            explained.write.mode("overwrite").parquet(f"{self.ledger_path}/batch={number}")

        stream.writeStream.foreachBatch(block).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    def of_row(self, spark: SparkSession, row: int, key: str = "row_id") -> DataFrame | None:
        """One row's result; None or no rows if it has none yet."""
        found = self.results(spark, key)
        return None if found is None else found.where(F.col(key) == row)

    def last(self, spark: SparkSession, n: int, key: str = "row_id") -> DataFrame:
        """(key, batch) of the n results that came last: by batch, then by key."""
        return self.ledger(spark, key).orderBy(F.desc("batch"), F.desc(key)).limit(n)

    def snapshot(self, spark: SparkSession, wanted: DataFrame, key: str = "row_id") -> DataFrame:
        """(target, done, pending, partial): one row; wanted: the rows to explain."""
        state = wanted.select(key).join(self.ledger(spark, key).select(key, F.lit(1).alias("_done")), key, "left")
        done = F.count("_done")
        return state.agg(F.count(F.lit(1)).alias("target"), done.alias("done"), (F.count(F.lit(1)) - done).alias("pending"), ((done > 0) & (done < F.count(F.lit(1)))).alias("partial"))

    def pending(self, spark: SparkSession, wanted: DataFrame, key: str = "row_id", most: int = 500) -> DataFrame:
        """The first rows that wait for a result: a report."""
        return wanted.join(self.ledger(spark, key), key, "left_anti").orderBy(key).limit(most)


def fill_blocks(spark: SparkSession, path: str, gained: DataFrame, key: str, columns: list[str], block: str = "block") -> int:
    """Rewrites only the partitions of a table, by `block`, that have rows among `gained` (key, block, columns); returns how many. Other partitions' files stay as they are."""
    touched = [r[0] for r in gained.select(block).distinct().collect()]  # partitions of the table
    if touched:
        rows = spark.read.parquet(path)
        names = rows.columns
        new = stored(filled_in(rows.where(F.col(block).isin(*touched)), gained.drop(block), key, columns))
        new.select(names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(block).parquet(path)
    return len(touched)
