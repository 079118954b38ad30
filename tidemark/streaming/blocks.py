"""Files read block by block with state over the blocks: repeated rows and ids, and reports that add up.

A block is a micro-batch of a file stream. What is remembered is one value a key in the state store,
which the checkpoint restores, so a run that was stopped goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import parse


def row_key(id_column: str | None, columns: list[str]) -> tuple[Column, Column]:
    """(the key under which a row can be repeated, a hash of the whole row): its id, or the row itself where it has none."""
    same = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"}), 256)
    return (F.coalesce(F.concat(F.lit("id:"), parse.present(F.col(id_column).cast("string"))), F.concat(F.lit("row:"), same)) if id_column else F.concat(F.lit("row:"), same)), same


class _FirstOfKey(StatefulProcessor):
    """Marks rows by what was the first of their key, in this block or an earlier one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._first = handle.getValueState("first", "same string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = self._first.get()[0] if self._first.exists() else None
        if first is None:
            block = pd.concat(list(rows)).sort_values("position")  # rows of one key in one block: at most a block
            first = block["same"].iloc[0]
            self._first.update((first,))
            kinds = ["kept", *("duplicate_row" if s == first else "duplicate_id" for s in block["same"].iloc[1:])]
            yield block.drop(columns=["key", "same"]).assign(kind=kinds)
        else:
            for part in rows:
                yield part.drop(columns=["key", "same"]).assign(kind=["duplicate_row" if s == first else "duplicate_id" for s in part["same"]])

    def close(self) -> None:
        pass


def first_occurrences(stream: DataFrame, position: str, id_column: str | None = None, compared: list[str] | None = None) -> DataFrame:
    """The stream's rows with kind: kept (the first of its key), duplicate_row (equal to it in `compared`) or duplicate_id.

    Blocks must arrive in the order of `position`; inside a block any order will do. Rows without an id
    are repeated only by equal rows.
    """
    columns = [c for c in stream.columns if c != position]
    key, same = row_key(id_column, compared or columns)
    keyed = stream.select(key.alias("key"), same.alias("same"), F.col(position).alias("position"), *columns)
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("position", *columns)) + ", kind string"
    found = keyed.groupBy("key").transformWithStateInPandas(_FirstOfKey(), schema, "append", "None")
    return found.withColumnRenamed("position", position)


#: What the state store needs for keyed values.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_blocks(stream: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Writes what has come as Parquet and stops; called again it goes on from the checkpoint. Returns each block's number and rows."""
    session = stream.sparkSession
    before = {k: session.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            session.conf.set(k, v)
        run = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            session.conf.unset(k) if v is None else session.conf.set(k, v)
    return [{"block": p.batchId, "rows": p.numInputRows} for p in run.recentProgress]
