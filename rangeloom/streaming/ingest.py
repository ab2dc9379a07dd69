"""Structured Streaming into a layout's delta: each micro-batch is appended once."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rangeloom.operators.delta import DeltaTable


def stream_inserts(rows: DataFrame, table: DeltaTable, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Insert a stream of rows (the layout's columns) batch by batch. A batch that is run again writes its own folder
    again, so none is counted twice; the checkpoint's name keeps the batches of several streams apart."""
    stream = f"s{zlib.crc32(checkpoint.encode()):08x}"

    def append(batch: DataFrame, batch_id: int) -> None:
        table.put(batch, f"{stream}-{batch_id}")

    writer = rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
