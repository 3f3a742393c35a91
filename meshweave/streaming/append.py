"""Appending to a store as files arrive: each micro-batch is a whole append."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_stream(cells: DataFrame, append: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run ``append(batch, batch_id)`` for every micro-batch that isn't empty.

    The checkpoint remembers the batches that are done; as an append isn't idempotent,
    ``append`` should note ``batch_id`` with what it writes and skip one that it has.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                append(batch, batch_id)
        finally:
            batch.unpersist()

    writer = cells.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
