"""Rows of an unbounded source into a table of a store, and its rules to their fixpoint after each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from patternloom.sources.tablestore import Store


def feed(rows: DataFrame, store: Store, table: str, after: Callable[[Store, int], None] | None = None, checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """Start a query that adds each micro-batch of rows(cells ARRAY<STRING>) to a table.

    A repeated batch adds nothing: new rows are named by their content.
    """

    def add(batch: DataFrame, number: int) -> None:
        store.insert(table, batch.select("cells"))
        if after is not None:
            after(store, number)

    writer = rows.writeStream.foreachBatch(add)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
