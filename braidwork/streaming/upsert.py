"""Triples that arrive as a stream: each batch is kept as it comes, and batches are merged into the graph now and then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.writers import append_batch, compact


def stream_graph(triples: DataFrame, path: str, checkpoint: str, compact_every: int = 20) -> StreamingQuery:
    """Start a query that adds each micro-batch to the graph under ``path``, see :func:`braidwork.sources.writers.read_graph`.

    A batch writes its own nodes and edges only, under its number, so that one that runs again replaces what it wrote. Every
    ``compact_every`` batches they are merged into a new version.
    """

    def add(batch: DataFrame, number: int) -> None:
        append_batch(batch, path, number)
        if number % compact_every == compact_every - 1:
            compact(batch.sparkSession, path)

    return triples.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
