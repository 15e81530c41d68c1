"""Searching documents as they arrive.

All operators work on documents by themselves, so each micro-batch is searched as a table of
its own; the same batch always gives the same rows, and a repeated one replaces its output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.ast import Node
from ..search import release, search


def search_stream(docs: DataFrame, query: str | Node, path: str, checkpoint: str, once: bool = False, **options) -> StreamingQuery:
    """Writes the regions of a stream of documents to Parquet, a folder for each batch below path."""

    def each(batch: DataFrame, number: int) -> None:
        found = search(batch, query, **options)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")
        release(found)

    writer = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
