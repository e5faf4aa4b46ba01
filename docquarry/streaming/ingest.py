"""Streaming ingest: JSON documents that arrive in a folder go into an index, a micro-batch at a time.

An upsert by id is idempotent, so a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docquarry.engine import Engine
from docquarry.sources.documents import id_column


def stream_into(engine: Engine, index: str, source: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Follow JSON lines below ``source``; with ``once``, stop when all that is there has been read."""
    lines = engine.spark.readStream.text(source)
    docs = lines.select(id_column("value").alias("doc_id"), lines["value"].alias("doc")).where("doc_id is not null")

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            engine.add_table(index, rows)  # a segment of what has arrived

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
