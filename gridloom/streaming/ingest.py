"""Parsing and chunking are narrow projections, so they run unchanged on a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunk import chunk_blocks
from ..operators.parse import parse_documents


def stream_blocks(docs: DataFrame, path: str, checkpoint: str, **budgets) -> StreamingQuery:
    """Append the chunks of a stream (source, text) to a block store, all that is there now; files are committed once."""
    blocks = chunk_blocks(parse_documents(docs), **budgets)
    return blocks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
