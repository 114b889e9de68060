"""Queries over streams: a registered streaming DataFrame goes through the same binder and operators.

The dialect has no windows, watermarks or state of its own. What Structured Streaming allows on its own terms works:
projections and filters in append mode, aggregates in complete or update mode, joins with static tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def start(engine: Engine, sql: str, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Run a query over a registered stream into a table in memory."""
    frame: DataFrame = engine.sql(sql)
    if not frame.isStreaming:
        raise ValueError("no table of the query is a stream")
    writer = frame.writeStream.format("memory").queryName(name).outputMode(mode)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
