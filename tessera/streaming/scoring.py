"""Scores on a stream: a stateless map, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.model import Model


def score_stream(model: Model, rows: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes scored rows of a streaming DataFrame as Parquet."""
    writer = model.transform(rows).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
