"""Scenes that arrive as streams.

Projections need no state, so they are the same functions as for tables:
indices, calibration, quality words, tasseled cap, spectral angles, nearest
centres, likelihoods and component scores. What needs statistics of a whole
image takes frozen ones (``match.freeze``, a fitted model).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def pixel_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Pixels of the Parquet files that come into a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def score(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write an operator's result to a folder, each file once; ``once`` works off
    what is there and ends."""
    out = operator(stream)
    if not out.isStreaming:
        raise ValueError("the operator gave a table, not a stream")
    w = out.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
