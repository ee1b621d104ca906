"""Streaming use of the row operators, and the stateful counterparts of dedup and windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_stream(stream: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cell cleaning is stateless and works on a stream as it is."""
    from ..operators.clean import clean_cells, drop_empty_rows

    return drop_empty_rows(clean_cells(stream, columns), columns)


def dedupe_stream(stream: DataFrame, keys: Sequence[str], time: str, late: str = "10 minutes") -> DataFrame:
    """First row of each key within the watermark; state older than ``late`` is dropped by Spark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, time: str, keys: Sequence[str], size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window(time, size, slide or size)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def each_batch(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str):
    """Any table operator, once a micro-batch; restarts continue from ``checkpoint``."""
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
