"""The same filters and projections over streams: an addition, as batch queries have none of it."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import Compiler
from ..plans.paths import View


def where(stream: DataFrame, condition: Any) -> DataFrame:
    return stream.where(Compiler(View(stream, scheme="stream")).filter(condition))


def windowed_counts(stream: DataFrame, time: str, length: str, keys: Sequence[str] = (), late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Rows per time window and keys; a window is final when the watermark has passed it."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    counted = stream.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")
