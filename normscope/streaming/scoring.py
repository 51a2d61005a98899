"""Arriving descriptors against a fixed bank.

An addition of this library: stateless scoring of a stream, and windowed image
scores with a watermark for those that carry a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.neighbours import nearest_distance


def score_stream(arriving: DataFrame, bank: DataFrame, vector: str = "descriptor") -> DataFrame:
    """Distances of a stream's rows; the bank is read once, when the query is defined."""
    return nearest_distance(arriving, bank, vector)


def windowed_scores(distances: DataFrame, time: str, image: str = "image_id", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Largest distance of each image in each window; rows later than ``late`` are dropped by the watermark."""
    return distances.withWatermark(time, late).groupBy(F.window(time, window), image).agg(F.max("d").alias("score")).select(F.col("window.start").alias("window_start"), image, "score")
