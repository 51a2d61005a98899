"""Thresholds from calibration scores, and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import linear_quantile
from ..schema import QUANTILE


def threshold_of(scores: DataFrame, q: float = QUANTILE) -> DataFrame:
    """One row: ``threshold`` (null without scores) and the number of scores it comes from."""
    return scores.agg(linear_quantile("score", q).alias("threshold"), F.count("score").alias("n_scores"))


def is_anomaly(score: Column, threshold: Column) -> Column:
    """Strictly above the threshold."""
    return score > threshold


def is_zero(threshold: Column) -> Column:
    """True for a threshold of exactly zero; false without one."""
    return F.coalesce(threshold == 0.0, F.lit(False))


def verdicts(scores: DataFrame, threshold: DataFrame, image: str = "image_id") -> DataFrame:
    """Each image's score against the one-row threshold."""
    return scores.crossJoin(F.broadcast(threshold.select("threshold").limit(1))).select(image, "score", "threshold", is_anomaly(F.col("score"), F.col("threshold")).alias("is_anomaly"), is_zero(F.col("threshold")).alias("threshold_is_zero"))
