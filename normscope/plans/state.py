"""The status record and the state document: what a detector tells of itself, out and in."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import ordered_values
from ..operators.scoring import is_zero
from ..schema import PREPROCESS, PREPROCESSING, SAMPLE, STATE
from ..sources.store import StateStore

#: Nulls are told, as a reader may ask for any field.
JSON = {"ignoreNullFields": "false"}


def iso_time(time: Column) -> Column:
    """A UTC time as text with its offset, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def samples_digest(samples: DataFrame) -> int:
    """A number that changes with the set of samples."""
    return int(samples.agg(F.coalesce(F.sum(F.xxhash64("sample_id", "group").cast("decimal(38,0)")) % 9_007_199_254_740_993, F.lit(0))).first()[0])


def preprocessing() -> Column:
    return F.from_json(F.lit(json.dumps(PREPROCESS)), PREPROCESSING)


def numbers(store: StateStore) -> DataFrame:
    """One row: ``threshold``, ``calibration_scores`` in upload order, ``built_at``, ``memory_bank_items`` and ``samples_digest`` of the current version; nulls, no scores and no items without one."""
    version = store.current()
    if version is None:
        row = store.spark.range(1)
        return row.select(F.lit(None).cast("double").alias("threshold"), F.array().cast("array<double>").alias("calibration_scores"), F.lit(None).cast("timestamp").alias("built_at"), F.lit(0).cast("long").alias("memory_bank_items"), F.lit(None).cast("long").alias("samples_digest"))
    scores = store.scores(version).agg(ordered_values("pos", "score").alias("calibration_scores"))
    return store.record(version).crossJoin(scores).select("threshold", "calibration_scores", "built_at", "memory_bank_items", "samples_digest")  # one row each


def status(store: StateStore, samples: DataFrame) -> DataFrame:
    """One row: sample counts, the bank's size, threshold, calibration scores, time, preprocessing; and whether there is a detector, and whether samples changed since it was built."""
    counts = samples.agg(F.count_if(F.col("group") == "reference").alias("reference_count"), F.count_if(F.col("group") == "calibration").alias("calibration_count"))
    built = F.col("samples_digest").isNotNull()
    stale = F.coalesce(F.col("samples_digest") != F.lit(samples_digest(samples)), F.lit(False))
    return counts.crossJoin(numbers(store)).select(
        "reference_count", "calibration_count", "memory_bank_items", "threshold", is_zero(F.col("threshold")).alias("threshold_is_zero"), "calibration_scores", iso_time(F.col("built_at")).alias("built_at"), preprocessing().alias("preprocess"), built.alias("built"), stale.alias("stale")
    )


def as_document(samples: DataFrame, detector: DataFrame) -> DataFrame:
    """One row, ``document``: the catalogue in upload order and the detector's numbers as JSON.

    ``detector``: one row of threshold, calibration_scores, built_at (text).  A document holds all of its
    samples, so it is one value of one row; catalogues too large for that are tables.
    """
    sample = F.struct(*(f.name for f in STATE["samples"].dataType.elementType))
    listed = samples.withColumn("_sample", sample).agg(ordered_values("seq", "_sample").alias("samples"))
    whole = F.struct("samples", "threshold", "calibration_scores", "built_at", preprocessing().alias("preprocess"))
    return listed.crossJoin(detector).select(F.to_json(whole, JSON).alias("document"))


def state_document(store: StateStore) -> DataFrame:
    return as_document(store.samples(), numbers(store).withColumn("built_at", iso_time(F.col("built_at"))))


def from_document(document: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The samples, numbered in the order of the document, and the one row of the detector's numbers; a damaged document gives no sample and nulls."""
    read = document.select(F.from_json("document", STATE).alias("state")).select("state.*")
    samples = read.select(F.posexplode("samples").alias("seq", "sample")).select(*(f"sample.{n}" for n in SAMPLE.names if n != "seq"), F.col("seq").cast("long").alias("seq"))
    return samples.select(*SAMPLE.names), read.drop("samples")


def restore(spark: SparkSession, store: StateStore, document: DataFrame, images: DataFrame) -> DataFrame:
    """Take the samples of a document up into a store, those that have an image; the detector's numbers are returned, not published, as they have no bank."""
    samples, detector = from_document(document)
    store.add(samples.join(images.select("sample_id"), "sample_id", "left_semi"), images)
    return detector
