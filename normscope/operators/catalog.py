"""The catalogue of samples: ingest with deduplication, deletion, listing, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import filename_or_default, sample_id
from ..schema import GROUPS
from ..sources.scratch import materialise
from .joins import join_counted


def ingest(samples: DataFrame, uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows in the samples' schema, and rejected ones with a ``reason``.

    ``uploads``: group, filename, raw, content_id, width, height, seq, which tells uploads apart.  An upload is
    rejected if its group is unknown, if it has no content id, or if its content is already
    held in either group or by an earlier upload of the same call (the reason names
    the group), or if its sample id is.  Only keys are shuffled, never ``raw``.  The first upload of
    a content is a partial minimum, so a content that very many uploads share is no large task.
    """
    named = uploads.withColumn("sample_id", sample_id(F.col("group"), F.col("raw"))).withColumn("filename", filename_or_default(F.col("filename"))).select(*samples.columns)
    named = materialise(named, "uploads")
    known = F.coalesce(F.col("group").isin(*GROUPS), F.lit(False))
    good = named.where(known & F.col("content_id").isNotNull())
    rest = [c for c in samples.columns if c not in ("seq", "content_id")]
    first = good.groupBy("content_id").agg(F.min(F.struct("seq", *rest)).alias("first"), F.count("*").alias("copies"))
    held = samples.groupBy("content_id").agg(F.min("group").alias("held"))
    contents = materialise(first.join(held, "content_id", "left"), "contents")

    fresh = contents.where(F.col("held").isNull()).select("content_id", "first.*").select(*samples.columns)
    turn = fresh.groupBy("sample_id").agg(F.min("seq").alias("turn"))
    names = samples.select("sample_id", F.lit(True).alias("named")).distinct()
    counted = fresh.join(turn, "sample_id").join(names, "sample_id", "left")
    new = F.col("named").isNull() & (F.col("seq") == F.col("turn"))
    again = counted.where(~new).select("seq", "group", "filename", F.lit("a sample of this name is already held").alias("reason"))

    total = contents.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    place = contents.select("content_id", F.col("first.seq").alias("first_seq"), F.coalesce("held", "first.group").alias("holder"), F.col("held").isNull().alias("free"), "copies")
    met = join_counted(good.select("content_id", "seq", "group", "filename"), place, "content_id", "copies", total)
    repeated = met.where(~(F.col("free") & (F.col("seq") == F.col("first_seq")))).select("seq", "group", "filename", F.concat(F.lit("identical image content is already in "), "holder").alias("reason"))
    unusable = named.where(~known | F.col("content_id").isNull()).select("seq", "group", "filename", F.when(known, "the image has no content").otherwise("unknown group").alias("reason"))
    return counted.where(new).select(*samples.columns), repeated.unionByName(again).unionByName(unusable)


def delete(samples: DataFrame, keys: DataFrame, key: str = "sample_id") -> DataFrame:
    """The samples without those named; unknown names change nothing."""
    return samples.join(keys.select(key).distinct(), key, "left_anti")


def with_files(samples: DataFrame, files: DataFrame, key: str = "sample_id") -> DataFrame:
    """The samples whose file is there."""
    return samples.join(files.select(key), key, "left_semi")


def list_samples(samples: DataFrame, group: str) -> DataFrame:
    """The listing of a group, in upload order, without content ids."""
    if group not in GROUPS:
        raise ValueError(f"unknown group {group}")
    return samples.where(F.col("group") == group).orderBy("seq").select("sample_id", "filename", "width", "height")


def group_counts(samples: DataFrame, group: str = "group") -> DataFrame:
    """One row: how many samples each group holds; zeros when there are none."""
    return samples.agg(*(F.count_if(F.col(group) == g).alias(f"{g}_count") for g in GROUPS))


def overlap(samples: DataFrame, content: str = "content_id", group: str = "group") -> DataFrame:
    """Content that both groups hold; empty in a sound catalogue."""
    a, b = (samples.where(F.col(group) == g).select(content) for g in GROUPS)
    return a.intersect(b)


def first_of_content(rows: DataFrame, content: str, order: str) -> DataFrame:
    """Of rows with equal content the first one, found by a partial minimum."""
    return rows.groupBy(content).agg(F.min(order).alias(order), F.count("*").alias("copies"))
