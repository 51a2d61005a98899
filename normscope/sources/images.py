"""Uploads from image files: Spark's binary reader for the bytes, its image reader for the pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import content_id, image_format
from ..functions.raster import encode_png, triangle_resize
from ..operators.ranks import numbered
from ..schema import INPUT_SIZE, MOST_BYTES

PIXELS = "path string, width int, height int, pixels binary, png binary"


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path``, ``length``, ``content``, ``format`` of the files; of too large ones neither bytes nor format are read (null)."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= MOST_BYTES).select("path", "length", "content", image_format(F.col("content")).alias("format"))
    large = files.where(F.col("length") > MOST_BYTES).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("format"))
    return small.unionByName(large)


def _plain_path(path: str) -> Column:
    """A path as both readers spell it; they differ in the slashes of local ones."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_pixels(spark: SparkSession, path: str | list[str], size: int = INPUT_SIZE) -> DataFrame:
    """``path``, original ``width`` and ``height``, ``pixels``: RGB bytes of the image resized to ``size`` x ``size``, ``png``: the image in its own size.

    Files that cannot be decoded are left out.
    """
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def resize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out, pngs = [], []
            for h, w, c, data in zip(f["height"], f["width"], f["nChannels"], f["data"], strict=True):
                image = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c)
                rgb = image[:, :, [2, 1, 0]] if c >= 3 else np.repeat(image[:, :, :1], 3, axis=2)  # stored blue first
                out.append(triangle_resize(np.ascontiguousarray(rgb), size, size).tobytes())
                pngs.append(encode_png(np.ascontiguousarray(rgb)))
            yield pd.DataFrame({"path": f["origin"], "width": f["width"], "height": f["height"], "pixels": out, "png": pngs})

    return raw.mapInPandas(resize, PIXELS)


def uploads_of_pixels(pictures: DataFrame, group: str, order: list[Column | str], first_seq: int = 0, size: int = INPUT_SIZE) -> DataFrame:
    """Uploads as :func:`read_uploads` gives them, of pictures that are there as ``filename``, ``width``, ``height``, ``rgb`` and ``png``, numbered in ``order``."""
    named = numbered(pictures, order, "seq", first_seq).select("filename", "seq", "width", "height", "rgb", "png")

    def resize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            small = [triangle_resize(np.frombuffer(rgb, np.uint8).reshape(h, w, 3), size, size).tobytes() for rgb, w, h in zip(f["rgb"], f["width"], f["height"], strict=True)]
            yield f.assign(pixels=small)[["filename", "png", "width", "height", "pixels", "seq"]]

    read = named.mapInPandas(resize, "filename string, png binary, width int, height int, pixels binary, seq long")
    return read.select(F.lit(group).alias("group"), "filename", F.col("png").alias("raw"), content_id(F.col("pixels")).alias("content_id"), "width", "height", "pixels", "png", "seq")


def read_uploads(spark: SparkSession, path: str | list[str], group: str, first_seq: int = 0) -> tuple[DataFrame, DataFrame]:
    """Uploads ready for the catalogue, in order of their paths, and the rejected files (too large, of another format, damaged) with a reason."""
    files = read_files(spark, path).withColumn("_place", _plain_path("path")).withColumn("_name", F.element_at(F.split("path", "/"), -1))
    pixels = read_pixels(spark, path).select(_plain_path("path").alias("_place"), "width", "height", "pixels", "png")
    joined = files.join(pixels, "_place", "left")
    good = F.col("format").isNotNull() & F.col("pixels").isNotNull()
    accepted = joined.where(good).select(
        F.lit(group).alias("group"), F.col("_name").alias("filename"), F.col("content").alias("raw"), content_id(F.col("pixels")).alias("content_id"), "width", "height", "pixels", "png", F.col("path").alias("_path")
    )
    out = accepted.join(numbered(accepted.select("_path"), ["_path"], "seq", first_seq), "_path")
    rejected = joined.where(~good).select("path", F.when(F.col("length") > MOST_BYTES, f"larger than {MOST_BYTES} bytes").when(F.col("format").isNull(), "not a PNG or JPEG image").otherwise("the image cannot be decoded").alias("reason"))
    return out.drop("_path"), rejected
