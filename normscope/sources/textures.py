"""Made-up pictures of a ground surface as a data source: plain, with a cut, with a speck.

``spark.read.format("textures")`` after :func:`register`.  A picture follows from its
seed and kind alone, so any task can make it again; partitions are ranges of seeds.
They are meant for trials of a detector, which they feed like uploads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.raster import encode_png

KINDS = ("plain", "cut", "speck")


def ground(seed: int, size: int) -> np.ndarray:
    """(size, size, 3) grey values, a little blue: slanting light, a coarse and a fine ripple along x, grain."""
    rng = np.random.default_rng([seed, size])
    y, x = np.mgrid[:size, :size] / size
    slant, turn = rng.uniform(-12, 12, 2), rng.uniform(0, 2 * np.pi, 2)
    light = 150 + slant[0] * x + slant[1] * y
    ripple = 7 * np.cos(2 * np.pi * 17 * x + turn[0]) + 3 * np.cos(2 * np.pi * (71 * x + 2 * y) + turn[1])
    grey = light + ripple + rng.normal(0, 2.5, (size, size))
    return np.stack([0.97 * grey, grey, 1.04 * grey], axis=2)


def with_cut(picture: np.ndarray, seed: int) -> np.ndarray:
    """A thin dark line, bent once, from one side towards the other: darkness falls with the distance from it."""
    size = len(picture)
    rng = np.random.default_rng([seed, size, 1])
    ends = rng.uniform([[0.1, 0.1], [0.3, 0.3], [0.7, 0.1]], [[0.3, 0.9], [0.7, 0.7], [0.9, 0.9]]) * size
    t = np.linspace(0, 1, 4 * size)[:, None]
    line = (1 - t) ** 2 * ends[0] + 2 * t * (1 - t) * ends[1] + t**2 * ends[2]
    away = np.full((size, size), np.inf)
    reach = max(2, size // 40)
    for cx, cy in np.unique(line.round(1), axis=0):
        a, b = max(0, int(cy) - reach), max(0, int(cx) - reach)
        y, x = np.mgrid[a : min(size, a + 2 * reach + 1), b : min(size, b + 2 * reach + 1)]
        part = away[a : a + y.shape[0], b : b + y.shape[1]]
        np.minimum(part, (y - cy) ** 2 + (x - cx) ** 2, out=part)
    return picture * (1 - 0.75 * np.exp(-away / (size / 120) ** 2))[:, :, None]


def with_speck(picture: np.ndarray, seed: int) -> np.ndarray:
    """A dark round speck within a bright edge."""
    size = len(picture)
    rng = np.random.default_rng([seed, size, 2])
    cy, cx = rng.uniform(0.3, 0.7, 2) * size
    radius = rng.uniform(0.05, 0.09) * size
    y, x = np.mgrid[:size, :size]
    away = np.hypot(y - cy, x - cx) / radius
    inside = 1 / (1 + np.exp(24 * (away - 1)))
    edge = np.exp(-((away - 1.12) ** 2) / 0.004)
    return picture * (1 - 0.8 * inside)[:, :, None] + 55 * edge[:, :, None]


def texture(seed: int, kind: str, size: int) -> np.ndarray:
    """The (size, size, 3) uint8 picture of a seed; the defects lie on the seed's plain picture."""
    picture = ground(seed, size)
    if kind == "cut":
        picture = with_cut(picture, seed)
    elif kind == "speck":
        picture = with_speck(picture, seed)
    return np.clip(np.rint(picture), 0, 255).astype(np.uint8)


@dataclass
class Seeds(InputPartition):
    first: int
    last: int


class TextureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.first, self.count = int(options.get("first", 0)), int(options.get("count", 1))
        self.size, self.step = int(options.get("size", 320)), int(options.get("seedsPerPartition", 64))
        self.kinds = tuple(k.strip() for k in options.get("kinds", "plain").split(","))
        if self.count < 0 or self.size < 8 or self.step < 1 or not set(self.kinds) <= set(KINDS):
            raise ValueError(f"textures take a count from 0, a size from 8, seedsPerPartition from 1 and kinds of {', '.join(KINDS)}")

    def partitions(self) -> list[Seeds]:
        end = self.first + self.count
        return [Seeds(a, min(a + self.step, end)) for a in range(self.first, end, self.step)] or [Seeds(self.first, self.first)]

    def read(self, partition: Seeds) -> Iterator[pa.RecordBatch]:
        for seed in range(partition.first, partition.last):
            made = [texture(seed, kind, self.size) for kind in self.kinds]
            many = len(made)
            columns = [pa.array([seed] * many, pa.int64()), pa.array(self.kinds), pa.array([self.size] * many, pa.int32()), pa.array([self.size] * many, pa.int32()), pa.array([m.tobytes() for m in made], pa.binary()), pa.array([encode_png(m) for m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["seed", "kind", "width", "height", "rgb", "png"])


class TextureSource(DataSource):
    """Options: ``first`` seed, ``count`` of seeds, ``size`` in pixels, ``kinds`` by commas, ``seedsPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "textures"

    def schema(self) -> str:
        return "seed long, kind string, width int, height int, rgb binary, png binary"

    def reader(self, schema: StructType) -> TextureReader:
        return TextureReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextureSource)
