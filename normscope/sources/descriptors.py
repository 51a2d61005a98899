"""Where local descriptors come from.

A descriptor source turns resized pixels into a grid of vectors.  Network features
(:mod:`normscope.sources.network`) need an archive of weights that is not
part of this repository; :class:`PixelStatistics` is a plain source for first
trials and does not imitate them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..schema import CHANNEL_MEAN, CHANNEL_STD, DESCRIPTOR, GRID, INPUT_SIZE


class DescriptorSource(Protocol):
    def __call__(self, pixels: np.ndarray) -> np.ndarray:
        """(size, size, 3) uint8 pixels to (cells, dims) float32 vectors, cells in row order."""


class PixelStatistics:
    """Mean, deviation and mean gradients of each cell's normalised pixels, per channel."""

    def __init__(self, grid: int = GRID):
        self.grid = grid

    def __call__(self, pixels: np.ndarray) -> np.ndarray:
        x = (pixels.astype(np.float64) / 255.0 - np.array(CHANNEL_MEAN)) / np.array(CHANNEL_STD)
        g, s = self.grid, len(x) // self.grid
        across, down = np.abs(np.diff(x, axis=1, append=x[:, -1:])), np.abs(np.diff(x, axis=0, append=x[-1:]))

        def cells(a: np.ndarray) -> np.ndarray:
            return a[: g * s, : g * s].reshape(g, s, g, s, 3).transpose(0, 2, 1, 3, 4).reshape(g * g, s * s, 3)

        parts = [cells(x).mean(axis=1), cells(x).std(axis=1), cells(across).mean(axis=1), cells(down).mean(axis=1)]
        return np.concatenate(parts, axis=1).astype(np.float32)


def describe(uploads: DataFrame, source: DescriptorSource, size: int = INPUT_SIZE) -> DataFrame:
    """A row for each cell of each upload (columns sample_id, group, seq, pixels)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for sid, group, seq, data in zip(f["sample_id"], f["group"], f["seq"], f["pixels"], strict=True):
                vectors = source(np.frombuffer(data, dtype=np.uint8).reshape(size, size, 3))
                yield pd.DataFrame({"sample_id": sid, "group": group, "seq": seq, "cell": np.arange(len(vectors), dtype=np.int32), "descriptor": list(vectors)})

    return uploads.select("sample_id", "group", "seq", "pixels").mapInPandas(run, DESCRIPTOR)
