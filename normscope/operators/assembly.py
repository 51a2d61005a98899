"""Descriptors put together from feature grids of different fineness."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.raster import align
from ..schema import GRID


def concat_grids(fine: DataFrame, coarse: DataFrame, fine_shape: tuple[int, int] = (GRID, GRID), coarse_shape: tuple[int, int] = (GRID // 2, GRID // 2), key: str = "sample_id") -> DataFrame:
    """``key``, ``cell``, ``descriptor``: each fine cell's vector followed by the coarse grid's value there.

    Both inputs hold ``key``, ``cell`` (in row order) and ``descriptor``, other
    columns are left alone.  Each table is shuffled once by ``key``; a group is one
    image, so its size is the grids'.  Fine cells of an image whose coarse grid
    lacks a cell, or repeats one, or has a null vector, get a null descriptor, as do null fine
    vectors and cells outside ``fine_shape``; coarse grids without fine cells give no row.
    """
    kind = dict(fine.dtypes)[key]
    (rows, cols), (h, w) = fine_shape, coarse_shape

    def join(f: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        whole = len(c) == h * w and c["descriptor"].notna().all() and sorted(c["cell"].dropna()) == list(range(h * w))
        out = [None] * len(f)
        if whole and len(f):
            grid = np.stack(c.sort_values("cell")["descriptor"].to_numpy()).astype(np.float64).reshape(h, w, -1)
            large = align(grid, rows, cols).reshape(rows * cols, -1)
            out = [None if v is None or pd.isna(i) or not 0 <= i < len(large) else np.concatenate([v, large[int(i)]]) for i, v in zip(f["cell"], f["descriptor"], strict=True)]
        return pd.DataFrame({key: f[key], "cell": f["cell"], "descriptor": pd.Series(out, index=f.index, dtype=object)})

    def narrow(df: DataFrame) -> DataFrame:
        return df.select(key, F.col("cell").cast("int").alias("cell"), F.col("descriptor").cast("array<double>").alias("descriptor"))

    return narrow(fine).groupBy(key).cogroup(narrow(coarse).groupBy(key)).applyInPandas(join, f"{key} {kind}, cell int, descriptor array<double>")
