"""Distances between array columns, in double precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def squared_l2(a: Column, b: Column) -> Column:
    """Sum of squared differences; null where a length differs or a component is null."""
    gaps = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(squared_l2(a, b))


def scaled(vector: Column, factor: Column) -> Column:
    return F.transform(as_double(vector), lambda x: x * factor)


def farthest_rows(points: np.ndarray, most: int) -> list[int]:
    """Start at row 0; then always the unused row farthest from all picks, the first of equal ones.  No pairwise matrix."""
    picks = [0]
    reach = np.full(len(points), np.inf)
    free = np.ones(len(points), dtype=bool)
    free[0] = False
    while len(picks) < min(most, len(points)):
        gap = points - points[picks[-1]]
        np.minimum(reach, np.sqrt(np.einsum("ij,ij->i", gap, gap)), out=reach)
        pick = int(np.argmax(np.where(free, reach, -1.0)))
        free[pick] = False
        picks.append(pick)
    return picks


#: Pairs whose exact difference is held at once.
PAIRS = 65_536


def least_distances(queries: np.ndarray, bank: np.ndarray, step: int = 1_024) -> np.ndarray:
    """Distance of each query to its nearest bank row, from differences: exact zeros stay zero.

    A matrix product tells which rows may be nearest, as its rounding is far smaller than
    the slack it is given; only their differences are taken.
    """
    out = np.full(len(queries), np.inf)
    if not len(bank) or not len(queries):
        return out
    sizes = np.einsum("ij,ij->i", bank, bank)
    for a in range(0, len(queries), step):
        part = queries[a : a + step]
        own = np.einsum("ij,ij->i", part, part)
        rough = own[:, None] + sizes - 2.0 * (part @ bank.T)
        near = rough.min(axis=1)
        row, col = np.nonzero(rough <= (near + 1e-10 * (own + sizes.max()))[:, None])
        best = np.full(len(part), np.inf)
        for k in range(0, len(row), PAIRS):
            gap = part[row[k : k + PAIRS]] - bank[col[k : k + PAIRS]]
            np.minimum.at(best, row[k : k + PAIRS], np.einsum("ij,ij->i", gap, gap))
        for k in np.flatnonzero(~np.isfinite(near)):  # components that are not finite, or whose squares are not
            gap = part[k] - bank
            best[k] = np.einsum("ij,ij->i", gap, gap).min()
        out[a : a + step] = np.sqrt(best)
    return out
