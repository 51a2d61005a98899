"""Exact quantiles by linear interpolation between order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_quantile(column: Column | str, q: float) -> Column:
    """Aggregate: the value at (n - 1) q among the sorted values, interpolated; null on no rows.

    ``ValueError`` when q is outside [0, 1].
    """
    if not 0.0 <= q <= 1.0:
        raise ValueError("a quantile lies within [0, 1]")
    return F.percentile(column, F.lit(float(q)))


def require_quantile(values: DataFrame, column: str, q: float) -> float:
    """The quantile as a number; ``ValueError`` when there are no values."""
    found = values.agg(linear_quantile(column, q)).first()[0]
    if found is None:
        raise ValueError("no values to take a quantile of")
    return float(found)


def ordered_values(order: str, value: str) -> Column:
    """Aggregate: all values as an array in the order of another column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
