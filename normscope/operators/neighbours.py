"""Nearest-neighbour distances to a bank of descriptors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2, least_distances
from .pivots import matrix, nearest_by_pivots

#: Banks of up to so many rows travel to every executor.
BROADCAST_ROWS = 4_096


def nearest_distance(queries: DataFrame, bank: DataFrame, vector: str = "descriptor", distance: str = "d", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The queries' columns without ``vector``, and ``distance`` to the nearest bank row.

    A bank within ``broadcast_rows`` is counted first, then sent to every executor
    and compared in numpy, batch by batch: no shuffle.  A larger one stays where it is
    but for the blocks that a query may need (:mod:`normscope.operators.pivots`).
    Rows with a null vector get a null distance; an empty bank gives nulls.
    """
    spark = queries.sparkSession
    known = bank.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("b"))
    head = known.limit(broadcast_rows + 1).toPandas()["b"]
    kept = [c for c in queries.columns if c != vector]
    schema = queries.select(*kept).schema.add(distance, "double")
    if len(head) > broadcast_rows:
        return nearest_by_pivots(queries, known, vector, distance)
    handle = spark.sparkContext.broadcast(np.array(head.tolist(), dtype=np.float64) if len(head) else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = handle.value
        for batch in batches:
            column = batch.column(vector)
            valid = np.asarray(pc.is_valid(column))
            out = np.full(len(column), np.nan)
            if rows is not None and valid.any():
                out[valid] = least_distances(matrix(column.filter(pa.array(valid))), rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.float64(), mask=np.isnan(out))], names=[*kept, distance])

    return queries.mapInArrow(run, schema)


def nearest_distance_expr(queries: DataFrame, bank: DataFrame, key: list[str], vector: str = "descriptor", distance: str = "d") -> DataFrame:
    """The same for small banks in expressions only: a nested-loop join with a partial minimum above it.

    ``ValueError`` for a bank of more than ``BROADCAST_ROWS`` rows, which :func:`nearest_distance` takes.
    """
    known = bank.select(F.col(vector).alias("_b"))
    if known.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"a bank of more than {BROADCAST_ROWS} rows")
    pairs = queries.join(F.broadcast(known), how="cross")
    return pairs.groupBy(*key).agg(F.min(l2(F.col(vector), F.col("_b"))).alias(distance))


def image_score(distances: DataFrame, image: str = "image_id", distance: str = "d") -> DataFrame:
    """An image's score is its largest local distance."""
    return distances.groupBy(image).agg(F.max(distance).alias("score"))
