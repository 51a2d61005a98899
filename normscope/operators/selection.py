"""Greedy farthest-point selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.vectors import farthest_rows
from ..schema import BANK, BANK_SIZE
from .lazy_greedy import lazy_picks

#: Numbers (rows times dimensions) that one task may hold.
ONE_TASK_NUMBERS = 64_000_000


def farthest_points(points: DataFrame, most: int = BANK_SIZE, order: tuple[str, ...] = ("seq", "cell"), vector: str = "descriptor", one_task_numbers: int = ONE_TASK_NUMBERS, keep_order: bool = False) -> DataFrame:
    """``bank_pos``, ``descriptor``: ``min(most, rows)`` rows in the order they are picked.

    ``keep_order`` adds the ``order`` columns, which name the rows picked.  ``order`` decides row 0 and ties, and must tell the rows apart.  The choice
    depends on all rows, so it is one task as long as they fit (their number is
    checked first); beyond that they are picked lazily from a written table
    (:mod:`normscope.operators.lazy_greedy`).  Null vectors
    are left out; no rows give none.
    """
    known = points.where(F.col(vector).isNotNull()).select(*order, F.col(vector).cast("array<double>").alias("v"))
    schema = StructType([*BANK.fields, *known.select(*order).schema.fields])
    size = known.agg(F.count("*"), F.max(F.size("v"))).first()
    if size[0] * (size[1] or 0) > one_task_numbers:
        picks = lazy_picks(known, most, order)
        picked = known.sparkSession.createDataFrame([(k, v, *names) for k, (names, v) in enumerate(picks)], schema)
        return picked if keep_order else picked.select(*BANK.names)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(order), kind="stable")
        picks = farthest_rows(np.stack(frame["v"].to_numpy()), most)
        return pd.DataFrame({"bank_pos": np.arange(len(picks), dtype=np.int32), "descriptor": [frame["v"].iloc[p] for p in picks], **{c: frame[c].to_numpy()[picks] for c in order}})

    picked = known.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda f: choose(f), schema)
    return picked if keep_order else picked.select(*BANK.names)
