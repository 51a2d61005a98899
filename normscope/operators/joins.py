"""Joins whose hot keys are known from counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys above this share of a partition's fair share of the rows are hot.
HOT_SHARE = 0.25


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """``rows`` joined to ``keyed``, one row a key, whose column ``count`` says how many rows have the key; ``count`` goes.

    ``total``: all rows.  Keys with more than ``share`` of a partition's fair share are few, at most ``1 / share`` a
    partition, so they are sent to every task and their rows stay where they are; the others
    join by key.  The way is the same at every size.  Rows without a key, or with one that is not there, are left out.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(64, int(total * share / partitions))
    hot = F.broadcast(keyed.where(F.col(count) > most).drop(count))
    often = rows.join(hot, key)
    seldom = rows.join(hot.select(key), key, "left_anti").join(keyed.where(F.col(count) <= most).drop(count), key)
    return often.unionByName(seldom)
