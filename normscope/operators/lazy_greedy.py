"""Farthest-point selection beyond one task: the same picks, by lazy evaluation.

A row's reach, its distance to the nearest pick, only falls as picks are added, so what
a block of rows had at its last visit bounds what it has now.  The driver holds a pool
of the farthest rows and brings it up to date after each pick.  As long as the pool's
best row comes before everything that may lie outside the pool it is the next pick, and no
table is read.  Where it does not, the blocks that may hold a farther row are visited: a
job brings their rows' reaches up to date with the picks made since their last visit,
writes them anew, and refills the pool.

So a row meets a pick at most once, and often never.  Blocks are the cells of rows near
one of a few pivots; a block is a folder of a written table, not a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import farthest_rows
from ..sources.scratch import scratch_path
from .pivots import with_cells


@dataclass(frozen=True)
class LazySettings:
    """``sample``: rows, the first in order, from which the blocks' pivots are chosen; ``pool``: rows that a visit brings to the driver."""

    blocks: int = 64
    sample: int = 2_048
    pool: int = 2_048


@dataclass
class Work:
    """``meetings``: distances taken between rows and picks in jobs; ``visits``: jobs."""

    meetings: int = 0
    visits: int = 0


@dataclass
class _Block:
    """Where a block is stored, the picks it has met, and a bound: its rows outside the pool have less reach, or the same and come after ``order`` (None: may come anywhere)."""

    folder: str
    met: int = 0
    reach: float = np.inf
    order: tuple | None = None

    def after(self, reach: float, order: tuple) -> bool:
        return reach > self.reach or (reach == self.reach and self.order is not None and order <= self.order)


class _Pool:
    """Rows with their exact reach."""

    def __init__(self):
        self.keys: list[tuple] = []
        self.x, self.reach, self.block = np.zeros((0, 0)), np.zeros(0), np.zeros(0, dtype=np.int64)

    def best(self) -> int | None:
        if not len(self.keys):
            return None
        ties = np.flatnonzero(self.reach == self.reach.max())
        return int(min(ties, key=lambda k: self.keys[k]))

    def keep(self, on: np.ndarray) -> None:
        self.keys = [k for k, kept in zip(self.keys, on, strict=True) if kept]
        self.x, self.reach, self.block = self.x[on], self.reach[on], self.block[on]

    def add(self, keys: list[tuple], x: np.ndarray, reach: np.ndarray, block: np.ndarray) -> None:
        self.x = np.concatenate([self.x, x]) if len(self.keys) else x
        self.keys = self.keys + keys
        self.reach, self.block = np.r_[self.reach, reach], np.r_[self.block, block]

    def take(self, at: int) -> tuple[tuple, np.ndarray]:
        """Remove a row, as a pick, and let the others meet it."""
        key, row = self.keys[at], self.x[at]
        on = np.ones(len(self.keys), dtype=bool)
        on[at] = False
        self.keep(on)
        gap = self.x - row
        self.reach = np.minimum(self.reach, np.sqrt(np.einsum("ij,ij->i", gap, gap)))
        return key, row


def lazy_picks(known: DataFrame, most: int, order: tuple[str, ...], settings: LazySettings = LazySettings(), work: Work | None = None) -> list[tuple[tuple, list[float]]]:
    """The first ``most`` picks of the rows (``order`` columns without nulls, ``v``), as (order values, vector).

    Start at the first row in order; then always the row farthest from all picks, the
    first of equal ones.  The picks and the pool are what reaches the driver: at most
    ``pool`` rows a visit, of which those of other blocks stay.
    """
    s, work, names = settings, work if work is not None else Work(), [f"o{k}" for k in range(len(order))]
    spark = known.sparkSession
    known = known.select(*(F.col(c).alias(n) for c, n in zip(order, names, strict=True)), "v")
    head = known.orderBy(*names).select(*names, "v").limit(s.sample).collect()
    if not head:
        return []
    first = np.array([r["v"] for r in head], dtype=np.float64)
    root = scratch_path(spark, "reach")
    placed = with_cells(known.select(*names, "v"), "v", first[farthest_rows(first, s.blocks)])
    placed.select(*names, "v", F.lit(float("inf")).alias("reach"), F.col("cell").alias("block")).write.partitionBy("block").option("compression", "zstd").parquet(f"{root}/visit-0")
    blocks = {r["block"]: _Block(f"{root}/visit-0") for r in spark.read.parquet(f"{root}/visit-0").select("block").distinct().collect()}

    picks = [(tuple(head[0][c] for c in names), first[0])]
    pool = _Pool()
    while len(picks) < most:
        best = pool.best()
        late = [b for b, own in blocks.items() if not np.isneginf(own.reach) and (best is None or not own.after(pool.reach[best], pool.keys[best]))]
        if late:
            work.visits += 1
            _visit(known, late, blocks, picks, names, pool, f"{root}/visit-{work.visits}", s, work)
        elif best is None:
            break
        else:
            picks.append(pool.take(best))
    return [(key, row.tolist()) for key, row in picks]


def _visit(known: DataFrame, late: list[int], blocks: dict[int, _Block], picks: list[tuple[tuple, np.ndarray]], names: list[str], pool: _Pool, target: str, s: LazySettings, work: Work) -> None:
    """Bring blocks up to date in a new folder, refill the pool from them, and bound what stays outside."""
    spark = known.sparkSession
    stored = None
    for folder in sorted({blocks[b].folder for b in late}):
        own = spark.read.parquet(folder).where(F.col("block").isin([b for b in late if blocks[b].folder == folder]))
        stored = own if stored is None else stored.unionByName(own)
    met = {b: blocks[b].met for b in late}
    handle = spark.sparkContext.broadcast((np.stack([row for _, row in picks]), pd.MultiIndex.from_tuples([key for key, _ in picks], names=names)))

    def update(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, keys = handle.value
        for f in frames:
            if not len(f):
                continue
            x, reach, block = np.stack(f["v"].to_numpy()), f["reach"].to_numpy().copy(), f["block"].to_numpy()
            for b in np.unique(block):
                own = block == b
                part, least = x[own], reach[own]
                for pick in rows[met[b] :]:
                    gap = part - pick
                    np.minimum(least, np.sqrt(np.einsum("ij,ij->i", gap, gap)), out=least)
                reach[own] = least
            near = np.flatnonzero(reach == 0.0)  # the picks are among these; they are marked below zero
            if len(near):
                reach[near[pd.MultiIndex.from_frame(f.iloc[near][names]).isin(keys)]] = -1.0
            yield f.assign(reach=reach)

    stored.mapInPandas(update, stored.schema).write.partitionBy("block").option("compression", "zstd").parquet(target)
    handle.destroy()
    fresh = spark.read.parquet(target)
    counted = {r["block"]: (r["n"], r["reach"]) for r in fresh.groupBy("block").agg(F.count("*").alias("n"), F.max("reach").alias("reach")).collect()}
    taken = fresh.where("reach >= 0").orderBy(F.desc("reach"), *names).limit(s.pool).collect()
    keys = [tuple(r[c] for c in names) for r in taken]
    pool.keep(~np.isin(pool.block, late))
    if taken:
        pool.add(keys, np.array([r["v"] for r in taken], dtype=np.float64), np.array([r["reach"] for r in taken]), np.array([r["block"] for r in taken]))
    for b in late:
        work.meetings += counted[b][0] * (len(picks) - met[b])
        if len(taken) < s.pool:
            reach, last = -np.inf, None
        elif counted[b][1] < taken[-1]["reach"]:
            reach, last = counted[b][1], None
        else:
            reach, last = taken[-1]["reach"], keys[-1]
        blocks[b] = _Block(target, len(picks), -np.inf if reach < 0 else reach, last)
