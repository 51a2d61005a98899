"""Exact nearest distances to a large bank, by pivots and the triangle inequality.

A few bank rows far from each other are pivots.  Every bank row belongs to the cell of
its nearest pivot, and within it to a ring of like distances; a cell's ring is a block.
Of each block the least and the largest distance to every pivot are known.  They bound
from below how near a query can be to any of its rows: a query whose own distance to a
pivot lies outside that span is at least the gap away.  From above, a query is as near
as its nearest pivot, which is a bank row.  Blocks whose lower bound is no less are
never visited.

Queries move once: they are written under a part each, queries near the same pivot
together.  A block's rows are copied to the parts that have a query which may need
them.  A task holds its part's queries and reads the copies as a stream, blocks that
may be nearest first; each block meets the queries whose bound it can still beat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.vectors import farthest_rows, least_distances
from ..sources.scratch import materialise


@dataclass(frozen=True)
class PivotSettings:
    """``sample``: bank rows (smallest hashes first) from which pivots are chosen; ``part_numbers``: components of the queries a task holds."""

    pivots: int = 48
    rings: int = 8
    sample: int = 4_096
    part_numbers: int = 8_000_000
    step: int = 1_024


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.list_flatten(column), dtype=np.float64).reshape(len(column), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(rows of x, rows of y) Euclidean distances, from differences: equal rows are at zero exactly."""
    out = np.empty((len(x), len(y)))
    for k, row in enumerate(y):
        gap = x - row
        out[:, k] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


@dataclass(frozen=True)
class Blocks:
    """What is known of the bank: the pivots, each cell's ring edges, and each block's span of distances to the pivots."""

    pivots: np.ndarray
    edges: dict[int, np.ndarray]
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def ring(self, cell: np.ndarray, reach: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cell), dtype=np.int32)
        for c, edges in self.edges.items():
            own = cell == c
            out[own] = np.searchsorted(edges, reach[own])
        return out

    def bounds(self, away: np.ndarray) -> np.ndarray:
        """(queries, blocks) lower bounds from the queries' distances to the pivots.

        Sums of rounded squares differ from the true ones by less than the share taken off, so a bound is never too large.
        """
        out = np.zeros((len(away), len(self.ids)))
        for p in range(away.shape[1]):
            d = away[:, p : p + 1]
            np.maximum(out, self.low[:, p] - d, out=out)
            np.maximum(out, d - self.high[:, p], out=out)
        scale = away.max(axis=1, initial=0.0)[:, None] + self.high.max(initial=0.0)
        return np.maximum(out - 1e-9 * scale, 0.0)


def choose_pivots(bank: DataFrame, s: PivotSettings) -> np.ndarray:
    picked = bank.orderBy(F.xxhash64("b"), "b").limit(s.sample).toPandas()["b"]
    x = np.array(picked.tolist(), dtype=np.float64)
    return x[farthest_rows(x, s.pivots)]


def with_cells(rows: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    """``rows`` with ``cell``, the nearest pivot, and ``reach``, the distance to it."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = distances(matrix(batch.column(vector)), pivots)
            cell = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away.min(axis=1))], names=[*names, "cell", "reach"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("reach", DoubleType())]))


def build_blocks(bank: DataFrame, s: PivotSettings) -> tuple[DataFrame, Blocks]:
    """The bank's rows under their block, written, and what queries need to know of the blocks (``pivots * rings`` at most)."""
    pivots = choose_pivots(bank, s)
    placed = materialise(with_cells(bank, "b", pivots), "bank-cells")
    shares = F.array(*(F.lit(k / s.rings) for k in range(1, s.rings)))
    edges = {r["cell"]: np.unique(r["edges"]) for r in placed.groupBy("cell").agg(F.percentile_approx("reach", shares).alias("edges")).collect()} if s.rings > 1 else {}
    known = Blocks(pivots, edges, np.zeros(0, np.int32), np.zeros((0, len(pivots))), np.zeros((0, len(pivots))))
    rings = s.rings

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each task hands on one row for a block and a pivot."""
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            cell = np.asarray(batch.column("cell"))
            block = cell * rings + known.ring(cell, np.asarray(batch.column("reach")))
            away = distances(matrix(batch.column("b")), pivots)
            for b in np.unique(block):
                own = away[block == b]
                low[b], high[b] = np.minimum(low.get(b, np.inf), own.min(axis=0)), np.maximum(high.get(b, -np.inf), own.max(axis=0))
        ids = sorted(low)
        many = len(pivots)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, many).astype(np.int32)), pa.array(np.tile(np.arange(many, dtype=np.int32), len(ids))), pa.array(np.concatenate([low[b] for b in ids]) if ids else np.zeros(0)), pa.array(np.concatenate([high[b] for b in ids]) if ids else np.zeros(0))],
            names=["block", "pivot", "low", "high"],
        )

    spans = placed.mapInArrow(span, "block int, pivot int, low double, high double").groupBy("block", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    spans = spans.sort_values(["block", "pivot"])
    ids = spans["block"].unique().astype(np.int32)
    blocks = Blocks(pivots, edges, ids, spans["low"].to_numpy().reshape(len(ids), -1), spans["high"].to_numpy().reshape(len(ids), -1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.asarray(batch.column("cell"))
            block = cell * rings + known.ring(cell, np.asarray(batch.column("reach")))
            yield pa.RecordBatch.from_arrays([batch.column("b"), pa.array(block.astype(np.int32))], names=["b", "block"])

    return placed.mapInArrow(place, "b array<double>, block int"), blocks


def meet(queries: np.ndarray, blocks: Blocks, stream: Iterator[tuple[int, np.ndarray]], step: int) -> tuple[np.ndarray, int]:
    """Each query's nearest distance over the pivots and the rows that ``stream`` gives, block by block, and the pairs compared."""
    away = distances(queries, blocks.pivots)
    best, compared = away.min(axis=1), 0
    place = {int(b): k for k, b in enumerate(blocks.ids)}
    bound = blocks.bounds(away)
    for block, rows in stream:
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            asking = np.flatnonzero(bound[:, place[block]] < best)
            if len(asking):
                best[asking] = np.minimum(best[asking], least_distances(queries[asking], part))
                compared += len(asking) * len(part)
    return best, compared


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        block = np.asarray(batch.column("block"))
        rows = matrix(batch.column("v"))
        for b in dict.fromkeys(block.tolist()):
            yield b, rows[block == b]


def nearest_by_pivots(queries: DataFrame, bank: DataFrame, vector: str, distance: str, settings: PivotSettings = PivotSettings(), compared: Accumulator | None = None) -> DataFrame:
    """The queries' columns without ``vector``, and ``distance`` to the nearest row of ``bank (b)``, which is not empty.

    Null vectors have a null distance.  ``compared`` counts the pairs whose distance is taken besides those with pivots.
    """
    s = settings
    kept = [c for c in queries.columns if c != vector]
    schema = queries.select(*kept).schema.add(distance, "double")
    placed, blocks = build_blocks(bank.select("b"), s)
    known = blocks.pivots

    row = F.struct(*kept) if kept else F.struct(F.lit(0).alias("none"))
    asked = queries.where(F.col(vector).isNotNull()).select(row.alias("row"), F.col(vector).cast("array<double>").alias("v"))
    asked = materialise(with_cells(asked, "v", known).select("row", "v", "cell", F.monotonically_increasing_id().alias("deal")), "asked")
    missing = queries.where(F.col(vector).isNull()).select(*kept, F.lit(None).cast("double").alias(distance))

    # Parts hold queries of one cell; their numbers follow from the counted cells, of which there are ``pivots``.
    most = max(1, s.part_numbers // max(1, known.shape[1]))
    counted = asked.groupBy("cell").count().orderBy("cell").collect()
    pieces = {r["cell"]: -(-r["count"] // most) for r in counted}
    first = {c: sum(n for d, n in pieces.items() if d < c) for c in pieces}
    parts = max(1, sum(pieces.values()))
    if pieces:
        cases = F.create_map(*(F.lit(x) for c in pieces for x in (c, first[c])))
        shares = F.create_map(*(F.lit(x) for c in pieces for x in (c, pieces[c])))
        part = (cases[F.col("cell")] + F.pmod("deal", shares[F.col("cell")])).cast("int")
    else:
        part = F.lit(0)
    dealt = asked.select("row", "v", part.alias("part"))
    handle = queries.sparkSession.sparkContext.broadcast(blocks)

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each part the blocks that one of its queries may need, with the least of the bounds."""
        found: dict[int, np.ndarray] = {}
        known = handle.value
        for batch in batches:
            if not batch.num_rows:
                continue
            away = distances(matrix(batch.column("v")), known.pivots)
            bound = known.bounds(away)
            bound[bound >= away.min(axis=1)[:, None]] = np.inf
            part = np.asarray(batch.column("part"))
            for p in np.unique(part):
                found[p] = np.minimum(found.get(p, np.inf), bound[part == p].min(axis=0))
        rows = [(p, known.ids[k], near[k]) for p, near in found.items() for k in np.flatnonzero(np.isfinite(near))]
        kinds = {"part": pa.int32(), "block": pa.int32(), "near": pa.float64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    pairs = dealt.select("v", "part").mapInArrow(needs, "part int, block int, near double").groupBy("part", "block").agg(F.min("near").alias("near"))
    # There are few blocks, so a block's rows are spread over several keys; a pair is copied for each.
    many = 16
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("b", F.monotonically_increasing_id()), F.lit(many)).cast("int"))
    copies = salted.join(pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))), ["block", "salt"])
    empty = F.lit(None).cast(asked.schema["row"].dataType)
    stream = copies.select("part", F.lit(False).alias("asks"), "near", "block", F.col("b").alias("v"), empty.alias("row"))
    asks = dealt.select("part", F.lit(True).alias("asks"), F.lit(0.0).alias("near"), F.lit(0).alias("block"), "v", "row")
    met = asks.unionByName(stream).repartitionById(parts, "part").sortWithinPartitions(F.desc("asks"), "near", "block").select("asks", "block", "v", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, vectors, rest = [], [], []
        for batch in batches:
            ask = batch.column("asks")
            own = batch.filter(ask)
            if own.num_rows:
                rows.append(own.column("row"))
                vectors.append(matrix(own.column("v")))
            if own.num_rows < batch.num_rows:
                rest.append(batch.filter(pc.invert(ask)))
                break
        if not rows:
            return

        def following() -> Iterator[pa.RecordBatch]:
            yield from rest
            yield from batches

        best, pairs_met = meet(np.concatenate(vectors), handle.value, _stream(following()), s.step)
        if compared is not None:
            compared.add(pairs_met)
        at = 0
        for part in rows:
            columns = [part.field(k) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(best[at : at + len(part)])], names=[*kept, distance])
            at += len(part)

    return met.mapInArrow(run, schema).unionByName(missing)
