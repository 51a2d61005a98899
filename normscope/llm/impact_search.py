"""Exact top-k by inner product: an impact-ordered index, read score at a time.

Components become integers.  In a block of rows each dimension is a list of postings,
cut into segments of rows with like values, which are the quantised impacts.  For a
query a segment is worth at most its weight times the segment's largest value (its
least one, under a negative weight), counted from the dimension's worst value; the
segments of all dimensions are read in descending order of that worth, whole runs of
them at a time (:meth:`ImpactIndex.search`).

After each run every row has an upper bound: what its segments were worth, and the
next segment's worth for each list in which it was not met yet.  The best rows so far are
scored exactly and give the score to beat.  Reading stops only when the bounds prove that
few rows can still reach it; all that can, ties included, are scored exactly.

Queries meet all rows in blocks: rows are dealt into parts, queries into chunks, and a
task reads one part's rows as a stream of blocks beside one chunk.  It holds a chunk, a
block and the chunk's best rows so far, whose scores a later block has to beat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions
from .vector_codes import is_finite


@dataclass(frozen=True)
class ImpactSettings:
    """``levels``: segments of a list at most; ``shares``: of the postings after which bounds are looked at; ``few``: possible rows at which reading ends."""

    scale: int = 256
    levels: int = 32
    shares: tuple[float, ...] = (1 / 32, 1 / 8, 1 / 3, 0.6, 0.75, 0.85, 0.93, 1.0)
    few: int = 48
    block: int = 8_192
    part_blocks: int = 32
    chunk: int = 4_096


#: A vector's squared length in integers stays below this, so no inner product leaves the range of a long.
MOST_PRODUCT = 1 << 62


class ImpactIndex:
    """Postings of one block: ``values`` is (rows, dims), in integers."""

    def __init__(self, values: np.ndarray, levels: int):
        self.values = values
        n, dims = values.shape
        self.least, self.most = (values.min(axis=0), values.max(axis=0)) if n else (np.zeros(dims, np.int64),) * 2
        step = (self.most - self.least) // levels + 1
        level = (values - self.least) // step
        order = np.argsort(level, axis=0, kind="stable")
        self.postings = order.T.ravel()
        sizes = np.bincount((np.arange(dims) * levels + level).ravel(), minlength=dims * levels)
        there = np.flatnonzero(sizes)
        self.dim, self.size = there // levels, sizes[there]
        self.start = np.cumsum(self.size) - self.size
        by_level = np.take_along_axis(values, order, axis=0).T.ravel()
        self.high = np.maximum.reduceat(by_level, self.start) if len(there) else self.start
        self.low = np.minimum.reduceat(by_level, self.start) if len(there) else self.start

    def scores(self, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.values[rows] @ weight

    def _posts(self, segments: np.ndarray) -> np.ndarray:
        """The postings of ascending segments; those that follow each other are one slice, as a run's segments of a list are."""
        if not len(segments):
            return self.postings[:0]
        cut = np.flatnonzero(np.diff(segments) > 1)
        first, last = segments[np.r_[0, cut + 1]], segments[np.r_[cut, len(segments) - 1]]
        return np.concatenate([self.postings[a:b] for a, b in zip(self.start[first].tolist(), (self.start[last] + self.size[last]).tolist(), strict=True)])

    def search(self, weight: np.ndarray, beat: np.ndarray, nearest: int, own: int, shares: tuple[float, ...], few: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows whose exact score may be among the ``nearest`` together with ``beat`` (known best scores of other rows), those scores, and the postings read.

        ``own``: a row to leave out, or -1.  Rows are left out on proof only: with fewer than ``nearest`` known
        scores none is, and a row that ties with the last of them is returned.
        """
        n = len(self.values)
        worst = np.where(weight >= 0, weight * self.least, weight * self.most)
        largest = (np.where(weight >= 0, weight * self.most, weight * self.least) - worst).astype(np.float64)
        w = weight[self.dim]
        worth = (np.where(w >= 0, w * self.high, w * self.low) - worst[self.dim]).astype(np.float64)
        on = np.flatnonzero(w)
        on = on[np.argsort(-worth[on], kind="stable")]
        read = np.r_[0, np.cumsum(self.size[on])]
        base = float(worst.sum())
        slack = (largest.sum() + abs(base) + 1) * (len(weight) + 2) * 2.0**-50  # above what rounding of the sums can amount to
        met, lists, touched = np.zeros(n), np.zeros(n), np.zeros(len(weight), dtype=bool)
        reach = np.sort(beat)[::-1][:nearest]
        at = 0
        for end in np.unique(np.searchsorted(read, read[-1] * np.array((0.0, *shares)))):
            part = np.sort(on[at:end])
            posts = self._posts(part)
            met += np.bincount(posts, weights=np.repeat(worth[part], self.size[part]), minlength=n)
            lists += np.bincount(posts, minlength=n)
            touched[self.dim[part]] = True
            at = int(end)
            rest = worth[on[at]] if at < len(on) else 0.0
            bound = base + met - rest * lists + np.where(touched, rest, largest).sum() + slack
            if own >= 0:
                bound[own] = -np.inf
            lead = np.argpartition(-bound, nearest)[:nearest] if n > nearest else np.arange(n)
            known = np.sort(np.r_[beat, self.scores(weight, lead[lead != own])])[::-1][:nearest]
            if len(known) == nearest and (len(reach) < nearest or known[-1] > reach[-1]):
                reach = known
            possible = bound >= reach[-1] if len(reach) == nearest else np.isfinite(bound)
            if np.count_nonzero(possible) <= max(few, nearest):
                break
        rows = np.flatnonzero(possible)
        return rows, self.scores(weight, rows), int(read[at])


def whole_numbers(vectors: DataFrame, queries: Column, key: str, vector: str, scale: int) -> DataFrame:
    """``row``, ``id``, ``asks``, ``q``: floor(scale * x) of every finite vector under a row number of its own."""
    most = F.sqrt(F.lit(float(MOST_PRODUCT)) / F.greatest(F.size("v"), F.lit(1)))
    floors = F.when(F.forall("v", lambda x: F.abs(x * scale) < most), F.transform("v", lambda x: F.floor(x * scale))).otherwise(F.raise_error(F.lit("a component is beyond what the integers hold")))
    kept = vectors.where(is_finite(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.col(vector).cast("array<double>").alias("v"))
    return kept.select(F.monotonically_increasing_id().alias("row"), "id", "asks", floors.alias("q"))


@dataclass
class _Asked:
    row: int
    id: int | None
    weight: np.ndarray
    scores: np.ndarray
    ids: np.ndarray
    null: np.ndarray


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(pc.list_flatten(column), dtype=np.int64).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def _meet(asked: list[_Asked], block: pa.Table, nearest: int, s: ImpactSettings) -> None:
    """Bring the best rows of each query up to date with one block of rows of the queries' length."""
    row = np.asarray(block.column("row"))
    ids, null = np.asarray(pc.fill_null(block.column("id"), 0)), np.asarray(pc.is_null(block.column("id")))
    index = ImpactIndex(_matrix(block.column("q").combine_chunks(), len(row)), s.levels)
    place = {int(r): k for k, r in enumerate(row)}
    for q in asked:
        rows, score, _ = index.search(q.weight, q.scores, nearest, place.get(q.row, -1), s.shares, s.few)
        score, found, none = np.r_[q.scores, score], np.r_[q.ids, ids[rows]], np.r_[q.null, null[rows]]
        best = np.lexsort((found, none, -score))[:nearest]
        q.scores, q.ids, q.null = score[best], found[best], none[best]


def _search_part(batches: Iterator[pa.RecordBatch], nearest: int, s: ImpactSettings) -> Iterator[pa.RecordBatch]:
    """A chunk's queries come first, then a part's rows by vector length."""
    asked: dict[int, list[_Asked]] = {}
    held: list[pa.RecordBatch] = []
    rows, width = 0, -1

    def flush() -> None:
        nonlocal held, rows
        if rows and asked.get(width):
            _meet(asked[width], pa.Table.from_batches(held), nearest, s)
        held, rows = [], 0

    for batch in batches:
        ask = np.asarray(batch.column("asks"))
        for r in batch.filter(pa.array(ask)).to_pylist():
            weight = np.array(r["q"], dtype=np.int64)
            asked.setdefault(len(weight), []).append(_Asked(r["row"], r["id"], weight, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)))
        own = batch.filter(pa.array(~ask))
        sizes = np.asarray(pc.list_value_length(own.column("q")))
        for size in np.unique(sizes):
            part = own.filter(pa.array(sizes == size))
            if size != width:
                flush()
                width = int(size)
            while part.num_rows:
                taken = part.slice(0, s.block - rows)
                held.append(taken)
                rows += taken.num_rows
                part = part.slice(taken.num_rows)
                if rows == s.block:
                    flush()
    flush()
    kinds = {"row": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
    for q in (q for own in asked.values() for q in own):
        n = len(q.scores)
        columns = [pa.array([q.row] * n, pa.int64()), pa.array([q.id] * n, pa.int64()), pa.array(q.ids, pa.int64(), mask=q.null), pa.array(q.scores, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=list(kinds))


def search(vectors: DataFrame, queries: Column, nearest: int = 5, key: str = "vec_id", vector: str = "embedding", settings: ImpactSettings = ImpactSettings()) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``nearest`` rows by inner product for each row where ``queries`` is true.

    Exact.  Scores are of floor(scale * x); ties go to the smaller id, null ids last.  A row is no
    candidate of its own; other rows of its id are, and each row that asks is answered,
    so repeated ids have repeated answers.  Vectors that are null or hold null or
    non-finite components take no part; vectors of each length are searched among
    themselves, those of length zero all score zero.  Fewer candidates give fewer rows, a
    query without any gives none, and so does an empty table.  Components so large that a product
    could leave the range of a long end the job with an error.
    """
    s = settings
    numbers = materialise(whole_numbers(vectors, queries, key, vector, s.scale), "impacts")
    n, asking = numbers.agg(F.count("*"), F.count_if("asks")).first()
    blocks = max(1, -(-n // s.block))
    parts = min(blocks, max(shuffle_partitions(numbers.sparkSession), -(-blocks // s.part_blocks)))
    chunks = max(1, -(-asking // s.chunk))
    by_row = F.xxhash64("row")
    part, chunk = F.pmod(by_row, F.lit(parts)).cast("int"), F.pmod(by_row, F.lit(chunks)).cast("int")
    every = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    stored = numbers.select(part.alias("part"), every(chunks).alias("chunk"), "row", "id", F.lit(False).alias("asks"), "q")
    asks = numbers.where("asks").select(every(parts).alias("part"), chunk.alias("chunk"), "row", "id", "asks", "q")
    met = stored.unionByName(asks).repartitionById(parts * chunks, F.col("chunk") * parts + F.col("part")).sortWithinPartitions(F.desc("asks"), F.size("q"), "row")
    found = met.select("row", "id", "asks", "q").mapInArrow(lambda b: _search_part(b, nearest, s), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())  # ``nearest`` rows of each part
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def oracle_sql(nearest: int = 5, settings: ImpactSettings = ImpactSettings()) -> str:
    """Every pair's product; exact in doubles for vectors of ordinary length."""
    return f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor({settings.scale} * x)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda c: c IS NULL OR NOT isfinite(c)), true)),
p AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(CASE WHEN len(a.v) = 0 THEN 0 ELSE list_dot_product(a.v, b.v) END AS BIGINT) AS score FROM e a JOIN e b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= {nearest}"""
