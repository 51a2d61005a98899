"""Nearest neighbours: an inverted file with product-quantised residuals, and an exact check of what it may have missed.

Vectors are scaled to length one.  Coarse centroids and the codebooks of the
residuals are trained in numpy on a bounded sample (``train`` vectors, smallest
hashes of their ids first); every vector is then assigned to its nearest centroid
and its residual is coded.  A query visits the cells nearest to it, ranks their
codes by tables of query-to-codeword products, and the best of each block of a
cell are ranked again by the exact cosine of the original vectors.

The last of the nearest so found is a floor: nothing below it can be in the answer.  The
query then visits every cell that may hold a row at or above the floor, by the triangle
inequality and the cell's radius, and there compares every row whose code, with the
length of what the code leaves out, does not rule it out.  So the answer is complete
whatever the rows are like; where nearness follows the cells few of them are visited,
where vectors are spread at random nearly all.

Equal vectors are one node, which holds its smallest ids: as many as an answer can
need.  Nodes with the same code score as the last of the best are ranked again too.

A cell's vectors are dealt into blocks of at most about ``block`` rows, and its
visitors into groups of at most about ``visitors``, so one task never holds a
whole cell of unbounded size; the dealing travels with the number of cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import expand, key_runs, materialise, shuffle_partitions


@dataclass(frozen=True)
class SearchSettings:
    """None of these changes an answer, only what it costs.

    ``probe``: share of the cells that a query visits for its floor; None: its ``first`` nearest ones.
    ``shortlist``: codes of each block that are ranked again for the floor, and all that tie with the last.
    """

    train: int = 8_192
    least_cells: int = 16
    most_cells: int = 4_096
    parts: int = 16
    codewords: int = 256
    probe: float | None = None
    first: int = 4
    shortlist: int = 24
    block: int = 4_096
    visitors: int = 4_096
    rounds: int = 6
    seed: int = 11


#: Far more than rounding does to bounds and cosines of unit vectors.
SLACK = 1e-9


def is_usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zeros."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(column: pa.Array, kind=np.float64) -> np.ndarray:
    """An (n, d) array of list values of one length."""
    flat = np.asarray(pc.list_flatten(column), dtype=kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Nearest centroid of each row, in slices of bounded size."""
    half = (centroids**2).sum(axis=1) / 2
    out = np.empty(len(x), dtype=np.int64)
    step = max(1, 100_000 // len(centroids))  # stays in the cache
    for a in range(0, len(x), step):
        out[a : a + step] = np.argmax(x[a : a + step] @ centroids.T - half, axis=1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centroids = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centroids)
        size = np.bincount(at, minlength=len(centroids))
        sums = np.stack([np.bincount(at, weights=x[:, d], minlength=len(centroids)) for d in range(x.shape[1])], axis=1)
        filled = size > 0
        centroids[filled] = sums[filled] / size[filled, None]
        centroids[~filled] = x[rng.choice(len(x), size=int((~filled).sum()))]
    return centroids


@dataclass
class Quantizer:
    """Coarse centroids and, for each part of the dimensions, a codebook of residuals."""

    centroids: np.ndarray
    bounds: np.ndarray
    codebooks: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, s: SearchSettings) -> Quantizer:
        rng = np.random.default_rng(s.seed)
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        centroids = k_means(x, cells, s.rounds, rng)
        rest = x - centroids[_nearest(x, centroids)]
        bounds = np.linspace(0, x.shape[1], min(s.parts, x.shape[1]) + 1).astype(int)
        books = [k_means(rest[:, a:b], s.codewords, s.rounds, rng) for a, b in zip(bounds, bounds[1:], strict=False)]
        return cls(centroids, bounds, books)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell and codes of each row, its distance from the centroid, and from what the codes stand for."""
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        cell = _nearest(x, self.centroids)
        rest = x - self.centroids[cell]
        codes = np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.bounds, self.bounds[1:], self.codebooks, strict=False)], axis=1)
        told = np.concatenate([book[codes[:, p]] for p, book in enumerate(self.codebooks)], axis=1)
        return cell, codes.astype(np.uint8), np.linalg.norm(rest, axis=1), np.linalg.norm(rest - told, axis=1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, parts, codewords): products of each query's part with each codeword."""
        width = max(len(b) for b in self.codebooks)
        out = np.zeros((len(queries), len(self.codebooks), width))
        for p, (a, b, book) in enumerate(zip(self.bounds, self.bounds[1:], self.codebooks, strict=False)):
            out[:, p, : len(book)] = queries[:, a:b] @ book.T
        return out


def train_quantizer(vectors: DataFrame, key: str, vector: str, rows: int, s: SearchSettings) -> Quantizer:
    """Fit on at most ``train`` rows; the number of cells follows the square root of all rows."""
    picked = vectors.select(vector).orderBy(F.xxhash64(key), key).limit(s.train).toPandas()[vector]
    sample = np.array(picked.tolist(), dtype=np.float64)
    cells = int(np.clip(2 ** round(np.log2(max(1.0, np.sqrt(rows)))), s.least_cells, s.most_cells))
    return Quantizer.fit(sample, min(cells, len(sample)), s)


def nodes_of(vectors: DataFrame, nearest: int, key: str, vector: str) -> DataFrame:
    """``id``, ``vec``, ``ids``: each distinct vector with its ``nearest`` + 1 smallest ids (a query's own may be among them).

    An id that repeats stands in ``ids`` as often as it does, ``nearest`` times at most.  ``id`` is the smallest.
    """
    counted = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec")).groupBy("vec", "id").agg(F.least(F.count("*"), F.lit(nearest)).cast("int").alias("times"))
    first = counted.withColumn("at", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("at") <= nearest + 1)
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "times"))), lambda x: F.array_repeat(x["id"], x["times"])))
    return first.groupBy("vec").agg(F.min("id").alias("id"), ids.alias("ids")).select("id", "vec", "ids")


def build_index(nodes: DataFrame, quantizer: Quantizer) -> DataFrame:
    """``id``, ``vec``, ``ids``, ``cell``, ``code``, ``gap`` (from the centroid), ``rest`` (from the code): every node coded.  The quantizer's size is bounded by its settings."""
    handle = nodes.sparkSession.sparkContext.broadcast(quantizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, codes, gap, rest = handle.value.code(vectors_of(batch.column("vec")))
                made = [pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(gap), pa.array(rest)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), batch.column("ids"), *made], names=["id", "vec", "ids", "cell", "code", "gap", "rest"])

    return nodes.mapInArrow(run, f"id long, vec {dict(nodes.dtypes)['vec']}, ids array<long>, cell int, code binary, gap double, rest double")


@dataclass(frozen=True)
class Cells:
    """Centroids, how many rows each cell holds, and how far the farthest of them is from the centroid."""

    centroids: np.ndarray
    rows: np.ndarray
    radius: np.ndarray


def _visit(queries: DataFrame, cells: Cells, probe: int, wanted: int) -> DataFrame:
    """A row for each query (id, vec, least) and cell that it visits.

    With a floor ``least``, those are all cells that may hold a row of that cosine; without one, the ``probe``
    nearest, and more where those hold fewer than ``wanted`` rows.
    """
    handle = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = handle.value
        sizes = (c.centroids**2).sum(axis=1)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = vectors_of(batch.column("vec"))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                apart = sizes - 2.0 * (x @ c.centroids.T)
                order = np.argsort(apart, axis=1, kind="stable")
                before = np.cumsum(c.rows[order], axis=1) - c.rows[order]
                first = np.zeros(apart.shape, dtype=bool)
                np.put_along_axis(first, order, (np.arange(len(sizes)) < probe) | (before < wanted), axis=1)
                least = np.asarray(batch.column("least").cast(pa.float64()).to_numpy(zero_copy_only=False))[:, None]
                beyond = np.maximum(np.sqrt(np.maximum(apart + 1.0, 0.0)) - c.radius, 0.0)
                row, near = np.nonzero(np.where(np.isnan(least), first, 1.0 - beyond**2 / 2 >= least - SLACK) & (c.rows > 0))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in ("id", "vec", "least")), pa.array(near.astype(np.int32))], names=["id", "vec", "least", "cell"])

    return queries.select("id", "vec", "least").mapInArrow(run, f"id long, vec {dict(queries.dtypes)['vec']}, least double, cell int")


def exact_cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of aligned rows, in double precision."""
    product = np.einsum("ij,ij->i", queries, vectors)
    return product / np.sqrt(np.einsum("ij,ij->i", queries, queries) * np.einsum("ij,ij->i", vectors, vectors))


def _search_blocks(batches: Iterator[pa.RecordBatch], quantizer: Quantizer, nearest: int, shortlist: int) -> Iterator[pa.RecordBatch]:
    """Per block and visitor, the ``nearest`` rows by exact cosine: of all nodes that may reach the visitor's floor ``least``.

    A visitor without a floor compares the ``shortlist`` best nodes by code and those that tie with the last.
    """
    names = ["query_id", "vec_id", "score"]
    for part in key_runs(batches, ["cell", "block", "group"], 2_000):
        cell, block, group = (np.asarray(part.column(c)) for c in ("cell", "block", "group"))
        edges = np.flatnonzero(np.diff(cell) | np.diff(block) | np.diff(group)) + 1
        ids, vecs = np.asarray(part.column("id")), vectors_of(part.column("vec"))
        asks = np.asarray(part.column("asks"))
        coded, rest = part.column("code"), np.asarray(part.column("rest").to_numpy(zero_copy_only=False))
        least = np.asarray(part.column("least").to_numpy(zero_copy_only=False), dtype=np.float64)
        lengths = np.asarray(pc.fill_null(pc.list_value_length(part.column("ids")), 0), dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        held = np.asarray(pc.list_flatten(part.column("ids")), dtype=np.int64)
        for a, b in zip([0, *edges], [*edges, len(cell)], strict=True):
            q, v = np.flatnonzero(asks[a:b]) + a, np.flatnonzero(asks[a:b] == 0) + a
            if not len(q) or not len(v):
                continue
            codes = np.frombuffer(b"".join(coded.take(pa.array(v)).to_pylist()), dtype=np.uint8).reshape(len(v), -1)
            unit = vecs[v] / np.linalg.norm(vecs[v], axis=1, keepdims=True)
            for at in range(0, len(q), 64):
                asked = q[at : at + 64]
                x = vecs[asked] / np.linalg.norm(vecs[asked], axis=1, keepdims=True)
                tables = quantizer.tables(x)
                rough = np.repeat((x @ quantizer.centroids[cell[a]])[:, None], len(v), axis=1)
                for p in range(codes.shape[1]):
                    rough += tables[:, p, codes[:, p]]
                low, high = held[starts[v]], held[starts[v] + lengths[v] - 1]
                rough[(low == high)[None, :] & (ids[asked][:, None] == low[None, :])] = -np.inf  # nodes of no other id
                floor = least[asked][:, None]
                n = min(shortlist, len(v))
                last = -np.partition(-rough, n - 1, axis=1)[:, n - 1 : n]
                on = np.where(np.isnan(floor), rough >= last, rough + rest[v] >= floor - SLACK) & (rough > -np.inf)
                # A matrix product screens what the codes leave, exact cosines decide.
                some = np.flatnonzero(on.any(axis=0))
                on[:, some] &= np.isnan(floor) | (x @ unit[some].T >= floor - SLACK)
                row, col = np.nonzero(on)
                score = np.empty(len(row))
                for k in range(0, len(row), 8_192):
                    score[k : k + 8_192] = exact_cosines(vecs[asked[row[k : k + 8_192]]], vecs[v[col[k : k + 8_192]]])
                found = held[expand(starts[v[col]], lengths[v[col]])]
                row, score = np.repeat(row, lengths[v[col]]), np.repeat(score, lengths[v[col]])
                on = found != ids[asked][row]
                row, score, found = row[on], score[on], found[on]
                order = np.lexsort((found, -score, row))
                row, score, found = row[order], score[order], found[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                on = rank < nearest
                yield pa.RecordBatch.from_arrays([pa.array(ids[asked][row[on]]), pa.array(found[on]), pa.array(score[on])], names=names)


SCHEMA = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, queries: Column, nearest: int = 5, key: str = "vec_id", vector: str = "embedding", settings: SearchSettings = SearchSettings()) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the nearest rows found for each row where ``queries`` is true.

    Score: cosine of the original vectors in double precision; ties go to the
    smaller id.  A row is no candidate of its own, nor are rows of its id.
    Unusable vectors (see :func:`is_usable`) and rows without an id take no part;
    vectors of each length are searched among themselves.  Of repeated ids all rows
    count as candidates; a query id that repeats is answered once for each length.
    """
    usable = vectors.where(is_usable(F.col(vector)) & F.col(key).isNotNull())
    found = None
    for width in [r[0] for r in usable.select(F.size(vector)).distinct().orderBy(F.size(vector)).collect()]:  # a table has one length, or few
        own = _search_width(usable.where(F.size(vector) == width), queries, nearest, key, vector, settings)
        found = own if found is None else found.unionByName(own)
    return found if found is not None else vectors.sparkSession.createDataFrame([], SCHEMA)


def _met(index: DataFrame, visits: DataFrame, quantizer: Quantizer, nearest: int, s: SearchSettings) -> DataFrame:
    """``query_id``, ``vec_id``, ``score``: the nearest of each block that a query visits."""
    spark = index.sparkSession
    # Rows and visitors of each cell: as many numbers as there are cells.
    deal = index.groupBy("cell").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks")).join(visits.groupBy("cell").agg(F.ceil(F.count("*") / s.visitors).cast("int").alias("groups")), "cell")
    deal = F.broadcast(deal)  # at most ``most_cells`` rows
    stored = index.join(deal, "cell").select(
        "cell", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(0).alias("asks"), "id", "vec", "ids", "code", "rest", F.lit(None).cast("double").alias("least")
    )
    asking = visits.join(deal, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), "groups").cast("int").alias("group"), F.lit(1).alias("asks"), "id", "vec", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("rest"), "least"
    )
    met = stored.unionByName(asking).repartition(shuffle_partitions(spark), "cell", "block", "group").sortWithinPartitions("cell", "block", "group")
    handle = spark.sparkContext.broadcast(quantizer)
    return met.mapInArrow(lambda b: _search_blocks(b, handle.value, nearest, s.shortlist), "query_id long, vec_id long, score double")


def _search_width(usable: DataFrame, queries: Column, nearest: int, key: str, vector: str, s: SearchSettings) -> DataFrame:
    nodes = materialise(nodes_of(usable, nearest, key, vector), "nodes")
    quantizer = train_quantizer(nodes, "id", "vec", nodes.count(), s)
    cells = len(quantizer.centroids)
    index = materialise(build_index(nodes, quantizer), "ivfpq")
    # Written, as of a query id that repeats any vector may be taken.
    asked = materialise(usable.where(queries).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec")).dropDuplicates(["id"]), "asked")
    held, radius = np.zeros(cells, dtype=np.int64), np.zeros(cells)
    for r in index.groupBy("cell").agg(F.sum(F.size(F.array_distinct("ids"))).alias("rows"), F.max("gap").alias("radius")).collect():  # at most ``most_cells`` rows
        held[r["cell"]], radius[r["cell"]] = r["rows"], r["radius"]
    known = Cells(quantizer.centroids, held, radius)
    probe = s.first if s.probe is None else max(1, int(np.ceil(cells * s.probe)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        """A query has ``nearest`` rows at most for each block it visited; the best of them."""
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)

    # One more than asked for: the query's own row is among them.
    visits = materialise(_visit(asked.withColumn("least", F.lit(None).cast("double")), known, probe, nearest + 1), "visits")
    floors = best(_met(index, visits, quantizer, nearest, s)).groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == nearest, F.min("score")).alias("least"))
    # A query that found fewer has no floor: everything may be in its answer.
    visits = materialise(_visit(asked.join(floors, "id", "left").select("id", "vec", F.coalesce("least", F.lit(-2.0)).alias("least")), known, probe, nearest + 1), "visits")
    found = _met(index, visits, quantizer, nearest, s)
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
