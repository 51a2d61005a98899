"""Near-duplicate vectors by E8 lattice hashing.

Each of several tables projects vectors onto eight random directions, shifts and
scales them, and decodes the result to the nearest point of the E8 lattice; the
point is the vector's cell.  A vector also probes the few neighbouring cells that
are next nearest to it, so a pair meets if either lies in, or probes, the other's
cell.  Pairs that meet are verified by their cosine in double precision.

A pair may meet in several cells; it counts only in the one that comes first in a
fixed order, which both vectors alone determine, so links are counted without any
list of pairs: a cell hands on each vector's number of links and a spanning
forest of them.  Equal vectors are one node throughout.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, connected_components, key_runs, materialise, shuffle_partitions
from .vector_search import is_usable, vectors_of


@dataclass(frozen=True)
class LatticeSettings:
    """With these, a pair at cosine 0.93 is missed once in some thousands (see the tests), closer ones more rarely.

    They hold at every size, so whether two vectors meet depends on these two alone.
    ``scale`` is the length of a unit vector in the lattice's units.  The larger it
    is, the fewer vectors meet by chance and the more ``tables`` a near pair needs;
    a caller who would rather miss more than compare more may ask for that by :meth:`for_rows`.
    """

    tables: int = 6
    probes: int = 4
    scale: float = 1.8
    block: int = 2_048
    seed: int = 5

    @classmethod
    def for_rows(cls, rows: int) -> LatticeSettings:
        """Settings for a counted number of different vectors, all missing at most one pair in a thousand at cosine 0.93.

        The share of all pairs that meet by chance in some table (random vectors of
        64 dimensions): 1.8 %, 0.33 %, 0.18 %.
        """
        tables, scale = (6, 1.8) if rows <= 100_000 else (14, 2.6) if rows <= 10_000_000 else (22, 3.0)
        return cls(tables=tables, scale=scale)


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


_SHORTEST = _neighbours()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates and an even sum: round, and if the sum is odd, round the worst the other way."""
    q = np.rint(x)
    off = x - q
    odd = np.flatnonzero(q.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    q[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return q


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 shifted by a half in every coordinate."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


def _cell_keys(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit keys of lattice points (twice the coordinates are whole)."""
    key = salt.astype(np.uint64)
    whole = np.rint(points * 2).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        for d in range(8):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + whole[..., d])
    return key.view(np.int64)


def signatures(vectors: np.ndarray, labels: np.ndarray, s: LatticeSettings) -> np.ndarray:
    """(n, tables, 1 + probes) cell keys of vectors under their labels; the first of a table is the vector's own cell."""
    n, width = vectors.shape
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.empty((n, s.tables, 1 + s.probes), dtype=np.int64)
    for t in range(s.tables):
        rng = np.random.default_rng([s.seed, t, width])
        plane = np.linalg.qr(rng.normal(size=(max(width, 8), 8)))[0][:width] * np.sqrt(max(width, 8) / 8.0) * s.scale
        at = x @ plane + rng.random(8)
        cell = nearest_e8(at)
        salt = _mix(labels.astype(np.int64).view(np.uint64) ^ np.uint64(t * 1_000_003 + width * 7919))
        out[:, t, 0] = _cell_keys(cell, salt)
        if s.probes:
            near = np.argsort(-((at - cell) @ _SHORTEST.T), axis=1, kind="stable")[:, : s.probes]
            for k in range(s.probes):
                out[:, t, 1 + k] = _cell_keys(cell + _SHORTEST[near[:, k]], salt)
    return out


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cell that owns each pair, given both signatures; the pairs do meet.

    The first table in which they meet; there, a shared own cell, else the second
    vector's cell if the first one probes it, else the first vector's.
    """
    n = len(a)
    same = a[:, :, 0] == b[:, :, 0]
    forth = (a[:, :, 1:] == b[:, :, :1]).any(axis=2)
    back = (b[:, :, 1:] == a[:, :, :1]).any(axis=2)
    table = np.argmax(same | forth | back, axis=1)
    row = np.arange(n)
    own = same[row, table] | ~forth[row, table]
    return np.where(own, a[row, table, 0], b[row, table, 0])


def _sign(batches: Iterator[pa.RecordBatch], s: LatticeSettings) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2_000):
            batch = whole.slice(at, 2_000)
            keys = signatures(vectors_of(batch.column("vec")), np.asarray(batch.column("label")), s)
            each = keys.shape[1] * keys.shape[2]
            role = np.ones(keys.shape, dtype=np.int8)
            role[:, :, 0] = 0
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.asarray(batch.column("node")), each)), pa.array(role.ravel())], names=["bucket", "node", "role"])


def _verify(batches: Iterator[pa.RecordBatch], least: float, s: LatticeSettings) -> Iterator[pa.RecordBatch]:
    """Links of each bucket: rows (0, node, links) and (1, node, node) of a spanning forest."""
    for part in key_runs(batches, ["bucket", "part"], 20_000):
        bucket, piece = np.asarray(part.column("bucket")), np.asarray(part.column("part"))
        node, role, side = (np.asarray(part.column(c)) for c in ("node", "role", "side"))
        copies, label = np.asarray(part.column("copies")), np.asarray(part.column("label"))
        vecs = vectors_of(part.column("vec"))
        norm = np.sqrt(np.einsum("ij,ij->i", vecs, vecs))
        edges = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(piece) != 0)) + 1
        first, last = np.concatenate([[0], edges]), np.concatenate([edges, [len(bucket)]])
        size = last - first
        run = np.repeat(np.arange(len(size)), size)
        # A part of two blocks compares across them; a part of one block compares its own rows.
        two = np.zeros(len(size), dtype=bool)
        two[run[side != side[first[run]]]] = True
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        small = size <= 64
        rows = np.flatnonzero(small[run])
        for step in range(1, int(size[small].max()) if small.any() else 1):
            rows = rows[rows + step < last[run[rows]]]
            i, j = rows, rows + step
            on = ((role[i] == 0) | (role[j] == 0)) & (~two[run[i]] | (side[i] != side[j]))
            i, j = i[on], j[on]
            cosine = np.einsum("ij,ij->i", vecs[i], vecs[j]) / (norm[i] * norm[j])
            on = cosine >= least
            pairs.append((i[on], j[on]))
        for k in np.flatnonzero(~small):
            a, b = first[k], last[k]
            left = np.flatnonzero(side[a:b] == side[a]) + a if two[k] else np.arange(a, b)
            right = np.flatnonzero(side[a:b] != side[a]) + a if two[k] else left
            for x in range(0, len(left), 512):
                i = left[x : x + 512]
                cosine = (vecs[i] @ vecs[right].T) / (norm[i][:, None] * norm[right][None, :])
                good = (cosine >= least - 1e-12) & ((role[i][:, None] == 0) | (role[right][None, :] == 0))
                if not two[k]:
                    good &= i[:, None] < right[None, :]
                p, q = np.nonzero(good)
                p, q = i[p], right[q]
                on = np.einsum("ij,ij->i", vecs[p], vecs[q]) / (norm[p] * norm[q]) >= least
                pairs.append((p[on], q[on]))
        i = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64)
        j = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64)
        on = node[i] != node[j]
        i, j = i[on], j[on]
        if not len(i):
            continue
        swap = node[i] > node[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        used, at = np.unique(node[np.concatenate([i, j])], return_index=True)
        where = np.concatenate([i, j])[at]
        marks = signatures(vecs[where], label[where], s)
        a, b = np.searchsorted(used, node[i]), np.searchsorted(used, node[j])
        mine = np.zeros(len(i), dtype=bool)
        for x in range(0, len(i), 50_000):
            mine[x : x + 50_000] = first_meeting(marks[a[x : x + 50_000]], marks[b[x : x + 50_000]]) == bucket[i[x : x + 50_000]]
        i, j, a, b = i[mine], j[mine], a[mine], b[mine]
        if not len(i):
            continue
        links = np.bincount(a, weights=copies[j], minlength=len(used)) + np.bincount(b, weights=copies[i], minlength=len(used))
        spanning = Forest(len(used)).join(a, b)
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.zeros(len(some), dtype=np.int8), np.ones(int(spanning.sum()), dtype=np.int8)])),
                pa.array(np.concatenate([used[some], used[b[spanning]]])),
                pa.array(np.concatenate([links[some].astype(np.int64), used[a[spanning]]])),
            ],
            names=["kind", "a", "b"],
        )


def linked_vectors(vectors: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", settings: LatticeSettings = LatticeSettings()) -> DataFrame:
    """One row per vector: key, ``n_links``, ``component_id``, ``kept``.

    Vectors of one label (and length) link at a cosine of ``least`` or more.
    Unusable vectors and null labels link with nothing: no links, their own id as
    component.  Each different vector of a label is a node of its own, whatever ids it
    has, and rows that repeat an id are vectors of their own: they share links only
    through their vectors.  Rows with a null id take no part: their component is null
    and they are not kept.  Links do not depend on how many other vectors there are.
    """
    spark = vectors.sparkSession
    n = shuffle_partitions(spark)
    named = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("kind"), F.col(vector).alias("vec"))
    able = F.col("id").isNotNull() & F.col("kind").isNotNull() & is_usable(F.col("vec"))
    usable = named.where(able)
    # Nodes are numbered once, and the written table keeps the numbers.
    nodes = usable.groupBy("kind", "vec").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialise(nodes.withColumn("label", F.xxhash64("kind", F.size("vec"))).withColumn("width", F.size("vec")), "vectors")
    s = settings
    keyed = None
    for width in [r[0] for r in nodes.select("width").distinct().collect()]:  # vectors of a table have one length, or few
        own = nodes.where(F.col("width") == width).select("node", "label", "vec").mapInArrow(lambda b: _sign(b, s), "bucket long, node long, role byte")
        keyed = own if keyed is None else keyed.unionByName(own)
    if keyed is None:
        return named.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    keyed = materialise(keyed, "cells")
    live = keyed.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum(F.when(F.col("role") == 0, 1).otherwise(0)).alias("homes")).where("rows > 1 and homes > 0")
    live = live.select("bucket", F.ceil(F.col("rows") / s.block).cast("int").alias("blocks"))
    # A crowded cell is dealt into blocks, and each pair of blocks is a part of its own.
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = keyed.join(live, "bucket").withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "node", "role", "side", (F.least("side", "other") * F.col("blocks") + F.greatest("side", "other")).alias("part"))
    met = dealt.join(nodes.select("node", "vec", "copies", "label"), "node")
    met = met.select("bucket", "part", "side", "role", "node", "copies", "label", "vec").repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part", "side")
    found = materialise(met.mapInArrow(lambda b: _verify(b, least, s), "kind byte, a long, b long"), "links")
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links")).withColumnRenamed("a", "node")
    reached = connected_components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")), "vectors")
    # A component is named by the smallest id of its vectors, not by a node's number.
    placed = nodes.select("node", "least").join(reached, "node")
    names = placed.groupBy("component").agg(F.min("least").alias("smallest"))
    components = placed.join(names, "component").select("node", "smallest")
    per_node = nodes.join(counts, "node", "left").join(components, "node", "left").select("kind", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("smallest", "least").alias("component"))
    joined = usable.join(per_node, ["kind", "vec"]).select("id", "links", "component")
    rest = named.where(~able).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return joined.unionByName(rest).select(F.col("id").alias(key), F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
