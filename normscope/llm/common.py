"""What the operators of this subpackage share: scratch tables, Arrow helpers, components."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, everywhere in this subpackage: a run of anything but these six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting (tests, notebooks) gets a folder of
    its own; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="normscope-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/normscope/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends at files any executor can read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` holds about ``most`` bytes in each part (one row at least); a column of whole numbers tells the bytes."""
    values = batch.column(column)
    if len(values) == 0:
        return
    sizes = np.asarray(pc.fill_null(values if pa.types.is_integer(values.type) else pc.binary_length(values), 0), dtype=np.int64)
    part = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(values)], strict=True):
        yield batch.slice(a, b - a)


@contextlib.contextmanager
def no_cycle_search() -> Iterator[None]:
    """Python's search for reference cycles walks all large containers again and again; a part's work makes none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, .. start+length-1 of every pair, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Regroup a key-sorted stream so that no key is cut, in parts of ``least_rows`` rows or a little more.

    Memory holds one part and the rows of its last key.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [np.asarray(table.column(k)) for k in keys]
        last = np.ones(rows, dtype=bool)
        for c in columns:
            last &= c == c[-1]
        cut = rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut == 0:
            continue
        yield table.slice(0, cut).combine_chunks().to_batches()[0]
        rest = table.slice(cut)
        held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Numbered(dict):
    """Numbers words in order of first sight; ``new`` lists those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Forest:
    """Union by smallest root over positions 0..n-1, for the rows of one part."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return int(x)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Join the pairs in turn; True where a pair joined two trees (these pairs span the components)."""
        used = np.zeros(len(a), dtype=bool)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            rx, ry = self.find(x), self.find(y)
            if rx != ry:
                self.parent[max(rx, ry)] = min(rx, ry)
                used[k] = True
        return used

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(p, q):
                return p
            p = self.parent = q


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of each component of some edges, and that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    forest = Forest(len(nodes))
    forest.join(at[: len(u)], at[len(u) :])
    roots = forest.roots()
    far = np.flatnonzero(roots != np.arange(len(nodes)))
    return nodes[far], nodes[roots[far]]


#: Edges that a task gathers before it contracts them.
HELD_EDGES = 500_000


def contract(batches: Iterator[pa.RecordBatch], held: int = 0) -> Iterator[pa.RecordBatch]:
    """Replace each part's edges by stars around the smallest node of each of the part's components.

    Parts are batches, or at least ``held`` edges of several; a part's stars go into the next
    part unless they are half of ``held``, so a task of fewer nodes hands on one star edge for each.
    """
    u, v, rows = [], [], 0
    for batch in batches:
        u.append(np.asarray(batch.column("u")))
        v.append(np.asarray(batch.column("v")))
        rows += batch.num_rows
        if rows < held or rows == 0:
            continue
        far, near = _stars(np.concatenate(u), np.concatenate(v))
        u, v, rows = [far], [near], len(far)
        if 2 * rows > held:
            yield pa.RecordBatch.from_arrays([pa.array(far), pa.array(near)], names=["u", "v"])
            u, v, rows = [], [], 0
    if rows:
        far, near = _stars(np.concatenate(u), np.concatenate(v))
        yield pa.RecordBatch.from_arrays([pa.array(far), pa.array(near)], names=["u", "v"])


def _with_least(edges: DataFrame, by: str, other: str, least: DataFrame, share: int) -> DataFrame:
    """Each edge with ``m``, the value that ``least (k, m, n)`` has for its end ``by``; n: edges of k.

    Keys of more than ``share`` edges are split over as many tasks as they have shares.
    They are few (edges / share), so their list is sent to all tasks.
    """
    pieces = F.ceil(F.col("n") / share).cast("int")
    hot = F.broadcast(least.where(F.col("n") > share).select(F.col("k").alias("h"), pieces.alias("pieces")))
    left = edges.join(hot, F.col(by) == F.col("h"), "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("pieces", F.lit(1))).cast("int")).drop("h", "pieces")
    right = least.select("k", "m", F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1)).alias("salt_of"))
    return left.join(right, (F.col(by) == F.col("k")) & (F.col("salt") == F.col("salt_of"))).drop("salt", "salt_of")


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 60, contracted: bool = False) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``edges (u, v)``; component is its smallest node.

    Each round hangs every node on the smallest neighbour it knows (large star,
    then small star), so distances shrink geometrically; a written table ends
    each round.  A node with more than a quarter of a partition's fair share of the
    edges, as the root of a large component is, is split over several tasks; there are
    at most eight such nodes a partition.  Nothing but two counters per round reaches
    the driver.  Edges with a null end and loops are ignored.  Empty input gives no rows.

    ``contracted``: the edges come out of :func:`contract` already, so no node is the larger end of more
    than an edge for each part of each task, but each task may have a star for the same nodes.  A shuffle by the larger
    end brings a node's stars together, and one edge for each node and those between the stars' centres
    are left, however many tasks a component was spread over.  Python functions that follow
    each other in one stage have a worker process each, and idle workers keep their memory.
    """
    spark = edges.sparkSession
    clean = edges.where("u is not null and v is not null").select(F.col("u").cast("long"), F.col("v").cast("long"))
    if contracted:
        met = clean.repartition(shuffle_partitions(spark), "u").mapInArrow(lambda batches: contract(batches, HELD_EDGES), "u long, v long")
    else:
        met = clean.mapInArrow(contract, "u long, v long")
    stars = materialise(met.distinct(), name)
    state = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    before = stars.agg(*state).first()
    for _ in range(most_rounds):
        share = max(64, before[0] // (4 * shuffle_partitions(spark)))
        # Rows (u, v) say u > v.  Large star: each node's larger neighbours move to the smallest of all its neighbours.
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"), "n")
        large = _with_least(stars, "v", "u", least, share).select("u", F.col("m").alias("v"))
        # Small star: each node's smaller neighbours, and the node, move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("k"), "m", "n")
        moved = _with_least(large, "u", "v", low, share).select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = moved.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u > v").distinct()
        stars = materialise(nxt, name)
        after = stars.agg(*state).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
