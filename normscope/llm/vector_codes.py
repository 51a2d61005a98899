"""Vector code compression: product codes trained in integers, assigned by partial-distance search.

A vector's components become integers, its parts are coded by the nearest entry of a
codebook of their own position.  Training is a few passes over the table: tasks assign
their rows and add up each entry's parts, Spark adds the tasks' sums, and the driver
holds nothing but codebooks (``parts * entries`` short rows).

The search for the nearest entry (:func:`nearest_entries`) goes through a part's
dimensions in descending variance of the codebook, so that distances grow early.
Every part starts from one entry's complete distance; masks then drop, dimension by
dimension and for all rows of a batch at once, each entry whose distance so far
strictly exceeds the best complete one.  All arithmetic is in integers, so results
do not depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions


@dataclass(frozen=True)
class CodeSettings:
    """``batch``: rows that are compared at once; ``hot_share``: labels above this share of a partition's rows are not shuffled."""

    scale: int = 4_096
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    batch: int = 8_192
    hot_share: float = 0.25


#: A vector's squared distances stay below this, half of what a long holds.
MOST_DISTANCE = 1 << 62


def is_finite(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    good = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def whole_numbers(vectors: DataFrame, key: str, vector: str, label: str, s: CodeSettings) -> DataFrame:
    """``id``, ``label``, ``q``: floor(scale * x) of every finite vector, filled up with zeros to a multiple of ``parts`` components."""
    spare = F.array_repeat(F.lit(0), F.pmod(-F.size("v"), F.lit(s.parts)))
    floors = F.transform("v", lambda x: F.floor(x * s.scale))
    most = F.sqrt(F.lit(float(MOST_DISTANCE // 4)) / F.greatest(F.size("v"), F.lit(1)))
    checked = F.when(F.forall("v", lambda x: F.abs(x * s.scale) < most), F.concat(F.transform(floors, lambda x: x.cast("int")), spare)).otherwise(F.raise_error(F.lit("a component is beyond what the codes' integers hold")))
    kept = vectors.where(is_finite(F.col(vector))).select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return kept.select("id", "label", checked.alias("q"))


def search_order(book: np.ndarray) -> np.ndarray:
    """Dimensions of an (entries, dims) codebook by descending variance, ties by place."""
    spread = len(book) * (book**2).sum(axis=0) - book.sum(axis=0) ** 2
    return np.argsort(-spread, kind="stable")


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of ``x`` (rows, dims) the nearest entry of ``book`` and its squared distance; ties go to the lower index.

    Third, the number of component differences that were squared; a full search takes ``rows * entries * dims``.
    """
    rows, dims = x.shape
    if not dims or not rows:
        return np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64), 0
    order = search_order(book)
    x, book = x[:, order], book[:, order]
    so_far = (x[:, :1] - book[None, :, 0]) ** 2  # (rows, entries): every entry's distance in the first dimension
    guess = so_far.argmin(axis=1)
    best = ((x - book[guess]) ** 2).sum(axis=1)
    work = rows * len(book) + rows * dims
    row, entry = np.nonzero(so_far <= best[:, None])
    so_far = so_far[row, entry]
    for d in range(1, dims):
        so_far += (x[row, d] - book[entry, d]) ** 2
        work += len(row)
        live = so_far <= best[row]
        if not live.all():
            row, entry, so_far = row[live], entry[live], so_far[live]
    # What is left is complete, the guess or as near: of each row the least distance, then the least entry.
    first = np.lexsort((entry, so_far, row))
    lead = first[np.r_[True, np.diff(row[first]) > 0]]
    return entry[lead], so_far[lead], work


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Slices of at most ``most`` rows as (slice, length, matrix), rows of one vector length at a time."""
    for batch in batches:
        sizes = np.asarray(pc.list_value_length(batch.column("q")))
        for width in np.unique(sizes):
            same = batch.filter(pa.array(sizes == width))
            for a in range(0, same.num_rows, most):
                part = same.slice(a, most)
                yield part, int(width), np.asarray(pc.list_flatten(part.column("q")), dtype=np.int64).reshape(part.num_rows, int(width))


def assign(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and squared distances summed over the parts."""
    codes, error = np.zeros((len(x), len(books)), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    for p, (own, book) in enumerate(zip(np.split(x, len(books), axis=1), books, strict=True)):
        codes[:, p], gap, _ = nearest_entries(own, book)
        error += gap
    return codes, error


Books = dict[int, list[np.ndarray]]


def first_books(numbers: DataFrame, s: CodeSettings) -> Books:
    """For each vector length, the parts of the vectors with the smallest ids; rows of equal ids in the order of their components."""
    order = Window.partitionBy(F.size("q")).orderBy(F.col("id").asc_nulls_last(), "q")
    head = numbers.select("q", F.row_number().over(order).alias("place")).where(F.col("place") <= s.entries).orderBy("place").collect()
    books: Books = {}
    for width in sorted({len(r["q"]) for r in head}):
        rows = [r["q"] for r in head if len(r["q"]) == width]
        own = np.array(rows, dtype=np.int64).reshape(len(rows), width)
        books[width] = [np.ascontiguousarray(b) for b in np.split(own, s.parts, axis=1)]
    return books


def one_round(numbers: DataFrame, books: Books, s: CodeSettings) -> Books:
    """Entries replaced by the floor of the mean of the parts assigned to them; unused ones stay.

    A task hands on at most one row for each entry in use, whatever it has read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        counts: dict[int, np.ndarray] = {}
        for _, width, x in _blocks(batches, s.batch):
            own = books[width]
            if width not in sums:
                sums[width], counts[width] = [np.zeros_like(b) for b in own], np.zeros((s.parts, len(own[0])), dtype=np.int64)
            codes, _ = assign(x, own)
            for p, part in enumerate(np.split(x, s.parts, axis=1)):
                np.add.at(sums[width][p], codes[:, p], part)
                counts[width][p] += np.bincount(codes[:, p], minlength=len(own[p]))
        rows = [(width, p, e, int(counts[width][p, e]), sums[width][p][e].tolist()) for width in sums for p, e in zip(*np.nonzero(counts[width]), strict=True)]
        names = ["width", "part", "entry", "n", "total"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    added = numbers.select("q").mapInArrow(run, "width int, part int, entry int, n long, total array<long>")
    spread = added.select("width", "part", "entry", "n", F.posexplode_outer("total").alias("place", "x"))
    met = spread.groupBy("width", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # as many numbers as the codebooks hold
    new = {width: [b.copy() for b in own] for width, own in books.items()}
    for r in met:
        if r["place"] is not None:
            new[r["width"]][r["part"]][r["entry"], r["place"]] = r["x"] // r["n"]
    return new


def books_digest(books: Books) -> str:
    """SHA-256 of all entries' components in decimal, by length, part, entry and place, joined by commas."""
    text = ",".join(str(x) for width in sorted(books) for book in books[width] for x in book.ravel().tolist())
    return hashlib.sha256(text.encode()).hexdigest()


def with_label_sums(coded: DataFrame, s: CodeSettings) -> DataFrame:
    """``label_error``: the error summed over the rows of the same label, nulls together.

    Labels that fill more than ``hot_share`` of a partition's fair share of the rows (few: at most
    ``1 / hot_share`` a partition) are sent to all tasks, so their rows are not shuffled; the others join by label.
    """
    name, missing = F.coalesce(F.col("label").cast("string"), F.lit("")), F.col("label").isNull()
    sums = materialise(coded.groupBy(name.alias("name"), missing.alias("missing")).agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "label-error")
    total = sums.agg(F.sum("rows")).first()[0] or 0
    most = max(64, int(total * s.hot_share / shuffle_partitions(coded.sparkSession)))
    named = coded.withColumns({"name": name, "missing": missing})
    on, hot = ["name", "missing"], F.broadcast(sums.where(F.col("rows") > most).select("name", "missing", "label_error"))
    often = named.join(hot, on)
    seldom = named.join(hot.drop("label_error"), on, "left_anti").join(sums.where(F.col("rows") <= most).select("name", "missing", "label_error"), on)
    return often.unionByName(seldom).drop("name", "missing")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", settings: CodeSettings = CodeSettings()) -> tuple[DataFrame, Books]:
    """``id``, ``label``, ``code``, ``error`` for every finite vector, and the codebooks, which decode the codes.

    ``code``: the entries' indexes, two hex digits each.  Vectors that are null or hold
    null or non-finite components are left out.  A codebook starts from the vectors
    with the smallest ids (null ids come last; fewer vectors, fewer entries) and is
    trained for ``rounds`` rounds over all rows; rows that repeat count each.  Vectors
    of another length have codebooks of their own, lengths that ``parts`` does not
    divide are filled up with zeros, and the empty vector's code is all zeros.  Components
    so large that a squared distance could leave the range of a long (32,768 in 64 dimensions) end the job with an
    error.  An empty table gives no rows and no codebooks.
    """
    s = settings
    numbers = materialise(whole_numbers(vectors, key, vector, label, s), "whole-numbers")
    books = first_books(numbers, s)
    for _ in range(s.rounds):
        books = one_round(numbers, books, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, width, x in _blocks(batches, s.batch):
            codes, error = assign(x, books[width])
            text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(text), pa.array(error)], names=["id", "label", "code", "error"])

    kinds = dict(numbers.dtypes)
    return numbers.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long"), books


def compression_report(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", settings: CodeSettings = CodeSettings()) -> DataFrame:
    """``key``, ``code``, ``error``, ``label_error``, ``codebooks_sha256`` for every finite vector; see :func:`compress`."""
    coded, books = compress(vectors, key, vector, label, settings)
    return with_label_sums(materialise(coded, "vector-codes"), settings).select(F.col("id").alias(key), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def oracle_sql(settings: CodeSettings = CodeSettings()) -> str:
    """The same over ``embeddings`` of one length, every distance in full; each round is a pair of tables."""
    s = settings
    last = s.rounds
    steps = []
    for r in range(last + 1):
        steps.append(
            f"""g{r} AS MATERIALIZED (SELECT x.row, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN b{r} b ON x.p = b.p AND x.j = b.j GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT row, p, e, d FROM g{r} QUALIFY row_number() OVER (PARTITION BY row, p ORDER BY d, e) = 1)"""
        )
        if r < last:
            steps.append(
                f"""m{r} AS (SELECT a.p, a.e, x.j, CAST(sum(x.v) AS BIGINT) AS t, count(*) AS n FROM a{r} a JOIN x ON a.row = x.row AND a.p = x.p GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce((t - ((t % n) + n) % n) // n, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON b.p = m.p AND b.e = m.e AND b.j = m.j)"""
            )
    return f"""WITH k AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda c: CAST(floor({s.scale} * c) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda c: c IS NULL OR NOT isfinite(c)), true)),
i AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, q) AS row, * FROM k),
f AS (SELECT row, unnest(range(len(q))) AS o, unnest(q) AS v, len(q) // {s.parts} AS w FROM i),
x AS MATERIALIZED (SELECT row, o // w AS p, o % w AS j, v FROM f),
b0 AS MATERIALIZED (SELECT p, row - 1 AS e, j, v FROM x WHERE row <= {s.entries}),
{", ".join(steps)},
c AS (SELECT row, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY row),
s AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) AS h FROM b{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM i JOIN c USING (row), s"""
