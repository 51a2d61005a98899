"""Order statistics and positions of a whole table, without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise

#: Edges that a round of range counting sets, and values at which counting ends and the rest is sorted.
EDGES = 256
FEW = 4_096


def place_among(x: Column, cuts: list[float]) -> Column:
    """2 k + 1 for a value equal to the k-th of the sorted cuts, 2 k for one before it and after the one before that: a tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(2 * low)
        middle = (low + high) // 2
        return F.when(x < cuts[middle], tree(low, middle)).when(x == cuts[middle], 2 * middle + 1).otherwise(tree(middle + 1, high))

    return tree(0, len(cuts))


def order_statistics(values: DataFrame, column: str, ranks: list[int], edges: int = EDGES, few: int = FEW) -> list[float]:
    """The values at the given places (from 0) of the sorted column, which has no nulls or NaN and is written or cheap to read again.

    A round sets edges at about equal shares of the values still in question, then
    counts exactly how many lie below each edge, and how many on it.  A place that falls
    on an edge has its value; any other lies between two edges, and the next round looks
    at the values between them only.  Each round leaves about one in ``edges``; equal
    values lie on an edge together.  The driver holds the counts, and ``few`` values at the end.
    """
    x = F.col(column)
    found: dict[int, float] = {}
    # Open intervals in question, each with the number of values up to its lower end.
    open_ranks: dict[tuple[float | None, float | None, int], list[int]] = {(None, None, 0): sorted(set(ranks))} if ranks else {}
    while open_ranks:
        following: dict[tuple[float | None, float | None, int], list[int]] = {}
        for (low, high, before), wanted in open_ranks.items():
            inside = F.lit(True)
            if low is not None:
                inside = inside & (x > low)
            if high is not None:
                inside = inside & (x < high)
            rows = values.where(inside)
            head = [r[0] for r in rows.select(x).limit(few + 1).collect()]
            if len(head) <= few:
                head.sort()
                found.update({k: head[k - before] for k in wanted})
                continue
            shares = F.array(*(F.lit((e + 0.5) / edges) for e in range(edges)))
            cuts = sorted(set(rows.agg(F.percentile_approx(x, shares, F.lit(20 * edges))).first()[0]))
            counts = {r["place"]: r["n"] for r in rows.groupBy(place_among(x, cuts).alias("place")).agg(F.count("*").alias("n")).collect()}
            at = before
            for k in range(2 * len(cuts) + 1):
                here = [w for w in wanted if at <= w < at + counts.get(k, 0)]
                if here and k % 2:
                    found.update(dict.fromkeys(here, cuts[k // 2]))
                elif here:
                    following[(cuts[k // 2 - 1] if k else low, cuts[k // 2] if k < 2 * len(cuts) else high, at)] = here
                at += counts.get(k, 0)
        open_ranks = following
    return [found[r] for r in ranks]


def exact_quantiles(values: DataFrame, column: str, shares: list[float], edges: int = EDGES, few: int = FEW) -> list[float | None]:
    """The values at (n - 1) q of the sorted column, interpolated between neighbours: what ``percentile`` gives, from counts.

    Nulls are left out; without values every quantile is None.  ``ValueError`` for a share outside [0, 1].
    NaN counts as the largest value.
    """
    if not all(0.0 <= q <= 1.0 for q in shares):
        raise ValueError("a quantile lies within [0, 1]")
    known = materialise(values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x")), "quantile")
    n, odd = known.agg(F.count("*"), F.count_if(F.isnan("x"))).first()
    if not n:
        return [None] * len(shares)
    places = [((n - 1) * q, int((n - 1) * q)) for q in shares]
    ranks = sorted({min(k + up, n - 1) for _, k in places for up in (0, 1)})
    counted = [r for r in ranks if r < n - odd]
    value = dict.fromkeys(ranks, float("nan")) | dict(zip(counted, order_statistics(known.where(~F.isnan("x")), "x", counted, edges, few), strict=True))
    out = []
    for at, k in places:
        part = at - k
        low, high = value[k], value[min(k + 1, n - 1)]
        out.append(low if part == 0 or low == high else low * (1 - part) + high * part)
    return out


def numbered(rows: DataFrame, order: list[Column | str], name: str, first: int = 0) -> DataFrame:
    """``rows`` with their place in ``order`` (from ``first``) as the long column ``name``.

    Rows are dealt out by ranges of the order and sorted within them; the ranges' counts
    give each its first place.  The sorted rows are written before they are counted,
    so rows that tie, and rows of executors that are lost, keep one place.  Give ``order``
    columns that tell rows apart: rows equal in all of them stay in one range.
    Nulls come first.  Counts are one number a range.
    """
    range_of, place = f"_range_of_{name}", f"_place_of_{name}"
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialise(dealt.withColumns({range_of: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counted = stored.groupBy(range_of).agg(F.count("*").alias("_n"))
    upto = Window.orderBy(range_of).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    starts = counted.select(range_of, (F.coalesce(F.sum("_n").over(upto), F.lit(0)) + first).alias("_first"))
    return stored.join(F.broadcast(starts), range_of).withColumn(name, (F.col("_first") + F.col(place)).cast("long")).drop("_first", range_of, place)
