"""Distances to large banks, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from normscope.operators.neighbours import nearest_distance
from normscope.operators.pivots import Blocks, PivotSettings, build_blocks, distances, nearest_by_pivots

KIND = "block long, part string, descriptor array<float>, asks boolean, v int"


def clustered(n, dims=12, centres=40, seed=0, spread=0.05):
    middle = np.random.default_rng(99).normal(size=(centres, dims))
    rng = np.random.default_rng(seed)
    return (middle[rng.integers(0, centres, n)] + rng.normal(scale=spread, size=(n, dims))).astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(k, f"p{k}", None if v is None else [float(c) for c in v], True, 1) for k, v in enumerate(x)], KIND)


def bank_of(spark, x):
    return frame(spark, x).select(F.col("descriptor").cast("array<double>").alias("b"))


def brute(q, b):
    return np.sqrt(((q[:, None].astype(float) - b[None].astype(float)) ** 2).sum(axis=2)).min(axis=1)


@pytest.mark.parametrize("settings", [PivotSettings(), PivotSettings(pivots=5, rings=1, sample=50, part_numbers=600, step=7), PivotSettings(pivots=1, rings=3)])
def test_distances_equal_brute_force(spark, settings):
    q, b = clustered(400, seed=1), clustered(700, seed=2)
    q[:60], b[:200] = q[0], b[0]  # a hot query and a hot bank row
    q[70] = b[5]
    q[90:100] = np.random.default_rng(5).normal(scale=9, size=(10, 12))
    got = nearest_by_pivots(frame(spark, [*q, None, None]), bank_of(spark, b).repartition(5), "descriptor", "d", settings).collect()
    assert len(got) == 402 and set(got[0].asDict()) == {"block", "part", "asks", "v", "d"}
    found = {r["block"]: r["d"] for r in got}
    assert found[400] is None and found[401] is None and found[70] == 0.0
    assert np.allclose([found[k] for k in range(400)], brute(q, b), rtol=1e-12, atol=0)
    assert all(r["part"] == f"p{r['block']}" and r["asks"] and r["v"] == 1 for r in got)


def test_few_pairs_are_compared_on_clustered_data(spark):
    q, b = clustered(1_500, seed=3), clustered(6_000, seed=4)
    compared = spark.sparkContext.accumulator(0)
    got = nearest_by_pivots(frame(spark, q), bank_of(spark, b), "descriptor", "d", compared=compared).collect()
    found = {r["block"]: r["d"] for r in got}
    assert np.allclose([found[k] for k in range(len(q))], brute(q, b), rtol=1e-12, atol=0)
    assert compared.value < 0.1 * len(q) * len(b)


def test_a_large_bank_takes_this_way_and_empty_queries_give_nothing(spark):
    q, b = clustered(40, seed=6), clustered(90, seed=7)
    got = {r["block"]: r["d"] for r in nearest_distance(frame(spark, [*q, None]), frame(spark, b).select("descriptor"), broadcast_rows=10).collect()}
    assert np.allclose([got[k] for k in range(40)], brute(q, b), rtol=1e-12, atol=0) and got[40] is None
    assert nearest_distance(frame(spark, []), frame(spark, b).select("descriptor"), broadcast_rows=10).count() == 0
    assert [r["d"] for r in nearest_distance(frame(spark, [None]), frame(spark, b).select("descriptor"), broadcast_rows=10).collect()] == [None]


def test_bounds_hold_for_every_row_of_a_block(spark):
    b = clustered(900, seed=8, spread=0.4).astype(float)
    placed, blocks = build_blocks(bank_of(spark, b), PivotSettings(pivots=12, rings=4, sample=200))
    rows = placed.collect()
    q = np.random.default_rng(9).normal(size=(50, 12))
    bound = blocks.bounds(distances(q, blocks.pivots))
    place = {int(k): n for n, k in enumerate(blocks.ids)}
    true = distances(q, np.array([r["b"] for r in rows]))
    held = np.array([place[r["block"]] for r in rows])
    assert len(rows) == 900 and len(blocks.ids) > 12 and isinstance(blocks, Blocks)
    assert (bound[:, held] <= true).all() and (bound > 0).mean() > 0.3
