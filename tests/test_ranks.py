"""Quantiles and positions against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from normscope.operators.ranks import exact_quantiles, numbered

SHARES = [0.0, 0.05, 0.25, 1 / 3, 0.5, 0.95, 0.999, 1.0]


def column(spark, x):
    return spark.createDataFrame([(None if v is None else float(v), k) for k, v in enumerate(x)], "x double, n int").repartition(5)


@pytest.mark.parametrize("few, edges", [(4_096, 256), (10, 4), (1, 2)])
def test_quantiles_equal_percentile(spark, few, edges):
    rng = np.random.default_rng(few)
    x = [*rng.normal(size=300).tolist(), *([0.25] * 200), *([-3.0] * 40), -0.0, 0.0, 1e300, -1e300, 5e-324, None, None]
    frame = column(spark, x)
    want = [frame.agg(F.percentile("x", F.lit(q))).first()[0] for q in SHARES]
    got = exact_quantiles(frame, "x", SHARES, edges, few)
    assert np.allclose(got, want, rtol=1e-12, atol=0)
    assert np.allclose(got, np.quantile([v for v in x if v is not None], SHARES), rtol=1e-9)


def test_quantiles_of_one_none_equal_and_integer_values(spark):
    assert exact_quantiles(column(spark, [7.5]), "x", [0.0, 0.4, 1.0]) == [7.5] * 3
    assert exact_quantiles(column(spark, [None]), "x", [0.5]) == [None]
    assert exact_quantiles(column(spark, []), "x", [0.5, 1.0]) == [None, None]
    assert exact_quantiles(column(spark, [2.0] * 50), "x", [0.0, 0.5, 1.0], 4, 3) == [2.0] * 3
    assert exact_quantiles(column(spark, [3, 1, 2]), "n", [0.5, 0.75]) == [1.0, 1.5]
    assert np.array_equal(exact_quantiles(column(spark, [1.0, float("nan"), 0.0]), "x", [0.0, 0.5, 1.0]), [0.0, 1.0, np.nan], equal_nan=True)
    with pytest.raises(ValueError):
        exact_quantiles(column(spark, [1.0]), "x", [1.1])


def test_numbers_are_the_places_in_the_order(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 40, 500).tolist() + [None] * 3
    got = numbered(column(spark, x), ["x", F.desc("n")], "seq", 10).collect()
    assert set(got[0].asDict()) == {"x", "n", "seq"} and sorted(r["seq"] for r in got) == list(range(10, 513))
    want = sorted(range(503), key=lambda k: (x[k] is not None, x[k] or 0, -k))
    assert [r["n"] for r in sorted(got, key=lambda r: r["seq"])] == want
    assert numbered(column(spark, []), ["x"], "seq").count() == 0
    ties = numbered(column(spark, [1.0] * 60), ["x"], "seq").collect()
    assert sorted(r["seq"] for r in ties) == list(range(60))
