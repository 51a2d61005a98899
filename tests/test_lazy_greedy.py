"""Lazy selection against the plain one."""

import numpy as np
import pytest

from normscope.functions.vectors import farthest_rows
from normscope.operators.lazy_greedy import LazySettings, Work, lazy_picks
from normscope.operators.selection import farthest_points


def frame(spark, x):
    rows = [(f"s{k // 10:03d}", k % 10, [float(c) for c in v]) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "sample string, cell int, v array<double>").repartition(4)


def picked(spark, x, most, settings, work=None):
    return [int(key[0][1:]) * 10 + key[1] for key, _ in lazy_picks(frame(spark, x), most, ("sample", "cell"), settings, work)]


@pytest.mark.parametrize("settings", [LazySettings(), LazySettings(blocks=4, sample=30, pool=5), LazySettings(blocks=1, sample=1, pool=1)])
def test_picks_equal_the_plain_selection(spark, settings):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, (90, 3)).astype(float)  # many ties and repeated rows
    most = 90 if settings.pool > 1 else 9
    assert picked(spark, x, most, settings) == farthest_rows(x, most)


def test_all_rows_equal_and_more_asked_than_there_are(spark):
    assert picked(spark, np.ones((25, 2)), 40, LazySettings(blocks=3, pool=4)) == list(range(25))
    assert picked(spark, np.zeros((0, 2)), 4, LazySettings()) == []


def test_rows_meet_far_fewer_picks_than_in_a_pass_for_each(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6))[rng.integers(0, 60, 4_000)] * 4 + rng.normal(scale=0.3, size=(4_000, 6))
    work = Work()
    assert picked(spark, x, 64, LazySettings(blocks=32, pool=512), work) == farthest_rows(x, 64)
    assert work.meetings < 0.8 * 64 * len(x) < 64 * 64 / 2 * len(x) and work.visits < 32


def test_a_selection_beyond_one_task_is_lazy(spark):
    x = np.random.default_rng(7).normal(size=(300, 4))
    points = frame(spark, x).withColumnRenamed("v", "descriptor")
    got = farthest_points(points, 20, ("sample", "cell"), one_task_numbers=10, keep_order=True).orderBy("bank_pos").collect()
    assert [int(r["sample"][1:]) * 10 + r["cell"] for r in got] == farthest_rows(x, 20)
    assert np.array_equal([r["descriptor"] for r in got], x[farthest_rows(x, 20)])
