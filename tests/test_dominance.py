import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import coverage, dominance
from freshet.operators.order import unique_ranks


def cloud(n, d, seed, kind):
    rng = np.random.default_rng(seed)
    x = rng.random((n, d))
    if kind == "tied":
        x = np.where(rng.random((n, d)) < 0.4, 0.0, np.round(x, 1))
    if kind == "along":
        x = np.clip(x[:, :1] + 0.01 * rng.random((n, d)), 0, 1)
    return x


def frame(spark, x):
    axes = [f"a{k}" for k in range(x.shape[1])]
    return axes, spark.createDataFrame([(5 * i, *map(float, r)) for i, r in enumerate(x)], "row_ix long, " + ", ".join(f"{a} double" for a in axes))


def all_pairs(x):
    return sum(np.prod(1 - np.maximum(r, x), axis=1).sum() for r in x)


@pytest.mark.parametrize("n,d,kind,leaf,task", [(300, 3, "even", 3, 16), (300, 3, "tied", 3, 4), (200, 3, "along", 2, 5), (150, 2, "tied", 2, 3), (100, 1, "tied", 6, 16), (90, 4, "even", 4, 16), (40, 3, "even", 6, 16), (1, 3, "even", 6, 16), (2, 2, "tied", 0, 16)])
def test_sum_equals_all_pairs(spark, monkeypatch, n, d, kind, leaf, task):
    monkeypatch.setattr(dominance, "LEAF", leaf)
    monkeypatch.setattr(dominance, "TASK", task)
    x = cloud(n, d, n + d, kind)
    axes, df = frame(spark, x)
    assert math.isclose(dominance.sum_of_pair_products(df, axes, n).first().ss, all_pairs(x), rel_tol=1e-10)


def test_discrepancy_of_many_points(spark):
    x = cloud(3000, 3, 1, "even")
    axes, df = frame(spark, x)
    want = math.sqrt(3.0**-3 - 2.0**-2 / 3000 * np.prod(1 - x * x, axis=1).sum() + all_pairs(x) / 3000**2)
    assert math.isclose(coverage.star_discrepancy(df, axes).first().l2_star, want, rel_tol=1e-9)


def test_both_ways_to_the_discrepancy_and_the_tree_agree(spark, monkeypatch):
    x = cloud(150, 3, 2, "tied")
    axes, df = frame(spark, x)
    few = coverage.star_discrepancy(df, axes).first().l2_star, *coverage.tree_stats(df, axes).values(), coverage.mst_mean_edge(df, axes)
    monkeypatch.setattr(coverage, "FEW", 10)
    monkeypatch.setattr(dominance, "LEAF", 4)
    assert (coverage.star_discrepancy(df, axes).first().l2_star, *coverage.tree_stats(df, axes).values(), coverage.mst_mean_edge(df, axes)) == pytest.approx(few, rel=1e-9)
    assert coverage.mst_mean_edge(df.limit(1), axes) == 0.0 and math.isnan(coverage.tree_stats(df.limit(0), axes)["mst_edge_mean"])


def test_ranks_are_unique_and_ordered(spark):
    rng = random.Random(3)
    rows = [(i, g, rng.choice([0.0, 0.0, 0.5, rng.random()])) for g in "ab" for i in range(2000)]
    got = unique_ranks(spark.createDataFrame(rows, "i long, g string, v double"), ["g"], "v", "i")
    for g in "ab":
        mine = sorted(got.filter(F.col("g") == g).collect(), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(2000)) and [r.v for r in mine] == sorted(r.v for r in mine)
    # a value that many rows share is dealt to several tasks
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__s#" in next(line for line in plan.splitlines() if "row_number()" in line)
