import hashlib
import math
import random

import numpy as np
import pytest

from freshet.operators import coverage, select


def frame(spark, x):
    axes = [f"a{k}" for k in range(x.shape[1])]
    return axes, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_ix long, " + ", ".join(f"{a} double" for a in axes)).persist()


def cell_set(x, g):
    return sorted({tuple(c) for c in np.minimum(np.floor(x * g).astype(int), g - 1).tolist()})


@pytest.mark.parametrize("d,n", [(3, 200), (8, 60), (1, 40)])
def test_occupancies_and_numbers(spark, d, n):
    rng = np.random.default_rng(d)
    x = np.clip(1.3 * rng.random((n, d)) - 0.1, 0, 1)
    x[n // 2 :, : d - 1] = x[0, : d - 1]  # many rows that share all but the last coordinate
    axes, df = frame(spark, x)
    assert select.doubled_occupancy(df, axes) == {1 << k: len(cell_set(x, 1 << k)) for k in range(13)}
    assert select.occupancies(df, axes, [1, 3, 7]) == {g: len(cell_set(x, g)) for g in (1, 3, 7)}
    for g in (2, 37):
        keys = cell_set(x, g)
        got = sorted((r.k, r.row_ix) for r in select.cell_members(df, axes, g).collect())
        assert [k for k, _ in got] == list(range(len(keys)))
        for k, row in got:
            mine = [i for i in range(n) if tuple(np.minimum(np.floor(x[i] * g).astype(int), g - 1)) == keys[k]]
            assert row == min(mine, key=lambda i: (((x[i] - (np.array(keys[k]) + 0.5) / g) ** 2).sum(), i))


def test_grid_follows_the_order_of_probes(spark):
    rng = random.Random(2)
    for _ in range(4):
        n = rng.randint(8, 14)
        x = np.array([[rng.random()] for _ in range(n)])
        axes, df = frame(spark, x)
        for need in (3, n // 2, n - 2):
            occ = lambda g: len(cell_set(x, g))  # noqa: B023, E731
            lo, hi = 1, 2
            while occ(hi) < need:
                hi *= 2
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if occ(mid) >= need else (mid + 1, hi)
            assert select.grid_for(df, axes, need) == hi


def slow_maximin(x, n):
    d = ((x - x.mean(axis=0)) ** 2).sum(axis=1)
    chosen = [int(d.argmax())]
    near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < n:
        near[chosen] = -1
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return sorted(chosen)


def test_farthest_first_reads_the_pool_a_few_times(spark):
    rng = np.random.default_rng(4)
    x = rng.random((2000, 3))
    axes, df = frame(spark, x)
    got = select.maximin(df, axes, 100, top=200)
    assert got.rows == slow_maximin(x, 100) and got.info["passes"] < 30
    assert select.maximin(df, axes, 100).rows == got.rows
    tied = np.round(rng.random((60, 2)) * 4) / 4
    axes, df = frame(spark, tied)
    for n, top in ((20, 1), (20, 5), (60, 7), (60, 1000)):
        assert select.maximin(df, axes, n, top=top).rows == slow_maximin(tied, n)


def test_farthest_first_plans_do_not_grow(spark, monkeypatch):
    """However many passes a shuffled pool takes, no plan holds those before it; copies of a point take no pass of their own."""
    rng = np.random.default_rng(7)
    x = np.tile(rng.random((40, 3)), (30, 1))
    axes, df = frame(spark, x)
    pool = df.join(df.groupBy("row_ix").count(), "row_ix").select("row_ix", *axes).persist()
    sizes, plain = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: (sizes.append(len(self._jdf.queryExecution().toString())), plain(self))[1])
    got = select.maximin(pool, axes, 70, top=4)
    assert got.rows == slow_maximin(x, 70) and 10 < got.info["passes"] < 42
    assert max(sizes) < 40_000
    assert select.maximin(pool, axes, 70, top=100).info["passes"] == 3


def test_uniform_points_depend_on_their_place_only(spark):
    got = {(r.draw, r.point): (r.u0, r.u1) for r in coverage.uniform_points(spark, 3, 50, 2, 9).repartition(7).collect()}
    u = lambda *at: int(hashlib.md5(",".join(map(str, at)).encode()).hexdigest()[:13], 16) / 2**52
    assert got == {(t, i): (u(9, t, i, 0), u(9, t, i, 1)) for t in range(3) for i in range(50)}
    values = sorted(v for p in coverage.uniform_points(spark, 1, 4000, 1, 1).collect() for v in (p.u0,))
    assert max(max((i + 1) / 4000 - v, v - i / 4000) for i, v in enumerate(values)) < 1.63 / math.sqrt(4000)
    # the mean of the squared discrepancy of n uniform points is (2**-d - 3**-d) / n
    sets = coverage.uniform_discrepancies(spark, 200, 10, 3, 2).collect()
    assert sum(r.l2_star**2 for r in sets) / 200 == pytest.approx((2.0**-3 - 3.0**-3) / 10, rel=0.1)
    assert coverage.expected_discrepancy(spark, 10, 3, 200, 2)["random_l2_mean"] == pytest.approx(sum(r.l2_star for r in sets) / 200)


def test_pair_grid_of_odd_columns(spark):
    rows = [(0, 0.0, 1.0, 5.0), (1, 1.0, 1.0, None), (2, 0.5, 1.0, 7.0), (3, 1.0, 1.0, 7.0)]
    df = spark.createDataFrame(rows, "row_ix long, a double, b double, c double")
    got = sorted(map(tuple, coverage.pair_grid(df, df.filter("row_ix in (2, 3)"), ["a", "b", "c"], 2).collect()))
    assert got == [("a", "b", 0, 0, 1, 0), ("a", "b", 1, 0, 3, 2), ("a", "c", 0, 0, 1, 0), ("a", "c", 1, 1, 2, 2), ("b", "c", 0, 0, 1, 0), ("b", "c", 0, 1, 2, 2)]
    assert coverage.pair_grid(df, df, ["a"]).count() == 0 and coverage.pair_grid(df.limit(0), df, ["a", "b"]).count() == 0
