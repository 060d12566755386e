import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from freshet.operators import coverage, normalize
from freshet.operators.order import in_order, ranged


def frame(spark, seed, n=3000):
    rng = random.Random(seed)
    draw = {"even": rng.random, "zero": lambda: max(0.0, rng.random() - 0.4), "few": lambda: rng.randint(0, 3) / 4, "same": lambda: 0.5, "far": lambda: 10.0 ** rng.randint(-9, 9) * rng.random()}
    rows = [(i, *(f() for f in draw.values())) for i in range(n)]
    return list(draw), rows, spark.createDataFrame(rows, "row_ix long, " + ", ".join(f"{a} double" for a in draw))


@pytest.mark.parametrize("ranges", [None, 1, 7, 200])
def test_totals_and_neighbours(spark, ranges):
    axes, rows, df = frame(spark, 1)
    counts = normalize.long_form(df, axes).groupBy("axis", "value").agg(F.count("*").alias("n"), F.sum("row_ix").alias("s"))
    got = {a: [] for a in axes}
    for r in in_order(counts, ["axis"], "value", ["n", "s"], ranges=ranges).collect():
        got[r.axis].append(r)
    for k, a in enumerate(axes, 1):
        vals = sorted({r[k] for r in rows})
        mine = sorted(got[a], key=lambda r: r.value)
        assert [r.value for r in mine] == vals
        n = s = 0
        for i, r in enumerate(mine):
            here = [x for x in rows if x[k] == r.value]
            n, s = n + len(here), s + sum(x[0] for x in here)
            assert (r.n_upto, r.s_upto, r.n_all, r.s_all) == (n, s, len(rows), sum(x[0] for x in rows))
            assert (r.previous, r.next) == (vals[i - 1] if i else None, vals[i + 1] if i + 1 < len(vals) else None)


def test_ranges_are_even_and_rise(spark):
    axes, _, df = frame(spark, 2, 20_000)
    placed = ranged(normalize.long_form(df, ["even", "far"]), ["axis"], "value", 50)
    sizes = placed.groupBy("axis", "__r").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("axis", "__r").collect()
    assert len(sizes) == 100 and max(r.n for r in sizes) < 3 * 20_000 / 50
    for a, b in zip(sizes, sizes[1:], strict=False):
        assert a.axis != b.axis or a.hi < b.lo


def test_no_window_over_a_whole_axis(spark):
    """Ordered windows over rows are within an axis and a range; those over an axis alone read one row a range."""
    axes, _, df = frame(spark, 3)
    for made in (normalize.average_ranks(df, axes), coverage.marginal_gaps(df, axes), coverage.ks_to_uniform(df, axes), coverage.ks_to_pool(df, df.limit(10), axes), coverage.star_by_axis(df, axes)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.splitlines() if " Window [" in x or x.strip().startswith("Window [")]
        assert windows
        for w in windows:
            assert "__r#" in w or "sum(__" in w, w


def test_ranks_ties_nulls_and_one_row(spark):
    axes, rows, df = frame(spark, 4, 500)
    got = {(r.row_ix, r.axis): r.r for r in normalize.average_ranks(df, axes).collect()}
    for k, a in enumerate(axes, 1):
        vals = sorted(r[k] for r in rows)
        for r in rows:
            assert got[r[0], a] == (bisect.bisect_left(vals, r[k]) + 1 + bisect.bisect_right(vals, r[k])) / 2
    odd = spark.createDataFrame([(0, None), (1, 2.0), (2, -0.0), (3, 0.0)], "row_ix long, v double")
    assert sorted((r.row_ix, r.r) for r in normalize.average_ranks(odd, ["v"]).collect()) == [(1, 3.0), (2, 1.5), (3, 1.5)]
    assert normalize.average_ranks(odd.limit(0), ["v"]).count() == 0
    assert [r.r for r in normalize.average_ranks(odd.filter("row_ix = 1"), ["v"]).collect()] == [1.0]


def test_star_of_one_axis_equals_all_pairs(spark):
    axes, rows, df = frame(spark, 5, 200)
    got = {r.axis: r.star_1d for r in coverage.star_by_axis(df.select("row_ix", "even", "few", "same"), ["even", "few", "same"]).collect()}
    for k, a in enumerate(axes, 1):
        if a in got:
            v = [r[k] for r in rows]
            n = len(v)
            want = 1 / 3 - sum(1 - x * x for x in v) / n + sum(1 - max(x, y) for x in v for y in v) / n**2
            assert math.isclose(got[a] ** 2, want, rel_tol=1e-9)
