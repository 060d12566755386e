"""How evenly a selection covers the unit box.

Nearest neighbours and the spanning tree come from a grid of cells, the discrepancy from divide and conquer. The kernel sum joins a *selection* with itself: up to ``MAX_SELECTION`` rows are broadcast; more are joined block by block
(Spark's Cartesian product), each task adding up its pairs. Pool statistics are grouped by axis.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dominance
from .dominance import product
from .neighbours import nearest_distances, spanning_tree, squared_distance
from .normalize import long_form, value_counts
from .quantiles import exact_percentiles

MAX_SELECTION = 20_000
#: Points up to which pairs are formed at once for the discrepancy, and a selection's tree is made on the driver (some 50 KB) for its edge statistics.
FEW = 2000


def _beside(points: DataFrame, other: DataFrame, n: int) -> DataFrame:
    """Every row of ``points`` (``n`` rows) with every row of ``other``."""
    if n <= MAX_SELECTION:
        return points.crossJoin(F.broadcast(other))  # at most MAX_SELECTION rows
    return points.crossJoin(other.hint("shuffle_replicate_nl"))


def star_discrepancy(points: DataFrame, axes: Sequence[str]) -> DataFrame:
    """One row ``l2_star``: the closed form of the L2 star discrepancy of points in the unit box.

    The sum over pairs is by divide and conquer where that lists fewer rows than there are pairs; with many axes or ``FEW`` points pairs cost less.
    """
    n, d = points.count(), len(axes)
    p = points.select("row_ix", *(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(a))).alias(a) for a in axes))
    single = p.agg(F.sum(product([1 - F.col(a) * F.col(a) for a in axes])).alias("s"))
    if n > FEW and dominance.rows_needed(n, d) < n * n:
        double = dominance.sum_of_pair_products(p, axes, n)
    else:
        q = p.select(*(F.col(a).alias(f"__{a}") for a in axes))
        double = _beside(p, q, n).agg(F.sum(product([1 - F.greatest(F.col(a), F.col(f"__{a}")) for a in axes])).alias("ss"))
    return single.crossJoin(double).select(F.sqrt(F.lit(3.0**-d) - F.lit(2.0 ** (1 - d)) / n * F.col("s") + F.col("ss") / (n * n)).alias("l2_star"))  # one row each


def _pairs(points: DataFrame, axes: Sequence[str]) -> DataFrame:
    other = points.select(F.col("row_ix").alias("__ix"), *(F.col(a).alias(f"__{a}") for a in axes))
    return _beside(points.select("row_ix", *axes), other, points.count()).withColumn("d2", squared_distance(axes, [f"__{a}" for a in axes]))


def nearest_summary(points: DataFrame, axes: Sequence[str]) -> DataFrame:
    """One row nn_mean, nn_std (population), nn_min, nn_max, nn_cv."""
    return nearest_distances(points, axes).agg(F.avg("nn").alias("nn_mean"), F.stddev_pop("nn").alias("nn_std"), F.min("nn").alias("nn_min"), F.max("nn").alias("nn_max"), (F.stddev_pop("nn") / F.avg("nn")).alias("nn_cv"))


def effective_sample_size(points: DataFrame, axes: Sequence[str], spacing: float | None = None, factor: float = 0.33) -> DataFrame:
    """One row ess, ess_fraction, participation_ratio, bandwidth of the Gaussian kernel.

    The kernel matrix has trace N, so the participation ratio of its eigenvalues is N**2 over the sum of its squared entries.
    """
    n = points.count()
    h = spacing if spacing is not None else factor * n ** (-1 / len(axes))
    k = F.exp(-F.col("d2") / (2 * h * h))
    return _pairs(points, axes).agg(F.sum(k).alias("k"), F.sum(k * k).alias("kk")).select((n * n / F.col("k")).alias("ess"), (n / F.col("k")).alias("ess_fraction"), (n * n / F.col("kk")).alias("participation_ratio"), F.lit(h).alias("bandwidth"))


def tree_lengths(points: DataFrame, axes: Sequence[str]) -> tuple[int, float, float, float]:
    """(number, mean, least, population deviation) of the lengths of the spanning tree's edges; zeros without edges."""
    few = points.select(*axes).na.drop().distinct().limit(FEW + 1).collect()
    if len(few) > FEW:
        e = spanning_tree(points, axes).agg(F.count("*").alias("n"), F.avg("length").alias("m"), F.min("length").alias("least"), F.stddev_pop("length").alias("sd")).first()
        return e.n, e.m, e.least, e.sd
    at = np.array(few, float).reshape(len(few), len(axes))
    if len(at) < 2:
        return 0, 0.0, 0.0, 0.0
    out, near, got = np.ones(len(at), bool), np.full(len(at), np.inf), []
    k = 0
    for _ in range(len(at) - 1):  # the nearest point outside joins the tree
        out[k] = False
        near = np.minimum(near, ((at - at[k]) ** 2).sum(axis=1))
        k = int(np.where(out, near, np.inf).argmin())
        got.append(near[k])
    e = np.sqrt(got)
    return len(e), float(e.mean()), float(e.min()), float(e.std())


def tree_stats(points: DataFrame, axes: Sequence[str]) -> dict[str, float]:
    """Mean, least and relative deviation of the spanning tree's edges; NaN without edges."""
    n, mean, least, sd = tree_lengths(points, axes)
    return {"mst_edge_mean": mean, "mst_edge_min": least, "mst_edge_cv": sd / mean} if n else dict.fromkeys(("mst_edge_mean", "mst_edge_min", "mst_edge_cv"), float("nan"))


def mst_mean_edge(points: DataFrame, axes: Sequence[str]) -> float:
    """Mean length of the spanning tree's edges, 0 without edges."""
    return tree_lengths(points, axes)[1]


def marginal_gaps(points: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(axis, max_gap): the widest step between neighbouring values, the box faces included."""
    step = F.greatest(F.col("value") - F.coalesce("previous", F.lit(0.0)), F.when(F.col("next").isNull(), 1.0 - F.col("value")).otherwise(F.lit(0.0)))
    return value_counts(long_form(points, axes)).groupBy("axis").agg(F.max(step).alias("max_gap"))


def ks_to_pool(pool: DataFrame, selected: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(axis, ks): largest distance of the two empirical distribution functions; ``selected`` holds rows of ``pool``."""
    long = long_form(pool.join(selected.select("row_ix").distinct().withColumn("__s", F.lit(1)), "row_ix", "left").withColumn("row_ix", F.coalesce("__s", F.lit(0))), axes)
    gap = F.abs(F.col("n_upto") / F.col("n_all") - F.col("s_upto") / F.col("s_all"))
    return value_counts(long, F.sum("row_ix").alias("s")).groupBy("axis").agg(F.max(gap).alias("ks"))


def ks_to_uniform(points: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(axis, ks_to_uniform) of points in the unit box; of equal values the last decides above the diagonal, the first below."""
    gap = F.greatest(F.col("n_upto") / F.col("n_all") - F.col("value"), F.col("value") - (F.col("n_upto") - F.col("n")) / F.col("n_all"))
    return value_counts(long_form(points, axes)).groupBy("axis").agg(F.max(gap).alias("ks_to_uniform"))


def star_by_axis(points: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(axis, star_1d): the discrepancy of each axis alone. The sum of pairwise maxima is each sorted value times 2 i - 1; over n equal values up to rank i those add up to i**2 - (i - n)**2."""
    share = (F.col("n_upto") * F.col("n_upto") - (F.col("n_upto") - F.col("n")) * (F.col("n_upto") - F.col("n"))).cast("double")
    n = F.max("n_all")
    star = F.lit(1 / 3) - F.sum(F.col("n") * (1 - F.col("value") * F.col("value"))) / n + F.sum((1 - F.col("value")) * share) / (n.cast("double") * n)
    return value_counts(long_form(points, axes)).groupBy("axis").agg(F.sqrt(star).alias("star_1d"))


def tail_shares(pool: DataFrame, selected: DataFrame, axes: Sequence[str], q: float = 90.0) -> DataFrame:
    """(axis, tail_share): share of the selected rows strictly above the pool's percentile."""
    cut = exact_percentiles(long_form(pool, axes), "axis", "value", (q / 100,)).select("axis", F.col("q")[0].alias("cut"))
    mine = long_form(pool.join(selected, "row_ix", "left_semi"), axes).join(F.broadcast(cut), "axis")  # one row per axis
    return mine.groupBy("axis").agg(F.avg((F.col("value") > F.col("cut")).cast("double")).alias("tail_share"))


def histogram(pool: DataFrame, selected: DataFrame, axes: Sequence[str], bins: int = 20) -> DataFrame:
    """(axis, bin, lo, n, selected): rows of the pool and of the selection in even bins between each axis's least and largest value; empty bins are left out."""
    marked = pool.join(selected.select("row_ix").distinct().withColumn("__s", F.lit(1)), "row_ix", "left").withColumn("row_ix", F.coalesce("__s", F.lit(0)))
    long = long_form(marked, axes)
    span = long.groupBy("axis").agg(F.min("value").alias("least"), ((F.max("value") - F.min("value")) / bins).alias("width"))
    at = F.when(F.col("width") > 0, F.least(F.floor((F.col("value") - F.col("least")) / F.col("width")), F.lit(bins - 1))).otherwise(F.lit(0))
    binned = long.join(F.broadcast(span), "axis").withColumn("bin", at.cast("int"))  # one row per axis
    return binned.groupBy("axis", "bin", (F.col("least") + F.col("bin") * F.col("width")).alias("lo")).agg(F.count("*").alias("n"), F.sum("row_ix").alias("selected"))


def corner_share(pool: DataFrame, selected: DataFrame, axes: Sequence[str], q: float = 90.0) -> DataFrame:
    """One row ``corner_share``: share of the selected rows above the percentile on any axis."""
    cut = exact_percentiles(long_form(pool, axes), "axis", "value", (q / 100,)).select("axis", F.col("q")[0].alias("cut"))
    mine = long_form(pool.join(selected, "row_ix", "left_semi"), axes).join(F.broadcast(cut), "axis")
    return mine.groupBy("row_ix").agg(F.max((F.col("value") > F.col("cut")).cast("double")).alias("any")).agg(F.avg("any").alias("corner_share"))


def null_discrepancies(points: DataFrame, axes: Sequence[str], draws: DataFrame, n: int) -> DataFrame:
    """(draw, l2_star) of every random subset in ``draws`` (draw, row_ix), each of size ``n``; pairs are formed within a draw only."""
    return _by_draw(draws.join(points.select("row_ix", *axes), "row_ix"), axes, n)


def _by_draw(mine: DataFrame, axes: Sequence[str], n: int) -> DataFrame:
    d = len(axes)
    single = mine.groupBy("draw").agg(F.sum(product([1 - F.col(a) * F.col(a) for a in axes])).alias("s"))
    other = mine.select("draw", *(F.col(a).alias(f"__{a}") for a in axes))
    double = mine.join(other, "draw").groupBy("draw").agg(F.sum(product([1 - F.greatest(F.col(a), F.col(f"__{a}")) for a in axes])).alias("ss"))
    return single.join(double, "draw").select("draw", F.sqrt(F.lit(3.0**-d) - F.lit(2.0 ** (1 - d)) / n * F.col("s") + F.col("ss") / (n * n)).alias("l2_star"))


def uniform_points(spark: SparkSession, draws: int, n: int, d: int, seed: int) -> DataFrame:
    """(draw, point, u0 ...): ``n`` points of the unit box for each draw, whose k-th axis is the leading 52 bits of the MD5 of ``seed,draw,point,k``.

    A number depends on its place only, so executors make them as they go, alike for any partitioning, and none is stored or sent.
    """
    bits = lambda k: F.conv(F.substring(F.md5(F.concat_ws(",", F.lit(seed), "draw", "point", F.lit(k)).cast("binary")), 1, 13), 16, 10).cast("double")
    at = spark.range(draws * n).select(F.floor(F.col("id") / n).alias("draw"), (F.col("id") % n).alias("point"))
    return at.select("draw", "point", *((bits(k) / float(1 << 52)).alias(f"u{k}") for k in range(d)))


def uniform_discrepancies(spark: SparkSession, draws: int, n: int, d: int, seed: int = 0) -> DataFrame:
    """(draw, l2_star) of ``draws`` sets of ``n`` uniform points in ``d`` axes: what a selection of that size would show if it were drawn at random from the box."""
    return _by_draw(uniform_points(spark, draws, n, d, seed), [f"u{k}" for k in range(d)], n)


def expected_discrepancy(spark: SparkSession, n: int, d: int, draws: int, seed: int = 0) -> dict[str, float]:
    """Mean and population deviation of ``uniform_discrepancies``."""
    r = uniform_discrepancies(spark, draws, n, d, seed).agg(F.avg("l2_star").alias("m"), F.stddev_pop("l2_star").alias("s")).first()
    return {"random_l2_mean": r.m, "random_l2_std": r.s}


def pair_grid(pool: DataFrame, selected: DataFrame, axes: Sequence[str], bins: int = 20) -> DataFrame:
    """(a, b, bin_a, bin_b, n, selected): two-axis counts of the pool and of the selection for every pair of axes in order, each axis in even bins between its least and largest value.

    A row is listed once for each pair with its two bins as one code; counts are added before the one shuffle, in which there is at most a row a task and cell. Empty cells are left out; a row without one of the two
    values is in no cell of that pair.
    """
    marked = pool.join(selected.select("row_ix").distinct().withColumn("__s", F.lit(1)), "row_ix", "left").select(*axes, F.coalesce("__s", F.lit(0)).alias("__s"))
    ends = pool.agg(*(f(a).alias(f"__{k}{n}") for k, a in enumerate(axes) for n, f in (("lo", F.min), ("hi", F.max))))
    wide = marked.crossJoin(F.broadcast(ends))  # one row

    def bin_of(k: int) -> Column:
        lo, width = F.col(f"__{k}lo"), (F.col(f"__{k}hi") - F.col(f"__{k}lo")) / bins
        at = F.when(width > 0, F.least(F.floor((F.col(axes[k]) - lo) / width), F.lit(bins - 1))).otherwise(F.lit(0))
        return F.when(F.col(axes[k]).isNotNull(), at).cast("int")

    binned = wide.select("__s", *(bin_of(k).alias(f"__b{k}") for k in range(len(axes))))
    pairs = [(i, j) for i in range(len(axes)) for j in range(i + 1, len(axes))]
    if not pairs:
        return pool.sparkSession.createDataFrame([], "a string, b string, bin_a int, bin_b int, n long, selected long")
    codes = F.array(*((F.lit(k * bins * bins) + F.col(f"__b{i}") * bins + F.col(f"__b{j}")).alias("c") for k, (i, j) in enumerate(pairs)))
    counts = binned.select("__s", F.explode(codes).alias("c")).filter("c is not null").groupBy("c").agg(F.count("*").alias("n"), F.sum("__s").alias("selected"))
    pair, cell = F.floor(F.col("c") / (bins * bins)).cast("int"), F.col("c") % (bins * bins)
    name = lambda side: F.array(*(F.lit(axes[p[side]]) for p in pairs))[pair]
    return counts.select(name(0).alias("a"), name(1).alias("b"), F.floor(cell / bins).cast("int").alias("bin_a"), (cell % bins).cast("int").alias("bin_b"), "n", "selected")
