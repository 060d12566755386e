"""Sums over all pairs of products of maxima, by divide and conquer.

For points x, y of a set the product of (1 - max(x_a, y_a)) over the axes a is wanted, summed over all pairs. In the binary tree of ranks of an axis two points part at one
node: one goes left, the other right, and the right one has the maximum. So each point is listed at every node above it, with a factor 1 - x_a where it goes right; pairs on opposite
sides of a node of every axis but the last are left with a sum over one axis, which running totals in its order give. Pairs that share the smallest nodes, of ``LEAF`` ranks, are formed.
With n points and d axes there are n log(n)**(d - 1) rows instead of n**2 pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.scratch import stored
from .order import unique_ranks

#: log2 of the ranks of a smallest node, and of the most rows that are put in order in one task.
LEAF, TASK = 6, 16


def product(cols: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x * y, cols)


def _ranked(points: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(row_ix, x0.., r0..): the axes within the unit box and their ranks."""
    long = points.select("row_ix", *axes).unpivot(["row_ix"], list(axes), "axis", "value").withColumn("value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value"))))
    pick = lambda a, c: F.max(F.when(F.col("axis") == a, F.col(c)))
    return unique_ranks(long, ["axis"], "value", "row_ix").groupBy("row_ix").agg(*(pick(a, c).alias(f"{c[0]}{k}") for k, a in enumerate(axes) for c in ("value", "rank"))).withColumnsRenamed({f"v{k}": f"x{k}" for k in range(len(axes))})


def rows_needed(n: int, d: int) -> int:
    """Rows that the last axis puts in order."""
    return n * max(0, max(1, n - 1).bit_length() - LEAF) ** (d - 1)


def sum_of_pair_products(points: DataFrame, axes: Sequence[str], n: int) -> DataFrame:
    """One row ``ss``: the sum over all ordered pairs of the ``n`` points (each with itself too) of the products of 1 - the larger coordinate in the unit box.

    Points are told apart by ``row_ix``; equal coordinates are allowed.
    """
    d = len(axes)
    height = max(1, n - 1).bit_length()
    whole = stored(_ranked(points, axes), "ranks")  # read by every sum
    x = [F.col(f"x{k}") for k in range(d)]
    sums = [whole.agg(F.sum(product([1 - c for c in x])).alias("s"))]
    at, keys = whole.withColumn("w", F.lit(1.0)), []
    for k in range(d - 1):
        # pairs that share a smallest node of this axis
        mine = at.withColumn("leaf", F.shiftright(f"r{k}", LEAF))
        other = mine.select(*keys, "leaf", *(F.col(c).alias(f"__{c}") for c in ("side", "r0", *(f"x{i}" for i in range(d))) if c in mine.columns))
        apart = "side = 0 and __side = 1" if keys else "r0 < __r0"
        pairs = mine.join(other, [*keys, "leaf"]).filter(apart)
        sums.append(pairs.agg(F.sum(2 * product([1 - F.greatest(c, F.col(f"__x{i}")) for i, c in enumerate(x)])).alias("s")))
        if height <= LEAF:
            break
        # a row for each node above the smallest ones
        node, right = F.expr(f"shiftright(r{k}, {height} - l{k})"), F.expr(f"shiftright(r{k}, {height - 1} - l{k}) & 1").cast("int")
        at = at.withColumn(f"l{k}", F.explode(F.sequence(F.lit(0), F.lit(height - LEAF - 1)))).withColumn(f"v{k}", node).withColumn("right", right)
        at = at.withColumn("w", F.col("w") * F.when(F.col("right") == 1, 1 - F.col(f"x{k}")).otherwise(1.0))
        if keys:
            at = at.withColumn(f"t{k}", F.col("right").bitwiseXOR(F.col("side"))).drop("right")
            keys += [f"l{k}", f"v{k}", f"t{k}"]
        else:
            at = at.withColumnRenamed("right", "side")
            keys += ["l0", "v0"]
    else:
        sums.append(_along_last(at, keys, d, height))
    return reduce(lambda a, b: a.unionByName(b), sums).agg(F.sum("s").alias("ss"))


def _along_last(at: DataFrame, keys: list[str], d: int, height: int) -> DataFrame:
    """One row ``s``: twice the sum over pairs on opposite sides of the weights times 1 - the larger last coordinate."""
    last, end = f"r{d - 1}", 1 - F.col(f"x{d - 1}")
    if d == 1:
        # all pairs of one axis: each point is the larger one of as many pairs as its rank
        return at.agg(F.sum(2 * end * F.col(last)).alias("s"))
    deepest = F.greatest(*(F.col(f"l{k}") for k in range(d - 1))) if d > 2 else F.col("l0")
    # a node holds at most 2 ** (height - depth) points; larger groups are put in order in parts of that many ranks
    part = F.when(deepest >= height - TASK, F.lit(0)).otherwise(F.shiftright(last, TASK)).cast("int")
    rows = at.select(*keys, part.alias("part"), "side", last, end.alias("end"), F.when(F.col("side") == 0, F.col("w")).otherwise(0.0).alias("a"), F.when(F.col("side") == 1, F.col("w")).otherwise(0.0).alias("b"))
    before = Window.partitionBy(*keys, "part").orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    inside = rows.withColumns({"__a": upto("a"), "__b": upto("b")}).agg(F.sum(2 * F.col("end") * (F.col("a") * F.col("__b") + F.col("b") * F.col("__a"))).alias("s"))
    if height <= TASK:
        return inside
    totals = rows.filter(deepest_is_split(keys, d, height)).groupBy(*keys, "part").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("end") * F.col("a")).alias("ea"), F.sum(F.col("end") * F.col("b")).alias("eb"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0.0))
    across = totals.withColumns({"__a": over("a"), "__b": over("b")}).agg(F.sum(2 * (F.col("ea") * F.col("__b") + F.col("eb") * F.col("__a"))).alias("s"))
    return inside.unionByName(across).agg(F.sum("s").alias("s"))


def deepest_is_split(keys: Sequence[str], d: int, height: int) -> Column:
    levels = [F.col(f"l{k}") for k in range(d - 1)]
    return (F.greatest(*levels) if len(levels) > 1 else levels[0]) < height - TASK
