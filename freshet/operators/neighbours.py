"""Nearest neighbours and the spanning tree of points, without forming all pairs.

Points lie in a grid of cells whose side halves from level to level. In the order of interleaved cell numbers the rows beside a point are points nearby, so
the nearer one bounds how far its nearest neighbour can be. The ball of that radius touches at most two cells an axis at the level whose side is twice the radius;
only points in those cells are compared, so the result is exact. Points far from others are few wherever many points lie, so few of them meet a dense cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .order import in_order

#: Axes of the grid, the widest ones (more axes count in distances only); finest level; levels in the first number by which points are put in order (those below it follow in a second one).
GRIDDED, FINEST, FIRST = 3, 40, 20
#: A second order of the points, with the grid moved by this share of a side, finds those beside them across the borders of the first.
MOVED = 1 / 3


def squared_distance(a: Sequence[str], b: Sequence[str]) -> Column:
    return reduce(lambda x, y: x + y, [(F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a, b, strict=True)])


def interleaved(cols: Sequence[str]) -> str:
    """SQL for the bits of the cell numbers ``cols`` taken in turn, highest first: the halves, quarters and so on of each number move apart (``aggregate`` names a step, so that it is not written out twice)."""
    d, out = len(cols), []
    for k, x in enumerate(cols):
        for half in (16, 8, 4, 2, 1) if d > 1 else ():
            mask = sum(((1 << half) - 1) << at for at in range(0, 63, half * d)) & ((1 << 63) - 1)
            x = f"(({x} | shiftleft({x}, {half * (d - 1)})) & {mask}L)" if half == 16 else f"aggregate(array({x}), 0L, (a, v) -> (v | shiftleft(v, {half * (d - 1)})) & {mask}L)"
        out.append(f"shiftleft({x}, {k})")
    return " | ".join(out)


class Grid:
    """Different points of a frame (``row_ix`` is the smallest of equal ones, ``n`` their number) with their cells.

    A row with a null axis is no point. One row (the ends of each axis) reaches the driver.
    """

    def __init__(self, points: DataFrame, axes: Sequence[str]):
        self.axes = list(axes)
        points = points.select("row_ix", *axes).na.drop(subset=self.axes)
        ends = points.agg(*(f(a).alias(f"{n}{k}") for k, a in enumerate(axes) for n, f in (("lo", F.min), ("hi", F.max)))).first()
        spans = [(ends[f"hi{k}"] - ends[f"lo{k}"] if ends[f"lo{k}"] is not None else 0.0, -k) for k in range(len(self.axes))]
        self.over = sorted(-k for s, k in sorted(spans, reverse=True)[:GRIDDED] if s > 0) or [0]
        self.side = max(s for s, _ in spans) or 1.0
        self.levels = FINEST
        self.cells = [f"__c{k}" for k in self.over]
        self.low = [ends[f"lo{k}"] or 0.0 for k in self.over]
        single = points.groupBy(*self.axes).agg(F.min("row_ix").alias("row_ix"), F.count("*").alias("n"))
        self.points = single.select("*", *(self._cell(k, 0.0, self.levels).alias(c) for k, c in enumerate(self.cells)))

    def unit(self, k: int) -> Column:
        """The k-th axis of the grid from 0 to 1."""
        return (F.col(self.axes[self.over[k]]) - self.low[k]) / self.side

    def _cell(self, k: int, moved: float, levels: int) -> Column:
        return F.least(F.floor((self.unit(k) + moved) * float(1 << levels)), F.lit((2 if moved else 1) * (1 << levels) - 1)).cast("long")

    def beside(self) -> DataFrame:
        """(row_ix, axes, n, cells, near), written: ``near`` has up to four structs (row_ix, axes) of the points beside each point in either order."""
        m = [f"__m{k}" for k in range(len(self.over))]
        orders = F.array(*(F.struct(F.lit(g).alias("__g"), *(self._cell(k, moved, self.levels).alias(c) for k, c in enumerate(m))) for g, moved in enumerate((0.0, MOVED))))
        own = ["row_ix", *self.axes, "n", *self.cells]
        rest = self.levels - FIRST
        both = self.points.select(*own, F.inline(orders))
        codes = [f"{interleaved([f'shiftright({c}, {rest})' for c in m])} AS __code", f"{interleaved([f'({c} & {(1 << rest) - 1}L)' for c in m])} AS __low"]
        what = ["__low", "row_ix", *self.axes]
        found = in_order(both.selectExpr(*own, "__g", *codes), ["__g"], "__code", carry=what)
        near = F.filter(F.flatten(F.collect_list(F.array("previous", "next"))), lambda x: x.isNotNull())
        return stored(found.groupBy(*own).agg(near.alias("near")), "grid")

    def d2_to(self, x: Column) -> Column:
        return reduce(lambda p, q: p + q, [(F.col(a) - x[a]) * (F.col(a) - x[a]) for a in self.axes])

    def level(self, radius: Column) -> Column:
        """The finest level whose cells are at least twice the radius wide."""
        fit = F.floor(-F.log2(F.greatest(2 * radius / self.side, F.lit(2.0**-self.levels)))).cast("int")
        return F.greatest(F.lit(0), F.least(fit, F.lit(self.levels)))

    def touched(self, queries: DataFrame, radius: str) -> DataFrame:
        """A row for each of ``queries`` and cell (``__level``, ``__k0`` ...) that its ball touches."""
        wide = queries.withColumn("__level", self.level(F.col(radius)))
        reach = F.col(radius) / self.side * (1 + 1e-9)
        scale = F.pow(F.lit(2.0), F.col("__level"))
        last = scale.cast("long") - 1
        ends = []
        for k in range(len(self.over)):
            at = lambda x: F.greatest(F.lit(0), F.least(F.floor(x * scale).cast("long"), last))  # noqa: B023, E731
            ends.append((at(self.unit(k) - reach), at(self.unit(k) + reach)))
        wide = wide.select("*", *(e.alias(f"__{n}{k}") for k, pair in enumerate(ends) for n, e in zip(("lo", "hi"), pair, strict=True)))
        for k in range(len(self.over)):
            wide = wide.withColumn(f"__k{k}", F.explode(F.sequence(F.col(f"__lo{k}"), F.col(f"__hi{k}")))).drop(f"__lo{k}", f"__hi{k}")
        return wide

    @property
    def keys(self) -> list[str]:
        return ["__level", *(f"__k{k}" for k in range(len(self.over)))]

    def placed(self, rows: DataFrame, levels: Sequence[int]) -> DataFrame:
        """``rows`` of the grid's points once for each of ``levels``, with the keys of their cells."""
        at = rows.withColumn("__level", F.explode(F.array(*(F.lit(v) for v in levels))) if levels else F.explode(F.array().cast("array<int>")))
        return at.select("*", *(F.expr(f"shiftright({c}, {self.levels} - __level)").alias(f"__k{k}") for k, c in enumerate(self.cells)))

    def levels_of(self, queries: DataFrame, radius: str) -> list[int]:
        """The levels that ``queries`` use: ``levels`` + 1 numbers at most."""
        return sorted(r[0] for r in queries.select(self.level(F.col(radius)).alias("l")).distinct().collect())


def neighbour_pairs(points: DataFrame, axes: Sequence[str]) -> tuple[Grid, DataFrame, DataFrame]:
    """(grid, queries, pairs): the different points with ``__u2``, the squared distance to the nearer point beside them, and (row_ix, d2) of each pair compared."""
    grid = Grid(points, axes)
    bound = F.array_min(F.transform("near", lambda x: grid.d2_to(x)))
    beside = grid.beside()
    queries = beside.select("row_ix", *grid.axes, "n", bound.alias("__u2"), F.sqrt(bound).alias("__u"))
    seek = queries.filter("n = 1 and __u is not null")
    theirs = grid.placed(beside, grid.levels_of(seek, "__u")).select(*grid.keys, F.col("row_ix").alias("__ix"), *(F.col(a).alias(f"__{a}") for a in axes))
    both = grid.touched(seek, "__u").join(theirs, grid.keys).filter("row_ix <> __ix")
    return grid, queries, both.select("row_ix", squared_distance(axes, [f"__{a}" for a in axes]).alias("d2"))


def nearest_distances(points: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(row_ix, nn): distance of each point to the nearest other one, 0 for equal ones. A point alone and rows with a null axis are left out."""
    grid, queries, pairs = neighbour_pairs(points, axes)
    best = pairs.groupBy("row_ix").agg(F.min("d2").alias("d2"))
    one = queries.join(best, "row_ix", "left").select(*axes, F.when(F.col("n") > 1, F.lit(0.0)).otherwise(F.least("d2", "__u2")).alias("d2"))
    return points.select("row_ix", *axes).join(one, list(axes)).filter("d2 is not null").select("row_ix", F.sqrt("d2").alias("nn"))


def spanning_tree(points: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(row_a, row_b, length): the Euclidean minimum spanning tree of the different points (of equal ones the smallest ``row_ix``).

    Boruvka rounds with the components in Spark. In the orders of the grid every component stands beside another one somewhere, which bounds its shortest edge out; each of its points seeks points of
    other components within that radius, in touched cells that hold any. Edges are ordered by (length, smaller id, larger id), so chosen edges close no circle, and a chain of chosen edges is
    followed to its end by doubling. Nothing but counts reaches the driver.
    """
    grid = Grid(points, axes)
    beside = grid.beside().select("row_ix", *grid.axes, *grid.cells, F.transform("near", lambda x: F.struct(x["row_ix"].alias("ix"), grid.d2_to(x).alias("d2"))).alias("near"))
    comp = beside.select("row_ix", F.col("row_ix").alias("c"))
    left, edges = comp.count(), []
    edge = lambda d2, a, b: F.struct(d2.alias("d2"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    while left > 1:
        mine = beside.join(comp, "row_ix")
        by_order = mine.select("row_ix", "c", F.explode("near").alias("x")).join(comp.select(F.col("row_ix").alias("ix"), F.col("c").alias("d")), F.col("x.ix") == F.col("ix")).filter("c <> d")
        start = by_order.groupBy("c").agg(F.min(edge(F.col("x.d2"), F.col("row_ix"), F.col("ix"))).alias("e0"), F.min_by("d", edge(F.col("x.d2"), F.col("row_ix"), F.col("ix"))).alias("d0"))
        start = stored(start.withColumn("__u", F.sqrt("e0.d2")), "tree-start")
        labelled = mine.drop("near")
        seek = labelled.join(start.select("c", "__u"), "c")
        there = stored(grid.placed(labelled, grid.levels_of(start, "__u")).select(*grid.keys, F.col("row_ix").alias("__ix"), F.col("c").alias("__d"), *(F.col(a).alias(f"__{a}") for a in axes)), "tree-cells")
        cells = there.groupBy(*grid.keys).agg(F.min("__d").alias("__lo"), F.max("__d").alias("__hi"))
        asked = grid.touched(seek, "__u").join(cells, grid.keys).filter("__lo <> c or __hi <> c").drop("__lo", "__hi")
        d2 = squared_distance(axes, [f"__{a}" for a in axes])
        found = asked.join(there, grid.keys).filter("c <> __d").withColumn("d2", d2).filter(F.col("d2") <= F.col("__u") * F.col("__u") * (1 + 1e-9))
        e = edge(F.col("d2"), F.col("row_ix"), F.col("__ix"))
        best = found.groupBy("c").agg(F.min(e).alias("e1"), F.min_by("__d", e).alias("d1"))
        nearer = F.col("e1").isNotNull() & (F.col("e1") < F.col("e0"))
        chosen = start.join(best, "c", "left").select("c", F.when(nearer, F.col("e1")).otherwise(F.col("e0")).alias("e"), F.when(nearer, F.col("d1")).otherwise(F.col("d0")).alias("to"))
        chosen = stored(chosen, "tree-edges")
        edges.append(chosen.select("e.*").distinct())
        # two components that chose the same edge are one end of all chains into them
        back = chosen.select(F.col("c").alias("to"), F.col("e").alias("f"))
        up = stored(chosen.join(back, "to").select("c", F.when((F.col("e") == F.col("f")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("up")), "tree-up")
        while True:
            far = up.join(up.select(F.col("c").alias("up"), F.col("up").alias("far")), "up")
            if not far.filter("far <> up").limit(1).count():
                break
            up = stored(far.select("c", F.col("far").alias("up")), "tree-up")
        comp = stored(comp.join(up, "c").select("row_ix", F.col("up").alias("c")), "tree-parts")
        left = comp.select("c").distinct().count()
    if not edges:
        return points.sparkSession.createDataFrame([], "row_a long, row_b long, length double")
    return reduce(lambda x, y: x.union(y), edges).distinct().select(F.col("a").alias("row_a"), F.col("b").alias("row_b"), F.sqrt("d2").alias("length"))
