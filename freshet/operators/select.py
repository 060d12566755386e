"""Space-filling selections from a pool in unit-box coordinates.

The distance work is distributed. What reaches the driver at once is in proportion to the number of targets: they ask for a few rows each,
and again only while a pick is open or the potentials show a cheaper row in the pool; the short ordered algorithms run there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.scratch import discard, stored
from .neighbours import interleaved, squared_distance
from .normalize import HI, LO, cdf_normalize, minmax_normalize
from .order import in_order

#: Most cells a side, steps of the bisection probed in one pass, rows of a pass of the farthest-first rule that reach the driver.
GRID_CAP, AHEAD, TOP = 4096, 3, 1000
#: Rows that a target asks for at once, the most when few ask (Spark's window group limit), and the gain below which a row is not cheaper.
ASK, MOST, LEAST_GAIN = 8, 1000, 1e-9
#: Distances that a task holds at once.
HELD = 1_000_000


def latin_hypercube(n: int, d: int, seed: int = 42, lo: Sequence[float] | None = None, hi: Sequence[float] | None = None) -> np.ndarray:
    """(n, d) points, one in each of n equal slices of every axis, scaled to the bounds."""
    rng = np.random.default_rng(seed)
    u = rng.uniform(size=(n, d))
    slices = np.tile(np.arange(1, n + 1), (d, 1))
    for row in slices:
        rng.shuffle(row)
    x = (slices.T - u) / n
    lo, hi = (np.asarray(v if v is not None else w, float) for v, w in ((lo, np.zeros(d)), (hi, np.ones(d))))
    return lo + x * (hi - lo)


@dataclass(frozen=True)
class Selection:
    """Chosen rows; for anchored rules also the targets in order of drawing and their distances."""

    rows: list[int]
    targets: np.ndarray | None = None
    paired: list[int] = field(default_factory=list)
    displacement: list[float] = field(default_factory=list)
    info: dict = field(default_factory=dict)


def _check(x: DataFrame, n: int) -> int:
    m = x.count()
    if n > m:
        raise ValueError(f"{n} rows were asked for, the pool has {m}")
    return m


def _with_targets(x: DataFrame, axes: Sequence[str], targets: np.ndarray, which: Sequence[int], more: str = "", extra: Sequence[tuple] | None = None) -> DataFrame:
    """Rows of ``x`` beside each of the targets ``which`` (a broadcast) and their columns ``more``, with ``d2``."""
    made = [(int(i), *map(float, targets[i]), *(extra[k] if extra else ())) for k, i in enumerate(which)]
    t = x.sparkSession.createDataFrame(made, "target int, " + ", ".join(f"`__{a}` double" for a in axes) + more)
    return x.crossJoin(F.broadcast(t)).withColumn("d2", squared_distance(axes, [f"__{a}" for a in axes]))  # n targets, a parameter


def nearest_candidates(x: DataFrame, axes: Sequence[str], targets: np.ndarray, k: int) -> DataFrame:
    """(target, row_ix, d2, rank): the ``k`` rows nearest to each target, ties to the lower row.

    Targets are a broadcast of n rows. The filter on the rank lets Spark keep each task's ``k`` nearest rows of a target before the shuffle
    (its window group limit, for k up to 1,000).
    """
    return _nearest(_with_targets(x, axes, targets, range(len(targets))), k)


def _nearest(near: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("target").orderBy("d2", "row_ix"))
    return near.select("target", "row_ix", "d2").withColumn("rank", rank).filter(F.col("rank") <= k)


def _first(k: int, at: list[np.ndarray]) -> list[np.ndarray]:
    """Of the rows (target, score, row_ix, ...) the ``k`` of each target with the least score, ties to the lower row."""
    order = np.lexsort((at[2], at[1], at[0]))
    at = [a[order] for a in at]
    starts = np.flatnonzero(np.r_[True, at[0][1:] != at[0][:-1]]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return [a[rank < k] for a in at]


def _least(x: DataFrame, axes: Sequence[str], targets: np.ndarray, which: Sequence[int], k: int, score: Callable = lambda d2, at, cols: d2, more: Sequence[str] = ()) -> DataFrame:
    """(target, score, row_ix, d2): for each of the targets ``which`` the ``k`` rows with the least score, ties to the lower row.

    ``score`` is given squared distances (targets by rows), which of ``which`` they belong to and the columns ``more`` of the rows (NaN for null); a row whose score is infinite is left out. Tasks form distances in blocks of ``HELD``
    and keep ``k`` rows a target, so neither all distances nor an order of them exist anywhere. The targets go with the tasks.
    """
    which, points = np.asarray(which, np.int32), np.asarray(targets, float)[list(which)]

    def keep(batches):
        best = [np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ["row_ix", *axes, *more]}
            for lo in range(0, len(cols["row_ix"]), HELD):
                part = {c: v[lo : lo + HELD] for c, v in cols.items()}
                for at in np.array_split(np.arange(len(which)), max(1, -(-len(which) * len(part["row_ix"]) // HELD))):
                    d2 = reduce(lambda u, v: u + v, [(part[a] - points[at, j][:, None]) ** 2 for j, a in enumerate(axes)])
                    s = score(d2, at, part)
                    cut = np.partition(s, k - 1, axis=1)[:, k - 1 : k] if k < s.shape[1] else np.inf
                    i, j = np.nonzero((s <= cut) & (s < np.inf))
                    new = _first(k, [which[at][i], s[i, j], part["row_ix"][j], d2[i, j]])
                    best = [np.concatenate(b) for b in zip(best, new, strict=True)]
            best = _first(k, best)
        yield pa.RecordBatch.from_arrays([pa.array(b) for b in best], ["target", "score", "row_ix", "d2"])

    kept = x.select("row_ix", *axes, *more).mapInArrow(keep, "target int, score double, row_ix long, d2 double")
    rank = F.row_number().over(Window.partitionBy("target").orderBy("score", "row_ix"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


@dataclass
class Picks:
    """(d2, row) that each target takes, the rows it was offered, and which targets took a row of their first offer."""

    taken: list[tuple[float, int]]
    offered: list[dict[int, float]]
    first: list[int | None]


def _take_in_order(x: DataFrame, axes: Sequence[str], targets: np.ndarray, ask: int = ASK) -> Picks:
    """Each target, in order, takes the nearest row not yet taken.

    A row goes to the first target that wants it; who loses it tries the next of its offer, and asks again, without the rows of targets
    before it, when none is left. A row only ever passes to an earlier target, so the result is that of the ordered loop.
    """
    n = len(targets)
    holder: dict[int, int] = {}
    taken: list[tuple[float, int] | None] = [None] * n
    first: list[int | None] = [None] * n
    offered: list[dict[int, float]] = [{} for _ in range(n)]
    offer: list[list[tuple[float, int]]] = [[] for _ in range(n)]
    at, asks, asking, again = [0] * n, [0] * n, list(range(n)), False
    while asking:
        k = max(1, min(n, MOST, max(ask, ask * n // len(asking))))
        free = x.select("row_ix", *axes)
        if again:
            held = x.sparkSession.createDataFrame(list(holder.items()), "row_ix long, holder int")
            free = free.join(F.broadcast(held), "row_ix", "left")  # at most n rows
        askers = np.array(asking)
        near = _least(free, axes, targets, asking, k, lambda d2, i, cols: np.where(cols["holder"] <= askers[i][:, None], np.inf, d2), ["holder"]) if again else _least(free, axes, targets, asking, k)  # noqa: B023
        for i in asking:
            offer[i], at[i], asks[i] = [], 0, asks[i] + 1
        for r in near.collect():
            offer[r.target].append((r.d2, r.row_ix))
            offered[r.target][r.row_ix] = r.d2
        for i in asking:
            offer[i].sort()
        left, hungry = list(asking), []
        while left:
            i = left.pop()
            while at[i] < len(offer[i]):
                d2, row = offer[i][at[i]]
                at[i] += 1
                before = holder.get(row)
                if before is None or before > i:
                    holder[row], taken[i], first[i] = i, (d2, row), at[i] - 1 if asks[i] == 1 else None
                    if before is not None:
                        taken[before] = None
                        left.append(before)
                    break
            else:
                hungry.append(i)
        asking, again = sorted(hungry), True
    return Picks(taken, offered, first)


def lhs_nearest(x: DataFrame, axes: Sequence[str], n: int, seed: int, k_pool: int | None = None) -> Selection:
    """Latin-hypercube targets take, in order, the nearest row not yet taken. ``fallbacks`` counts picks beyond the ``k_pool`` nearest."""
    m = _check(x, n)
    k_pool = min(max(8, n // 4), m) if k_pool is None else k_pool
    targets = latin_hypercube(n, len(axes), seed)
    got = _take_in_order(x, axes, targets)
    late = sum(k >= k_pool for k in got.first if k is not None)
    if far := [i for i, k in enumerate(got.first) if k is None]:
        nearer = _with_targets(x, axes, targets, far, ", cut double, pick long", [got.taken[i] for i in far]).filter((F.col("d2") < F.col("cut")) | ((F.col("d2") == F.col("cut")) & (F.col("row_ix") < F.col("pick"))))
        late += nearer.groupBy("target").count().filter(F.col("count") >= k_pool).count() if k_pool > 0 else len(far)
    rows = [row for _, row in got.taken]
    return Selection(sorted(rows), targets, rows, [d2**0.5 for d2, _ in got.taken], {"fallbacks": late})


def assign(cost: list[dict[int, float]]) -> tuple[list[int], list[float], dict[int, float]] | None:
    """Cheapest one-to-one assignment of each entry of ``cost`` to one of its keys: (keys, u, v), or None if there is none.

    Shortest augmenting paths with potentials u (entries) and v <= 0 (keys): u_i + v_j <= cost_ij, with equality where assigned.
    """
    import heapq

    owner: dict[int, int] = {}
    taken: list[int | None] = [None] * len(cost)
    u, v = [0.0] * len(cost), {}
    for start in range(len(cost)):
        dist: dict[int, float] = {}
        via: dict[int, int] = {}
        done: dict[int, float] = {}
        reach = {start: 0.0}
        heap: list[tuple[float, int]] = []
        row, at, sink = start, 0.0, None
        while True:
            for j, c in cost[row].items():
                if j not in done and (d := at + c - u[row] - v.get(j, 0.0)) < dist.get(j, float("inf")):
                    dist[j], via[j] = d, row
                    heapq.heappush(heap, (d, j))
            while heap and heap[0][1] in done:
                heapq.heappop(heap)
            if not heap:
                return None
            at, j = heapq.heappop(heap)
            done[j] = at
            if j not in owner:
                sink = j
                break
            row = owner[j]
            reach[row] = at
        for i, d in reach.items():
            u[i] += at - d
        for j, d in done.items():
            v[j] = v.get(j, 0.0) + d - at
        j = sink
        while True:
            i = via[j]
            owner[j], taken[i], j = i, j, taken[i]
            if i == start:
                break
    return taken, u, v


def _cheapest(x: DataFrame, axes: Sequence[str], targets: np.ndarray, ask: int, power: float) -> tuple[list[int], list[float], list[dict]]:
    """(rows, costs, log) of the one-to-one assignment with the least sum of ``d2 ** power`` over the whole pool.

    The assignment over the rows offered so far is optimal for the pool if its potentials satisfy u_i + v_j <= cost_ij for every row; the
    rows that break this most are found in Spark and offered next, until none does.
    """
    got = _take_in_order(x, axes, targets, ask)
    cost = [{row: d2**power for row, d2 in c.items()} for c in got.offered]
    base = np.sqrt if power == 0.5 else np.asarray
    log: list[dict] = []
    while True:
        rows, u, v = assign(cost)
        far = [c[r] for c, r in zip(cost, rows, strict=True)]
        priced = x.sparkSession.createDataFrame([(int(r), float(p)) for r, p in v.items() if p], "row_ix long, price double")
        pool = x.select("row_ix", *axes).join(F.broadcast(priced), "row_ix", "left")  # at most n rows have a price
        ceiling = np.array(u, float)
        best = _least(pool, axes, targets, range(len(targets)), min(ask, MOST), lambda d2, i, cols: base(d2) - (ceiling[i][:, None] + np.nan_to_num(cols["price"])), ["price"]).collect()  # noqa: B023
        slack, dual = -min(r.score for r in best), sum(u) + sum(v.values())
        sure = slack <= LEAST_GAIN and abs(dual - sum(far)) <= 1e-7 * max(1.0, sum(far))
        log.append({"k": max(map(len, cost)), "feasible": True, "total": sum(far), "lp_total": dual, "slack": slack, "certified": sure})
        new = [r for r in best if -r.score > LEAST_GAIN and r.row_ix not in cost[r.target]]
        if sure or not new:
            return rows, far, log
        for r in new:
            cost[r.target][r.row_ix] = r.d2**power


def lhs_assigned(x: DataFrame, axes: Sequence[str], n: int, seed: int) -> Selection:
    """Latin-hypercube targets and distinct rows with the least sum of squared distances."""
    _check(x, n)
    targets = latin_hypercube(n, len(axes), seed)
    rows, cost, _ = _cheapest(x, axes, targets, ASK, 1.0)
    return Selection(sorted(rows), targets, rows, [c**0.5 for c in cost], {"total": sum(cost)})


def certified_assignment(x: DataFrame, axes: Sequence[str], targets: np.ndarray, ladder: Sequence[int]) -> Selection:
    """Least sum of distances, proved for the whole pool by the potentials.

    A target asks for as many rows at once as the first step of ``ladder`` and for more only where the potentials show a cheaper row;
    the ladder must reach the number of targets, the number of rows that always suffices, but its later steps are never fetched whole.
    """
    n, m = len(targets), _check(x, len(targets))
    steps = sorted({min(k, m) for k in ladder if k >= 1})
    if not steps or steps[-1] < n:
        raise ValueError(f"the ladder must reach {n}")
    rows, far, log = _cheapest(x, axes, targets, steps[0], 0.5)
    last = log[-1]
    return Selection(sorted(rows), targets, rows, far, {k: last[k] for k in ("total", "k", "slack", "certified")} | {"ladder": log})


def maximin(x: DataFrame, axes: Sequence[str], n: int, seed: int = 0, top: int = TOP) -> Selection:
    """Starts farthest from the mean, then adds the row farthest from all chosen ones, ties to the lower row; ``seed`` has no effect.

    A row's distance to the chosen ones only falls, so an old distance bounds the present one. A pass over the pool brings all distances up to date and sends the ``top`` rows with
    the largest to the driver, which picks among them as long as its best one is ahead of the last row sent: no other row can be. ``info`` has the number of passes.
    Each pass is written and read back, so no plan holds those before it. Of equal points the lowest row is measured alone; the others come last, in order of their rows.
    """
    _check(x, n)
    base = x.select("row_ix", *axes)
    mean = base.agg(*(F.avg(a).alias(a) for a in axes)).first()
    d2 = lambda p: reduce(lambda u, v: u + v, [(F.col(a) - p[k]) * (F.col(a) - p[k]) for k, a in enumerate(axes)])

    def measured(far: DataFrame, points: Sequence[Sequence[float]]) -> DataFrame:
        picks = x.sparkSession.createDataFrame([([[float(v) for v in p] for p in points],)], "picks array<array<double>>")
        return far.crossJoin(F.broadcast(picks)).select("row_ix", *axes, F.least("near", F.array_min(F.transform("picks", d2))).alias("near"))  # one row of at most n picks

    far = stored(base.groupBy(*axes).agg(F.min("row_ix").alias("row_ix")).select("row_ix", *axes, F.lit(float("inf")).alias("near")), "maximin")
    # the first pass measures from the mean, which is no pick
    start = measured(far, [tuple(mean)]).orderBy(F.desc("near"), "row_ix").first() if n > 0 else None
    chosen, new, passes = [start.row_ix] if start else [], [tuple(start[a] for a in axes)] if start else [], 1
    while len(chosen) < n:
        old, far = far, stored(measured(far, new), "maximin")
        discard(old)
        sent = far.filter("near > 0").orderBy(F.desc("near"), "row_ix").limit(top).collect()
        passes, new = passes + 1, []
        if not sent:  # the rest stands where chosen rows do
            taken = set(chosen)
            chosen += [r.row_ix for r in base.select("row_ix").orderBy("row_ix").limit(n).collect() if r.row_ix not in taken][: n - len(chosen)]
            break
        last = (-sent[-1].near, sent[-1].row_ix) if len(sent) == top else (0.0, -1)
        sent.sort(key=lambda r: r.row_ix)
        at, near = np.array([[r[a] for a in axes] for r in sent]), np.array([r.near for r in sent])
        while len(chosen) < n:
            k = int(near.argmax())  # of equal ones the lowest row
            if near[k] <= 0 or (-near[k], sent[k].row_ix) > last:
                break
            chosen.append(sent[k].row_ix)
            new.append(tuple(at[k]))
            near = np.minimum(near, _squared(at, at[k]))
            near[k] = -np.inf
    discard(far)
    return Selection(sorted(chosen), info={"passes": passes})


def _squared(at: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances, their terms added in the order of the axes as in Spark."""
    return reduce(lambda u, v: u + v, [(at[:, k] - p[k]) * (at[:, k] - p[k]) for k in range(at.shape[1])])


def cells(x: DataFrame, axes: Sequence[str], g: int) -> DataFrame:
    """(row_ix, axes, cell): the grid cell of each row at ``g`` cells a side."""
    return x.withColumn("cell", F.array(*(F.least(F.floor(F.col(a) * g).cast("int"), F.lit(g - 1)) for a in axes)))


def doubled_occupancy(x: DataFrame, axes: Sequence[str]) -> dict[int, int]:
    """Occupied cells at 1, 2, 4 ... ``GRID_CAP`` a side, from one pass.

    A cell at half the resolution is a prefix of the interleaved cell number. In the order of these numbers a prefix begins wherever two neighbours part at or above its level, so the
    levels at which neighbours part, counted, add up to all occupancies.
    """
    d, levels = len(axes), GRID_CAP.bit_length() - 1
    first = min(levels, 60 // d)
    cell = [f"__c{k}" for k in range(d)]
    own = x.select(*(F.least(F.floor(F.col(a) * GRID_CAP), F.lit(GRID_CAP - 1)).cast("long").alias(c) for a, c in zip(axes, cell, strict=True))).distinct()
    rest = levels - first
    codes = [f"{interleaved([f'shiftright({c}, {rest})' for c in cell])} AS code", f"{interleaved([f'({c} & {(1 << rest) - 1}L)' for c in cell])} AS low", "0 AS g"]
    sorted_ = in_order(own.selectExpr(*codes), ["g"], "code", carry=["low"])
    bits = lambda a, b: F.when(a == b, F.lit(0)).otherwise(F.length(F.bin(a.bitwiseXOR(b))))
    shared = F.when(F.col("code") != F.col("previous.code"), first - F.ceil(bits(F.col("code"), F.col("previous.code")) / d)).otherwise(levels - F.ceil(bits(F.col("low"), F.col("previous.low")) / d))
    parted = {r.shared: r["count"] for r in sorted_.groupBy(shared.alias("shared")).count().collect()}  # a row a level
    out, total = {}, parted.get(None, 0)
    for k in range(levels + 1):
        total += parted.get(k - 1, 0)
        out[1 << k] = total
    return out


def occupancies(x: DataFrame, axes: Sequence[str], sides: Sequence[int]) -> dict[int, int]:
    """Occupied cells for each of a few numbers of cells a side, in one pass."""
    at = x.select(F.explode(F.array(*(F.struct(F.lit(g).alias("g"), F.array(*(F.least(F.floor(F.col(a) * g).cast("int"), F.lit(g - 1)) for a in axes)).alias("cell")) for g in sides))).alias("s"))
    return {r.g: r["count"] for r in at.select("s.*").distinct().groupBy("g").count().collect()}


def occupied(x: DataFrame, axes: Sequence[str], g: int) -> int:
    return occupancies(x, axes, [g]).get(g, 0)


def grid_for(x: DataFrame, axes: Sequence[str], n: int) -> int:
    """Cells a side so that ``n`` or more are occupied: doubling, then bisection.

    Occupancy need not grow with the number, so that order of probing defines the result. Probes that bisection may come to in its next ``AHEAD`` steps share a pass.
    """
    by_doubling = doubled_occupancy(x, axes)
    lo, hi = 1, 2
    while by_doubling[hi] < n:
        hi *= 2
        if hi > GRID_CAP:
            raise ValueError("the pool does not occupy enough cells")
    known = dict(by_doubling)

    def ahead(lo: int, hi: int, steps: int) -> set[int]:
        mid = (lo + hi) // 2
        return set() if lo >= hi or not steps else {mid} | ahead(lo, mid, steps - 1) | ahead(mid + 1, hi, steps - 1)

    while lo < hi:
        mid = (lo + hi) // 2
        if mid not in known:
            known |= occupancies(x, axes, sorted(ahead(lo, hi, AHEAD) - set(known)))
        lo, hi = (lo, mid) if known.get(mid, 0) >= n else (mid + 1, hi)
    return hi


def cell_members(x: DataFrame, axes: Sequence[str], g: int) -> DataFrame:
    """(k, row_ix): the occupied cells at ``g`` a side numbered from 0 in order of their coordinates, each with the row nearest its centre (ties to the lower row).

    Numbers come from prefix sums over ranges of the leading coordinates; cells that share those (five or more axes) are numbered among themselves.
    """
    lead = min(len(axes), 62 // g.bit_length())
    off = squared_distance([f"__{i}" for i in range(len(axes))], axes)
    mid = cells(x, axes, g).select("*", *(((F.col("cell")[i] + 0.5) / g).alias(f"__{i}") for i in range(len(axes))))
    best = mid.groupBy("cell").agg(F.min_by("row_ix", F.struct(off.alias("d"), "row_ix")).alias("row_ix"))
    code = reduce(lambda u, v: u * g + v, [F.col("cell")[i].cast("long") for i in range(lead)])
    best = best.withColumn("code", code)
    before = in_order(best.groupBy("code").agg(F.count("*").alias("n")).withColumn("g", F.lit(0)), ["g"], "code", ["n"]).select("code", (F.col("n_upto") - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("code").orderBy("cell")) - 1
    return best.withColumn("__i", inside).join(before, "code").select((F.col("before") + F.col("__i")).alias("k"), "row_ix")


def eps_cells(x: DataFrame, axes: Sequence[str], n: int, seed: int) -> Selection:
    """``n`` occupied cells of a grid drawn evenly, each represented by the row nearest its centre."""
    _check(x, n)
    g = grid_for(x, axes, n)
    members = cell_members(x, axes, g)
    count = members.count()
    drawn = x.sparkSession.createDataFrame([(int(i),) for i in np.random.default_rng(seed).choice(count, size=n, replace=False)], "k long")
    rows = [r.row_ix for r in members.join(F.broadcast(drawn), "k", "left_semi").collect()]  # n rows, a parameter
    return Selection(sorted(rows), info={"grid_resolution": g, "n_occupied_cells": count})


def random_rows(x: DataFrame, axes: Sequence[str], n: int, seed: int) -> Selection:
    """``n`` of the rows 0 to m - 1 without replacement, from numpy's generator."""
    m = _check(x, n)
    return Selection(sorted(int(i) for i in np.random.default_rng(seed).choice(m, size=n, replace=False)))


def random_rows_at_scale(x: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows with the smallest hashes of their index: the same for any partitioning, nothing on the driver."""
    return x.orderBy(F.xxhash64(F.lit(seed), "row_ix"), "row_ix").limit(n).select("row_ix")


SELECTORS = {"random": random_rows, "lhs_nn": lhs_nearest, "lhs_assign": lhs_assigned, "maximin": maximin, "eps_cell": eps_cells}


def absolute_filling(image: DataFrame, axes: Sequence[str], n: int, seed: int, lo: float = LO, hi: float = HI) -> Selection:
    return lhs_nearest(minmax_normalize(image, axes, lo, hi).persist(), axes, n, seed)


def cdf_filling(image: DataFrame, axes: Sequence[str], n: int, seed: int) -> Selection:
    return lhs_nearest(cdf_normalize(image, axes).persist(), axes, n, seed)


def snap_axis_shares(x: DataFrame, axes: Sequence[str], chosen: Selection) -> dict[str, float]:
    """Mean share of each axis in the squared displacement of the targets; even shares where there is none."""
    at = {r.row_ix: [r[a] for a in axes] for r in x.filter(F.col("row_ix").isin(chosen.rows)).collect()}  # the selection
    d2 = (chosen.targets - np.array([at[r] for r in chosen.paired])) ** 2
    total = d2.sum(axis=1, keepdims=True)
    share = np.divide(d2, total, out=np.full_like(d2, 1 / len(axes)), where=total > 0)
    return dict(zip(axes, share.mean(axis=0).tolist(), strict=True))


def distance_concentration(x: DataFrame, axes: Sequence[str], snaps: Sequence[float], seed: int = 0, pairs: int = 20_000) -> dict[str, float]:
    """Mean snap distance over the mean distance of ``pairs`` random pairs of different rows (0 to m - 1)."""
    m = x.count()
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, m, size=pairs), rng.integers(0, m, size=pairs)
    drawn = x.sparkSession.createDataFrame([(int(a), int(b)) for a, b in zip(i, j, strict=True) if a != b], "row_ix long, other long")
    both = drawn.join(x.select("row_ix", *axes), "row_ix").join(x.select(F.col("row_ix").alias("other"), *(F.col(a).alias(f"__{a}") for a in axes)), "other")
    mean = both.agg(F.avg(F.sqrt(squared_distance(axes, [f"__{a}" for a in axes])))).first()[0]
    snap = float(np.mean(snaps))
    return {"mean_snap": snap, "mean_random_pair": mean, "concentration_ratio": snap / mean}


def jaccard(a: Sequence[int], b: Sequence[int]) -> float:
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else float("nan")


def pairwise_jaccard(sets: Sequence[Sequence[int]]) -> float:
    vals = [jaccard(a, b) for i, a in enumerate(sets) for b in sets[i + 1 :]]
    return sum(vals) / len(vals) if vals else float("nan")


def jaccard_pairs(members: DataFrame) -> DataFrame:
    """(a, b, jaccard) of every pair of named sets in (name, row_ix) that share a row, from counts of shared rows."""
    m = members.distinct()
    size = m.groupBy("name").agg(F.count("*").alias("n"))
    both = m.withColumnRenamed("name", "a").join(m.withColumnRenamed("name", "b"), "row_ix").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    sized = both.join(F.broadcast(size.withColumnsRenamed({"name": "a", "n": "na"})), "a").join(F.broadcast(size.withColumnsRenamed({"name": "b", "n": "nb"})), "b")  # one row per named set
    return sized.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))
