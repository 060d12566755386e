import math

import numpy as np
import pytest

from freshet.functions import seeds
from freshet.operators import coverage, normalize, screen, select
from freshet.plans import design


def clustered(m, d, seed):
    rng = np.random.default_rng(seed)
    k = max(1, m // 10)
    return np.vstack([rng.normal(0, 1, (m - k, d)), rng.normal(5, 2, (k, d))])


def frame(spark, h, names=None):
    names = names or [f"x{i}" for i in range(h.shape[1])]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(h)], "row_ix long, " + ", ".join(f"{n} double" for n in names)).repartition(3).persist(), names


#: Selections of three known designs.
ABS_3D = [70, 101, 108, 130, 143, 150, 153, 167, 214, 261, 267, 276, 282, 283, 284, 285, 286, 289, 291, 292, 293, 294, 295, 297]
ABS_6D = [21, 30, 67, 78, 82, 102, 112, 156, 207, 214, 220, 270, 277, 314, 339, 354, 415, 431, 450, 453, 457, 458, 461, 464, 465, 466, 467, 468, 469, 470, 471, 473, 474, 478, 481, 484, 487, 491, 492, 498]
CDF_3D = [3, 16, 28, 45, 50, 52, 55, 58, 63, 77, 100, 114, 121, 145, 151, 163, 174, 195, 209, 230, 233, 237, 249, 263]


def test_pinned_selections(spark):
    a, n3 = frame(spark, clustered(300, 3, 11))
    b, n6 = frame(spark, clustered(500, 6, 3))
    assert select.absolute_filling(a, n3, 24, 2).rows == ABS_3D
    assert select.absolute_filling(b, n6, 40, 7).rows == ABS_6D
    assert select.cdf_filling(a, n3, 24, 2).rows == CDF_3D


@pytest.fixture(scope="module")
def pool(spark):
    h = clustered(200, 3, 5)
    df, names = frame(spark, h)
    x = normalize.minmax_normalize(df, names).persist()
    return df, x, names, np.array([list(r)[1:] for r in x.orderBy("row_ix").collect()])


def test_assignments_are_optimal(pool):
    import itertools

    df, x, names, xs = pool
    got = select.lhs_assigned(x, names, 25, 4)
    greedy = select.lhs_nearest(x, names, 25, 4)
    assert got.info["total"] <= sum(d * d for d in greedy.displacement) + 1e-12 and len(set(got.rows)) == 25
    small = [{j: float(((got.targets[i] - xs[j]) ** 2).sum()) for j in range(7)} for i in range(5)]
    best = min(sum(small[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(7), 5))
    rows, u, v = select.assign(small)
    assert sum(small[i][j] for i, j in enumerate(rows)) == pytest.approx(best)
    assert sum(u) + sum(v.values()) == pytest.approx(best) and max(v.values()) <= 1e-12
    assert all(u[i] + v.get(j, 0) <= c + 1e-9 for i, row in enumerate(small) for j, c in row.items())
    assert select.assign([{1: 0.5}, {1: 0.2}]) is None
    sure = select.certified_assignment(x, names, select.latin_hypercube(25, 3, 4), [2, 4, 25, 200])
    dense = select.assign([{j: float(np.sqrt(((t - xs[j]) ** 2).sum())) for j in range(200)} for t in select.latin_hypercube(25, 3, 4)])
    assert sure.info["certified"] and sure.info["total"] == pytest.approx(sum(dense[1]) + sum(dense[2].values()), rel=1e-9)
    with pytest.raises(ValueError):
        select.certified_assignment(x, names, select.latin_hypercube(25, 3, 4), [2, 4])


def test_selectors_collect_rows_in_proportion_to_targets(pool, monkeypatch):
    """No collect brings more than eight rows for each target, and the picks equal those over the dense table of distances."""
    df, x, names, xs = pool
    n, sizes = 60, []
    plain = type(x).collect
    monkeypatch.setattr(type(x), "collect", lambda self: (rows := plain(self), sizes.append(len(rows)))[0])
    targets = select.latin_hypercube(n, 3, 6)
    d2 = ((targets[:, None, :] - xs[None, :, :]) ** 2).sum(axis=2)
    used, want, late = set(), [], 0
    for row in d2:
        order = np.argsort(row, kind="stable")
        k = next(k for k, j in enumerate(order) if int(j) not in used)
        used.add(int(order[k]))
        want.append(int(order[k]))
        late += k >= 15
    greedy = select.lhs_nearest(x, names, n, 6)
    assert greedy.paired == want and greedy.info["fallbacks"] == late > 0
    least = lambda cost: sum(c[r] for c, r in zip(cost, select.assign(cost)[0], strict=True))
    tables = [[dict(enumerate(map(float, row))) for row in d] for d in (d2, np.sqrt(d2))]
    assert select.lhs_assigned(x, names, n, 6).info["total"] == pytest.approx(least(tables[0]), rel=1e-9)
    sure = select.certified_assignment(x, names, targets, [4, n, 2 * n, 200])
    assert sure.info["certified"] and sure.info["total"] == pytest.approx(least(tables[1]), rel=1e-9)
    assert sizes and max(sizes) <= 8 * n


def test_greedy_maximin_and_cells(pool):
    df, x, names, xs = pool
    got = select.maximin(x, names, 9)
    d = ((xs - xs.mean(axis=0)) ** 2).sum(axis=1)
    chosen = [int(d.argmax())]
    near = ((xs - xs[chosen[0]]) ** 2).sum(axis=1)
    for _ in range(8):
        near[chosen] = -1
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((xs - xs[chosen[-1]]) ** 2).sum(axis=1))
    assert got.rows == sorted(chosen)
    e = select.eps_cells(x, names, 20, 3)
    assert len(set(e.rows)) == 20 and e.info["n_occupied_cells"] >= 20
    g = e.info["grid_resolution"]
    keys = sorted({tuple(c) for c in np.minimum((xs * g).astype(int), g - 1)})
    assert len(keys) == e.info["n_occupied_cells"]
    want = []
    for k in np.random.default_rng(3).choice(len(keys), size=20, replace=False):
        mine = [i for i in range(len(xs)) if tuple(np.minimum((xs[i] * g).astype(int), g - 1)) == keys[k]]
        want.append(min(mine, key=lambda i: (((xs[i] - (np.array(keys[k]) + 0.5) / g) ** 2).sum(), i)))
    assert e.rows == sorted(want)
    for rule in select.SELECTORS.values():
        with pytest.raises(ValueError):
            rule(x, names, 201, seed=1)
    assert select.lhs_nearest(x, names, 200, 1).rows == list(range(200))
    assert select.random_rows_at_scale(x, 10, 1).count() == 10


def l2(x):
    n, d = x.shape
    pair = np.prod(1 - np.maximum(x[:, None], x[None]), axis=2).sum()
    return math.sqrt(3.0**-d - 2.0 ** (1 - d) / n * np.prod(1 - x**2, axis=1).sum() + pair / n**2)


def test_coverage_figures(spark, pool):
    df, x, names, xs = pool
    rows = list(range(0, 200, 7))
    mine = x.join(design.rows_frame(x, rows), "row_ix", "left_semi").persist()
    p = xs[rows]
    assert coverage.star_discrepancy(mine, names).first().l2_star == pytest.approx(l2(p), rel=1e-12)
    dist = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    np.fill_diagonal(dist, np.inf)
    near = coverage.nearest_summary(mine, names).first()
    assert near.nn_mean == pytest.approx(dist.min(axis=1).mean()) and near.nn_cv == pytest.approx(dist.min(axis=1).std() / dist.min(axis=1).mean())
    h = 0.33 * len(p) ** (-1 / 3)
    k = np.exp(-np.where(np.isinf(dist), 0, dist) ** 2 / (2 * h * h))
    lam = np.linalg.eigvalsh(k)
    e = coverage.effective_sample_size(mine, names).first()
    assert e.ess == pytest.approx(len(p) ** 2 / k.sum()) and e.participation_ratio == pytest.approx(lam.sum() ** 2 / (lam**2).sum())
    tree, total, rest = {0}, 0.0, set(range(1, len(p)))
    while rest:
        d, j = min((dist[i, j], j) for i in tree for j in rest)
        total += d
        tree.add(j)
        rest.remove(j)
    assert coverage.mst_mean_edge(mine, names) == pytest.approx(total / (len(p) - 1))
    per = {r.axis: r for r in design.per_axis_metrics(df, names, rows).collect()}
    for i, a in enumerate(names):
        v = np.sort(p[:, i])
        n = len(v)
        assert per[a].ks_to_uniform == pytest.approx(max((np.arange(1, n + 1) / n - v).max(), (v - np.arange(n) / n).max()))
        assert per[a].star_1d == pytest.approx(l2(p[:, [i]]))
        assert per[a].max_gap == pytest.approx(np.diff([0, *v, 1]).max())
    q = design.coverage_qc(df, names, rows, 3, draws=30)
    assert set(q) == {"cdf", "abs"} and q["abs"]["selected_L2_star"] == pytest.approx(l2(p)) and 0 <= q["abs"]["percentile"] <= 100
    assert 0 <= design.coverage_report(df, names, rows, draws=40)["discrepancy_percentile"] <= 1


def test_selection_beats_random_and_compares(spark, pool):
    df, x, names, xs = pool
    t = design.compare_selectors(df, names, 24, (1, 2), {k: select.SELECTORS[k] for k in ("random", "lhs_nn")}).toPandas()
    assert len(t) == 4 and t.groupby("selector").tail_share_p90.mean()["lhs_nn"] > t.groupby("selector").tail_share_p90.mean()["random"]
    got = select.lhs_nearest(x, names, 24, 1)
    shares = select.snap_axis_shares(x, names, got)
    assert sum(shares.values()) == pytest.approx(1)
    assert select.distance_concentration(x, names, got.displacement, pairs=3000)["concentration_ratio"] < 1
    assert select.jaccard([1, 2], [2, 3]) == pytest.approx(1 / 3) and math.isnan(select.jaccard([], [])) and math.isnan(select.pairwise_jaccard([[1]]))


def test_comparison_plans_do_not_hold_the_pool(spark, pool, monkeypatch):
    """The figures of a selection are planned over its written rows; before, each held the pool's plan many times over (1 GB of plan texts at 3,000 rows)."""
    df, x, names, xs = pool
    made, sizes, plain = df.join(df.groupBy("row_ix").count(), "row_ix").select("row_ix", *names).persist(), [], coverage.star_discrepancy

    def planned(points, axes):
        out = plain(points, axes)
        sizes.append(len(out._jdf.queryExecution().toString()))
        return out

    monkeypatch.setattr(coverage, "star_discrepancy", planned)
    got = design.compare_selectors(made, names, 24, (1,), {"random": select.random_rows}).first()
    rows = select.random_rows(x, names, 24, 1).rows
    assert got.L2_star_abs == pytest.approx(l2(xs[rows])) and len(sizes) == 2 and max(sizes) < 40_000


def test_anchored_rules_with_equal_points(spark, monkeypatch):
    """Copies of points, taken apart in blocks of a few distances, are taken lowest row first."""
    monkeypatch.setattr(select, "HELD", 100)
    xs = np.tile(np.random.default_rng(8).random((30, 3)), (6, 1))
    x, names = frame(spark, xs)
    d2 = ((select.latin_hypercube(70, 3, 2)[:, None, :] - xs[None, :, :]) ** 2).sum(axis=2)
    used, want = set(), []
    for row in d2:
        want.append(next(int(j) for j in np.argsort(row, kind="stable") if int(j) not in used))
        used.add(want[-1])
    assert select.lhs_nearest(x, names, 70, 2).paired == want
    cost = [dict(enumerate(map(float, row))) for row in d2]
    got = select.lhs_assigned(x, names, 70, 2)
    assert len(set(got.rows)) == 70 and got.info["total"] == pytest.approx(sum(c[r] for c, r in zip(cost, select.assign(cost)[0], strict=True)), rel=1e-9)


def test_screening_drops_degenerate_and_duplicate_axes(spark):
    rng = np.random.default_rng(2)
    h = rng.gamma(2, 1, (500, 5))
    h = np.column_stack([h, np.exp(h[:, 0]) + 1e-9 * h[:, 1], np.full(500, 3.0)])
    names = ["drought_magnitude", "drought_duration", "flood_peak_discharge", "flood_pulse_duration", "flood_rise_rate", "drought_severity", "flat"]
    df, _ = frame(spark, h, names)
    s = screen.screen_axes(df, names)
    assert s.retained == names[:5] and s.dropped["flat"]["reason"] == "degenerate" and s.dropped["drought_severity"]["kept_member"] == "drought_magnitude"
    with pytest.raises(ValueError, match="3 are needed"):
        screen.screen_axes(df, ["drought_magnitude", "drought_severity", "flat", "drought_duration"])
    d = design.select_from_image(df, names, 24, 2, "abs", draws=30)
    assert d.axes == names[:5] and len(d.selection.rows) == 24 and d.coverage["abs"]["percentile"] < 50
    assert all(c["clipped_low_frac"] <= 0.02 and c["clipped_high_frac"] <= 0.02 for c in d.clipping.values())
    for bad in ({"selection_space": "rank"}, {"selection_space": "abs", "selection_axes": ["none"]}):
        with pytest.raises(ValueError):
            design.select_from_image(df, names, 5, 2, **bad)
    two = screen.redundant_pairs(df, ["drought_magnitude", "drought_severity"]).collect()
    assert len(two) == 1 and two[0].rho > 0.99
    groups = {tuple(m): r for m, r in screen.axis_clusters(df, names[:6], priority=["drought_severity"])}
    assert groups[("drought_magnitude", "drought_severity")] == "drought_severity" and len(groups) == 5
    e = screen.effective_dimension(df, names[:5])
    lam = np.linalg.eigvalsh(np.corrcoef(h[:, :5].T))
    assert e["participation_ratio"] == pytest.approx(lam.sum() ** 2 / (lam**2).sum()) and e["effective_dimension"] == 5


def test_spread_and_ranks(spark):
    df, names = frame(spark, np.array([[1.0, 2.0], [1.0, 5.0], [4.0, 5.0], [9.0, 5.0]]))
    r = {x.row_ix: (x.x0, x.x1) for x in normalize.cdf_normalize(df, names).collect()}
    assert r == {0: (0.375, 0.25), 1: (0.375, 0.75), 2: (0.75, 0.75), 3: (1.0, 0.75)}
    s = {x.axis: x for x in screen.axis_spread(df, names).collect()}
    assert s["x1"].iqr == pytest.approx(0.75) and s["x1"].modal_frac == 0.75 and not s["x0"].degenerate


def test_seeds():
    assert seeds.design_seed(1, "a") != seeds.design_seed(1, "b") and 0 <= seeds.design_seed(7, "fixed", 3) < 2**31 - 1
    assert len({seeds.design_seed(3, d, k) for d in seeds.SEED_DOMAINS for k in range(20)}) == 20 * len(seeds.SEED_DOMAINS) == 200
    a, b = seeds.child_seeds(5, 3), seeds.child_seeds(5, 9)
    assert all(x.generate_state(2).tolist() == y.generate_state(2).tolist() for x, y in zip(a, b, strict=False))
    x = select.latin_hypercube(4000, 3, 1)
    assert all(len(np.unique((x[:, i] * 4000).astype(int))) > 3960 for i in range(3))


def test_pair_statistics_of_large_selections(pool, monkeypatch):
    """Above the size that is broadcast no selection is refused, and the figures are the same."""
    df, x, names, xs = pool
    mine = x.filter("row_ix % 4 = 0").persist()

    def figures():
        e = coverage.effective_sample_size(mine, names).first()
        return [coverage.star_discrepancy(mine, names).first().l2_star, *coverage.nearest_summary(mine, names).first(), e.ess, e.participation_ratio, *(v for edge in sorted(map(tuple, coverage.spanning_tree(mine, names).collect())) for v in edge)]

    want = figures()
    monkeypatch.setattr(coverage, "MAX_SELECTION", 10)
    assert figures() == pytest.approx(want, rel=1e-12)
    assert want[0] == pytest.approx(l2(xs[::4]), rel=1e-12)
