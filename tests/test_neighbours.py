import math
import random

import pytest

from freshet.operators import neighbours as N


def clouds(kind, n, seed, d=3):
    rng = random.Random(seed)
    u = lambda: [rng.random() for _ in range(d)]
    if kind == "even":
        return [u() for _ in range(n)]
    if kind == "repeats":
        return [[round(x, 1) for x in u()] for _ in range(n)]
    if kind == "faces":
        return [[min(1.0, max(0.0, 2 * x - 0.5)) for x in u()] for _ in range(n)]
    if kind == "dense":  # half of them within a millionth, one of each pair beside it
        return [[0.4 + x * 1e-6 for x in u()] if i % 2 else u() for i in range(n)]
    if kind == "line":
        return [[i * i / n**2] + [0.25] * (d - 1) for i in range(n)]
    return [[0.5] * d for _ in range(n)]


def frame(spark, pts):
    axes = [f"x{k}" for k in range(len(pts[0]))] if pts else ["x0"]
    return axes, spark.createDataFrame([(7 * i + 3, *p) for i, p in enumerate(pts)], "row_ix long, " + ", ".join(f"{a} double" for a in axes))


def d2(p, q):
    return sum((a - b) * (a - b) for a, b in zip(p, q, strict=True))


@pytest.mark.parametrize("kind,n,d", [("even", 300, 3), ("repeats", 200, 3), ("faces", 300, 3), ("dense", 200, 3), ("line", 100, 2), ("same", 5, 3), ("even", 150, 6), ("even", 80, 1), ("even", 2, 3), ("even", 1, 2)])
def test_nearest_equal_all_pairs(spark, kind, n, d):
    pts = clouds(kind, n, n + d, d)
    axes, df = frame(spark, pts)
    want = {7 * i + 3: math.sqrt(min(d2(p, q) for j, q in enumerate(pts) if j != i)) for i, p in enumerate(pts)} if n > 1 else {}
    got = {r.row_ix: r.nn for r in N.nearest_distances(df, axes).collect()}
    assert got == pytest.approx(want, rel=1e-12, abs=0)


def test_pairs_grow_with_the_points(spark):
    """All pairs grow by 16 where the points grow by 4."""
    for kind in ("even", "faces", "dense"):
        made = []
        for n in (2000, 8000):
            axes, df = frame(spark, clouds(kind, n, 5))
            made.append(N.neighbour_pairs(df, axes)[2].count())
        assert made[1] < 100 * 8000 and made[1] < 6 * made[0], (kind, made)


def kruskal(pts):
    first = {}
    for i, p in enumerate(pts):
        first.setdefault(tuple(p), i)
    ids = sorted(first.values())
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    out = []
    for w, i, j in sorted((d2(pts[i], pts[j]), i, j) for i in ids for j in ids if i < j):
        a, b = root(i), root(j)
        if a != b:
            up[a] = b
            out.append((7 * i + 3, 7 * j + 3, math.sqrt(w)))
    return sorted(out)


@pytest.mark.parametrize("kind,n,d", [("even", 120, 3), ("repeats", 60, 3), ("dense", 60, 2), ("line", 40, 2), ("same", 4, 3)])
def test_tree_equals_kruskal(spark, kind, n, d):
    pts = clouds(kind, n, n * d, d)
    axes, df = frame(spark, pts)
    got = sorted(map(tuple, N.spanning_tree(df, axes).collect()))
    want = kruskal(pts)
    assert [x[:2] for x in got] == [x[:2] for x in want] if kind != "repeats" else len(got) == len(want)
    assert [x[2] for x in sorted(got, key=lambda r: r[2])] == pytest.approx([x[2] for x in sorted(want, key=lambda r: r[2])], rel=1e-12)


def test_rows_without_an_axis(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, 0.0, 0.0), (3, 0.0, 1.0)], "row_ix long, a double, b double")
    assert sorted(map(tuple, N.nearest_distances(df, ["a", "b"]).collect())) == [(2, 1.0), (3, 1.0)]
    assert [tuple(r) for r in N.spanning_tree(df, ["a", "b"]).collect()] == [(2, 3, 1.0)]
    assert N.nearest_distances(df.limit(0), ["a", "b"]).count() == 0 and N.spanning_tree(df.limit(0), ["a", "b"]).count() == 0
