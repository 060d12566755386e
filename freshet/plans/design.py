"""From a candidate image to a checked selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coverage as C
from ..operators import normalize as N
from ..operators import select as S
from ..operators.screen import Screen, screen_axes
from ..sources.scratch import discard, stored

NULL_DRAWS = 100


def rows_frame(image: DataFrame, rows: Sequence[int]) -> DataFrame:
    return image.sparkSession.createDataFrame([(int(r),) for r in rows], "row_ix long")


def geometry(image: DataFrame, axes: Sequence[str], kind: str, lo: float = N.LO, hi: float = N.HI) -> DataFrame:
    if kind == "abs":
        return N.minmax_normalize(image, axes, lo, hi)
    if kind == "cdf":
        return N.cdf_normalize(image, axes)
    raise ValueError(f"unknown selection space: {kind!r}")


def draw_table(image: DataFrame, m: int, n: int, seeds: Sequence[int]) -> DataFrame:
    """(draw, row_ix): for each seed ``n`` of ``m`` rows without replacement."""
    rows = [(k, int(i)) for k, s in enumerate(seeds) for i in np.random.default_rng(s).choice(m, size=n, replace=False)]
    return image.sparkSession.createDataFrame(rows, "draw int, row_ix long")


def coverage_qc(image: DataFrame, axes: Sequence[str], rows: Sequence[int], seed: int, draws: int = NULL_DRAWS, lo: float = N.LO, hi: float = N.HI) -> dict[str, dict[str, float]]:
    """The selection's discrepancy among random subsets of its size, in both geometries; ``percentile`` is the share (%) of lower ones."""
    m, n = image.count(), len(rows)
    drawn = draw_table(image, m, n, [seed * 1000 + i for i in range(draws)]).persist()
    out = {}
    for kind in ("cdf", "abs"):
        x = geometry(image, axes, kind, lo, hi).persist()
        mine = C.star_discrepancy(x.join(F.broadcast(rows_frame(image, rows)), "row_ix", "left_semi"), axes).first().l2_star  # the selection
        null = np.array([r.l2_star for r in C.null_discrepancies(x, axes, drawn, n).collect()])
        out[kind] = {"selected_L2_star": mine, "null_mean": null.mean(), "null_std": null.std(), "null_min": null.min(), "null_max": null.max(), "percentile": float((null < mine).mean() * 100)}
        x.unpersist()
    drawn.unpersist()
    return out


def coverage_report(image: DataFrame, axes: Sequence[str], rows: Sequence[int], draws: int = 500, seed: int = 0) -> dict[str, float]:
    """Coverage in rank space; ``discrepancy_percentile`` is the share of random subsets not above the selection. One generator serves all draws."""
    x = geometry(image, axes, "cdf").persist()
    m, n = image.count(), len(rows)
    rng = np.random.default_rng(seed)
    drawn = image.sparkSession.createDataFrame([(k, int(i)) for k in range(draws) for i in rng.choice(m, size=n, replace=False)], "draw int, row_ix long")
    mine = x.join(F.broadcast(rows_frame(image, rows)), "row_ix", "left_semi").persist()
    l2 = C.star_discrepancy(mine, axes).first().l2_star
    null = np.array([r.l2_star for r in C.null_discrepancies(x, axes, drawn, n).collect()])
    near = C.nearest_summary(mine, axes).first().asDict()
    return {"n": n, "m": len(axes), "l2_star": l2, **{k: near[k] or 0.0 for k in ("nn_min", "nn_mean", "nn_cv")}, "mst_mean": C.mst_mean_edge(mine, axes), "random_l2_mean": null.mean(), "random_l2_std": null.std(), "discrepancy_percentile": float((null <= l2).mean())}


@dataclass(frozen=True)
class Design:
    screen: Screen
    axes: list[str]
    selection: S.Selection
    coverage: dict
    clipping: dict
    face_share: float


def select_from_image(image: DataFrame, axes: Sequence[str], n: int, seed: int, selection_space: str, selection_axes: Sequence[str] | None = None, draws: int = NULL_DRAWS, lo: float = N.LO, hi: float = N.HI) -> Design:
    """Restrict, screen, select, and check an image with ``row_ix`` 0 to m - 1."""
    if selection_space not in ("abs", "cdf"):
        raise ValueError(f"unknown selection space: {selection_space!r}")
    if selection_axes is not None:
        if unknown := set(selection_axes) - set(axes):
            raise ValueError(f"unknown axes: {sorted(unknown)}")
        axes = [a for a in axes if a in selection_axes]
    image = image.select("row_ix", *axes).persist()
    screen = screen_axes(image, axes)
    kept = screen.retained
    x = geometry(image, kept, selection_space, lo, hi).persist()
    chosen = S.lhs_nearest(x, kept, n, seed)
    clip = {r.axis: {"lo": r.lo, "hi": r.hi, "clipped_low_frac": r.clipped_low, "clipped_high_frac": r.clipped_high} for r in N.clipping(image, kept, lo, hi).collect()}
    qc = coverage_qc(image, kept, chosen.rows, seed, draws, lo, hi)
    return Design(screen, kept, chosen, qc, clip, N.face_share(image, kept, rows_frame(image, chosen.rows), lo, hi))


def selection_metrics(image: DataFrame, axes: Sequence[str], rows: Sequence[int], lo: float = N.LO, hi: float = N.HI, spaces: tuple[DataFrame, DataFrame] | None = None) -> dict[str, float]:
    """Coverage, tail, distortion and zero-event figures of one selection; ``spaces`` are the image's two geometries (abs, cdf) where they are at hand.

    The selection's rows are written and read back, so the plans of the figures do not hold those of the pool.
    """
    mine = F.broadcast(rows_frame(image, rows))  # the selection
    xa, xc = (stored(x.join(mine, "row_ix", "left_semi"), "selected") for x in spaces or (geometry(image, axes, k, lo, hi) for k in ("abs", "cdf")))
    near = C.nearest_summary(xa, axes).first()
    mean = lambda df, c: df.agg(F.avg(c)).first()[0]
    out = {
        "L2_star_abs": C.star_discrepancy(xa, axes).first().l2_star, "L2_star_cdf": C.star_discrepancy(xc, axes).first().l2_star, "nn_min_abs": near.nn_min, "nn_cv_abs": near.nn_cv,
        "tail_share_p90": mean(C.tail_shares(image, rows_frame(image, rows), axes), "tail_share"), "corner_share_p90": C.corner_share(image, rows_frame(image, rows), axes).first().corner_share,
        "ks_mean_vs_pool": mean(C.ks_to_pool(image, rows_frame(image, rows), axes), "ks"), **C.tree_stats(xa, axes),
    }
    if dry := [a for a in axes if a.startswith("drought")]:
        zero = F.avg(F.forall(F.array(*dry), lambda v: v == 0.0).cast("double"))
        out["zero_event_share_selected"] = image.join(mine, "row_ix", "left_semi").agg(zero).first()[0]
        out["zero_event_share_pool"] = image.agg(zero).first()[0]
    discard(xa, xc)
    return out


def per_axis_metrics(image: DataFrame, axes: Sequence[str], rows: Sequence[int], lo: float = N.LO, hi: float = N.HI) -> DataFrame:
    """(axis, ks_to_uniform, star_1d, max_gap, tail_share)."""
    x = geometry(image, axes, "abs", lo, hi).join(F.broadcast(rows_frame(image, rows)), "row_ix", "left_semi")
    return C.ks_to_uniform(x, axes).join(C.star_by_axis(x, axes), "axis").join(C.marginal_gaps(x, axes), "axis").join(C.tail_shares(image, rows_frame(image, rows), axes), "axis")


def compare_selectors(image: DataFrame, axes: Sequence[str], n: int, seeds: Sequence[int], selectors: Mapping | None = None, lo: float = N.LO, hi: float = N.HI) -> DataFrame:
    """One row a selector and seed with its metrics, and the mean pairwise Jaccard of a selector's rows over the seeds."""
    image = stored(image.select("row_ix", *axes), "pool")
    spaces = tuple(stored(geometry(image, axes, kind, lo, hi), "pool") for kind in ("abs", "cdf"))
    records = []
    for name, rule in (selectors or S.SELECTORS).items():
        picks = [rule(spaces[0], axes, n, s) for s in seeds]
        stable = S.pairwise_jaccard([p.rows for p in picks])
        records += [{"selector": name, "seed": s, "seed_jaccard": float(stable), **{k: float(v) for k, v in selection_metrics(image, axes, p.rows, lo, hi, spaces).items()}} for s, p in zip(seeds, picks, strict=True)]
    discard(image, *spaces)
    names = list(records[0])
    return image.sparkSession.createDataFrame([tuple(r[k] for k in names) for r in records], ", ".join(f"{k} {'string' if k == 'selector' else 'int' if k == 'seed' else 'double'}" for k in names))
