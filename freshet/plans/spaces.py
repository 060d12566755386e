"""How the space in which a selection is drawn shapes it."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coverage as C
from ..operators import normalize as N
from ..operators import select as S
from ..operators.quantiles import exact_percentiles
from ..operators.screen import rank_correlations

TINY = 1e-12


def axis_profile(pool: DataFrame, selected: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(axis, ks, tail_share, median_ratio): distance of the distributions, share of the selection above the pool's ninetieth percentile, and the selection's median over the pool's (plus ``TINY``)."""
    mine = pool.join(selected, "row_ix", "left_semi")
    median = lambda df, name: exact_percentiles(N.long_form(df, axes), "axis", "value", (0.5,)).select("axis", F.col("q")[0].alias(name))
    both = median(mine, "mine").join(median(pool, "all"), "axis").select("axis", (F.col("mine") / (F.col("all") + TINY)).alias("median_ratio"))
    return C.ks_to_pool(pool, selected, axes).join(C.tail_shares(pool, selected, axes), "axis").join(both, "axis")


def mean_abs_correlation(image: DataFrame, axes: Sequence[str]) -> DataFrame:
    """One row ``mean_abs_rho``: the mean size of the rank correlations of all pairs of axes."""
    return rank_correlations(image, axes).agg(F.avg(F.abs("rho")).alias("mean_abs_rho"))


def characterize(pool: DataFrame, selected: DataFrame, axes: Sequence[str]) -> dict:
    """Figures of one selection (``row_ix``): by axis, their means, corner share, spacing and discrepancy in both geometries, and mean rank correlation. A row an axis reaches the driver."""
    rows = axis_profile(pool, selected, axes).collect()
    mean = lambda c: sum(r[c] for r in rows) / len(rows)
    xa = N.minmax_normalize(pool, axes).join(selected, "row_ix", "left_semi")
    xc = N.cdf_normalize(pool, axes).join(selected, "row_ix", "left_semi")
    near = C.nearest_summary(xa, axes).first()
    return {
        "per_axis": {r.axis: {"ks_vs_pool": r.ks, "tail_share_p90": r.tail_share, "median_ratio": r.median_ratio} for r in rows},
        "frac_in_any_p90_corner": C.corner_share(pool, selected, axes).first().corner_share, "mean_ks_vs_pool": mean("ks"), "mean_tail_share_p90": mean("tail_share"),
        "nn_min_abs": near.nn_min or 0.0, "nn_cv_abs": near.nn_cv or 0.0, "L2star_cdf_space": C.star_discrepancy(xc, axes).first().l2_star, "L2star_abs_space": C.star_discrepancy(xa, axes).first().l2_star,
        "mean_abs_spearman": mean_abs_correlation(pool.join(selected, "row_ix", "left_semi"), axes).first().mean_abs_rho,
    }


def compare_spaces(image: DataFrame, axes: Sequence[str], n: int, seed: int) -> dict:
    """The same rule in three spaces, clipped and full min-max coordinates and ranks: axes, sizes and a report each, ready for JSON. ``image`` has ``row_ix`` 0 to m - 1."""
    image = image.select("row_ix", *axes).persist()
    spaces = {"absolute": lambda: N.minmax_normalize(image, axes), "absolute_full": lambda: N.minmax_normalize(image, axes, 0.0, 100.0), "cdf": lambda: N.cdf_normalize(image, axes)}
    reports = {}
    for name, space in spaces.items():
        x = space().persist()
        chosen = image.sparkSession.createDataFrame([(int(r),) for r in S.lhs_nearest(x, axes, n, seed).rows], "row_ix long")
        reports[name] = characterize(image, chosen, axes)
        x.unpersist()
    out = {"axes": list(axes), "n": n, "M": image.count(), "reports": reports}
    image.unpersist()
    return out


def write_summary(spark, summary: dict, path: str) -> str:
    """One JSON text file below ``path``, which executors write, with sorted keys."""
    spark.createDataFrame([(json.dumps(summary, indent=2, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\0")
    return path
