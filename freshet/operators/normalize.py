"""Unit-box coordinates of an image, and what clipping does to it.

An image here has ``row_ix`` and one double column per axis. Statistics over the whole pool are computed axis by axis
in one grouped pass over the unpivoted image, so the axes run in parallel and no window lacks a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import in_order
from .quantiles import exact_percentiles

LO, HI = 1.0, 99.0


def long_form(image: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(row_ix, axis, value)."""
    return image.select("row_ix", *axes).unpivot(["row_ix"], list(axes), "axis", "value")


def wide_form(long: DataFrame, axes: Sequence[str], value: str = "x") -> DataFrame:
    return long.groupBy("row_ix").agg(*(F.max(F.when(F.col("axis") == a, F.col(value))).alias(a) for a in axes))


def bounds(image: DataFrame, axes: Sequence[str], lo: float = LO, hi: float = HI) -> DataFrame:
    """(axis, lo, hi): linear percentiles; an axis without range gets one of 1e-12."""
    q = exact_percentiles(long_form(image, axes), "axis", "value", (lo / 100, hi / 100))
    return q.select("axis", F.col("q")[0].alias("lo"), F.when(F.col("q")[1] <= F.col("q")[0], F.col("q")[0] + 1e-12).otherwise(F.col("q")[1]).alias("hi"))


def minmax_normalize(image: DataFrame, axes: Sequence[str], lo: float = LO, hi: float = HI) -> DataFrame:
    """``row_ix`` and every axis scaled by its bounds and clipped to [0, 1]; the bounds are one broadcast row."""
    b = bounds(image, axes, lo, hi).groupBy().agg(*(F.max(F.when(F.col("axis") == a, F.struct("lo", "hi"))).alias(f"__{i}") for i, a in enumerate(axes)))
    wide = image.crossJoin(F.broadcast(b))  # one row
    return wide.select("row_ix", *(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(a) - F.col(f"__{i}.lo")) / (F.col(f"__{i}.hi") - F.col(f"__{i}.lo")))).alias(a) for i, a in enumerate(axes)))


def average_ranks(image: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(row_ix, axis, value, r): ranks from 1, ties sharing their mean.

    Ranks come from counts per distinct value, so a large group of equal values (the zero atom of the drought axes) is a single row,
    and from prefix sums of the counts over sampled ranges, so no axis is sorted in one task. Null values have no rank.
    """
    long = long_form(image, axes)
    ranks = value_counts(long).select("axis", "value", (F.col("n_upto") - (F.col("n") - 1) / 2.0).alias("r"))
    return long.join(ranks, ["axis", "value"])


def value_counts(long: DataFrame, *sums: Column) -> DataFrame:
    """(axis, value, n, n_upto, n_all, previous, next): each distinct value with its rows, those up to it, and its neighbours; likewise for the aggregates ``sums``."""
    counts = long.filter(F.col("value").isNotNull()).groupBy("axis", "value").agg(F.count("*").alias("n"), *sums)
    return in_order(counts, ["axis"], "value", [c for c in counts.columns if c not in ("axis", "value")])


def cdf_normalize(image: DataFrame, axes: Sequence[str]) -> DataFrame:
    """``row_ix`` and every axis as average rank over the number of rows."""
    n = image.select(F.count("*").alias("__n"))
    ranked = average_ranks(image, axes).crossJoin(F.broadcast(n))  # one row
    return wide_form(ranked.withColumn("x", F.col("r") / F.col("__n")), axes)


def clipping(image: DataFrame, axes: Sequence[str], lo: float = LO, hi: float = HI) -> DataFrame:
    """(axis, lo, hi, clipped_low, clipped_high): bounds and the shares strictly outside."""
    both = long_form(image, axes).join(F.broadcast(bounds(image, axes, lo, hi)), "axis")  # one row per axis
    return both.groupBy("axis").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.avg((F.col("value") < F.col("lo")).cast("double")).alias("clipped_low"), F.avg((F.col("value") > F.col("hi")).cast("double")).alias("clipped_high"))


def face_share(image: DataFrame, axes: Sequence[str], selected: DataFrame, lo: float = LO, hi: float = HI) -> float:
    """Share of ``selected`` (``row_ix``) strictly outside the bounds on at least one axis."""
    both = long_form(image.join(selected, "row_ix", "left_semi"), axes).join(F.broadcast(bounds(image, axes, lo, hi)), "axis")
    out = both.groupBy("row_ix").agg(F.max(((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).cast("double")).alias("out"))
    return out.agg(F.avg("out")).first()[0]
