"""The standardized streamflow index: rolling totals, one gamma law a calendar month, normal scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.special import gamma_score, gamma_shape
from .quantiles import exact_percentiles

TIMESCALE = 6


def accumulate(monthly: DataFrame, timescale: int = TIMESCALE) -> DataFrame:
    """Adds ``total``: the trailing sum over ``timescale`` months of (``scenario_id, pos, month, flow``); null before it is full."""
    w = Window.partitionBy("scenario_id").orderBy("pos").rowsBetween(1 - timescale, 0)
    return monthly.withColumn("total", F.when(F.count("flow").over(w) == timescale, F.sum("flow").over(w)))


def fit_months(reference: DataFrame, timescale: int = TIMESCALE) -> DataFrame:
    """Gamma ``shape`` and ``scale`` for each calendar month of the reference totals; twelve rows.

    Totals must be positive. The sums are one distributed aggregate; only twelve pairs of means reach the driver.
    """
    totals = accumulate(reference, timescale).filter("total is not null").withColumn("cal_month", F.month("month"))
    positive = F.when(F.col("total") > 0, F.col("total")).otherwise(F.raise_error(F.lit("a gamma fit needs positive totals")))
    rows = totals.withColumn("total", positive).groupBy("cal_month").agg(F.avg("total").alias("mean"), F.avg(F.ln("total")).alias("mean_log")).collect()
    fits = [(r.cal_month, shape := gamma_shape(r["mean"], r.mean_log), r["mean"] / shape) for r in rows]
    return reference.sparkSession.createDataFrame(fits, "cal_month int, shape double, scale double")


def standardize(monthly: DataFrame, fits: DataFrame, timescale: int = TIMESCALE) -> DataFrame:
    """Adds ``z`` to (``scenario_id, pos, month, flow``): the normal score of each total under its calendar month's law."""
    totals = accumulate(monthly, timescale).withColumn("cal_month", F.month("month"))
    return totals.join(F.broadcast(fits), "cal_month").withColumn("z", F.when(F.col("total").isNotNull(), gamma_score("total", "shape", "scale"))).drop("shape", "scale", "cal_month")


def scored_index(monthly: DataFrame, fits: DataFrame, timescale: int = TIMESCALE) -> DataFrame:
    """``scenario_id, pos, month, z, z_pre`` of the months after the first ``timescale``; positions restart at 0."""
    w = Window.partitionBy("scenario_id").orderBy("pos")
    before = standardize(monthly, fits, timescale).withColumn("__pre", F.lag("z").over(w))
    kept = before.filter(F.col("pos") >= timescale)
    pre = F.first("__pre", ignorenulls=False).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("z_pre", pre).select("scenario_id", (F.col("pos") - timescale).alias("pos"), "month", "z", "z_pre")


def reference_levels(daily: DataFrame, percentile: float = 95.0) -> tuple[float, float]:
    """(threshold, mean) of a reference record's daily flows."""
    whole = daily.select(F.lit("").alias("all"), "flow")
    q = exact_percentiles(whole, "all", "flow", (percentile / 100,)).first()
    return q.q[0], daily.agg(F.avg("flow")).first()[0]
