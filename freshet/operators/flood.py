"""Peaks over a threshold and flow-regime statistics of daily series (``scenario_id, pos, flow``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .runs import number_runs


def pulses(daily: DataFrame, threshold: float) -> DataFrame:
    """Every run strictly above ``threshold``: first and last position, highest flow and its first position, days, volume above."""
    above = number_runs(daily.filter(F.col("flow") > threshold), "pulse")
    top = F.max(F.struct("flow", (-F.col("pos")).alias("back")))
    runs = above.groupBy("scenario_id", "pulse").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), top.alias("top"), F.count("*").alias("days"), F.sum(F.col("flow") - threshold).alias("volume"))
    return runs.select("scenario_id", "pulse", "lo", "hi", F.col("top.flow").alias("peak"), (-F.col("top.back")).alias("peak_pos"), "days", "volume")


def critical_pulse(found: DataFrame) -> DataFrame:
    """The pulse with the highest flow of each scenario, the earliest on a tie."""
    w = Window.partitionBy("scenario_id").orderBy(F.desc("peak"), "peak_pos")
    return found.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def flood_descriptors(daily: DataFrame, threshold: float, ref_mean: float) -> DataFrame:
    """Six flood columns for every scenario; only the peak is defined where nothing exceeds the threshold."""
    unit = ref_mean if ref_mean > 0 else 1.0
    found = pulses(daily, threshold)
    totals = found.groupBy("scenario_id").agg(F.count("*").alias("pulse_count"), F.sum("days").alias("days_above"))
    crit = critical_pulse(found)
    step = F.col("flow") - F.lag("flow").over(Window.partitionBy("scenario_id").orderBy("pos"))
    limb = daily.withColumn("step", step).join(crit.select("scenario_id", "lo", "peak_pos"), "scenario_id").filter("pos between lo and peak_pos")
    rise = limb.groupBy("scenario_id").agg(F.greatest(F.max("step"), F.lit(0.0)).alias("rise"))
    peaks = daily.groupBy("scenario_id").agg(F.max("flow").alias("top"))
    one = peaks.join(crit, "scenario_id", "left").join(totals, "scenario_id", "left").join(rise, "scenario_id", "left")
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return one.select(
        "scenario_id", (F.col("top") / unit).alias("flood_peak_discharge"), number("days").alias("flood_pulse_duration"), (number("rise") / unit).alias("flood_rise_rate"),
        number("pulse_count").alias("flood_pulse_count"), number("days_above").alias("flood_days_above"), (number("volume") / unit).alias("flood_pulse_volume"),
    )


def regime_descriptors(daily: DataFrame, ref_mean: float) -> DataFrame:
    """Eight regime columns of ``scenario_id, pos, month_ix, flow``, whose months count from the window's start without gaps.

    Monthly means weigh days; years are blocks of twelve months from the start, a part of a year at the end is dropped.
    """
    unit = ref_mean if ref_mean > 0 else 1.0
    series = Window.partitionBy("scenario_id").orderBy("pos")
    mean = lambda k: F.when(F.count("flow").over(series.rowsBetween(1 - k, 0)) == k, F.avg("flow").over(series.rowsBetween(1 - k, 0)))
    days = daily.withColumn("m7", mean(7)).withColumn("m3", mean(3)).withColumn("step", F.abs(F.col("flow") - F.lag("flow").over(series)))
    short = days.groupBy("scenario_id").agg(F.min("m7").alias("low7"), F.max("m3").alias("high3"), (F.sum("step") / F.sum("flow")).alias("flashiness"))
    months = daily.groupBy("scenario_id", "month_ix").agg(F.sum("flow").alias("volume"), F.count("*").alias("days"))
    line = Window.partitionBy("scenario_id").orderBy("month_ix")
    run = lambda k: F.when(F.count("*").over(line.rowsBetween(1 - k, 0)) == k, F.sum("volume").over(line.rowsBetween(1 - k, 0)) / F.sum("days").over(line.rowsBetween(1 - k, 0)))
    rolled = months.withColumn("m12", run(12)).withColumn("m24", run(24))
    year = F.when((F.col("month_ix") + 1) % 12 == 0, F.col("m12"))
    enough = F.when(F.count("*") >= 24, F.min("m12")).otherwise(F.raise_error(F.lit("a flow regime needs at least 24 months")))
    long = rolled.groupBy("scenario_id").agg(enough.alias("low12"), F.min("m24").alias("low24"), F.min(year).alias("low_year"), F.max(year).alias("high_year"), (F.stddev_samp(year) / F.avg(year)).alias("annual_cv"))
    return long.join(short, "scenario_id").select(
        "scenario_id", (F.col("low12") / unit).alias("lowflow_min_12month"), (F.col("low24") / unit).alias("lowflow_min_24month"), (F.col("low_year") / unit).alias("lowflow_min_year"), (F.col("low7") / unit).alias("lowflow_min_7day"),
        (F.col("high3") / unit).alias("flood_max_3day"), (F.col("high_year") / unit).alias("highflow_max_year"), "annual_cv", "flashiness",
    )
