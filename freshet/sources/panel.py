"""Dense daily and monthly panels from dated records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_number(day: Column, start: dt.date) -> Column:
    return (F.year(day) - start.year) * 12 + F.month(day) - start.month


def dense_days(records: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """(scenario_id, pos, month_ix, day, flow) for every scenario and day from ``start`` to before ``end``; absent days have flow 0.

    ``records`` is (scenario_id, day, flow), several rows a day are added up. Zeros for all days of the window are
    added to the records and summed with them. Both are dealt by scenario once, and that serves the sum and every later window over a scenario.
    """
    inside = records.filter((F.col("day") >= F.lit(start)) & (F.col("day") < F.lit(end)))
    seen = inside.select("scenario_id", F.datediff("day", F.lit(start)).alias("pos"), "flow")
    spine = inside.select("scenario_id").distinct().select("scenario_id", F.explode(F.sequence(F.lit(0), F.lit((end - start).days - 1))).alias("pos"), F.lit(0.0).alias("flow"))
    days = seen.union(spine).repartition("scenario_id").groupBy("scenario_id", "pos").agg(F.sum("flow").alias("flow"))
    day = F.date_add(F.lit(start), F.col("pos"))
    return days.select("scenario_id", "pos", month_number(day, start).alias("month_ix"), day.alias("day"), "flow")


def daily_to_monthly(daily: DataFrame, how: str = "mean") -> DataFrame:
    """(scenario_id, pos, month, flow) from a dense daily panel; ``how`` is a Spark aggregate such as mean, sum, max."""
    agg = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "median": F.median}[how]
    return daily.groupBy("scenario_id", F.col("month_ix").alias("pos")).agg(F.trunc(F.min("day"), "month").alias("month"), agg("flow").alias("flow"))


def resample_months(daily: DataFrame, how: str = "mean") -> DataFrame:
    """(scenario_id, month, flow) over every month between a scenario's first and last day, empty months included.

    An empty month has flow 0 for ``sum`` and null otherwise.
    """
    agg = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "median": F.median}[how]
    have = daily.groupBy("scenario_id", F.trunc("day", "month").alias("month")).agg(agg("flow").alias("flow"))
    span = have.groupBy("scenario_id").agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    full = span.join(have, ["scenario_id", "month"], "left")
    return full.withColumn("flow", F.coalesce("flow", F.lit(0.0))) if how == "sum" else full


def positions(series: DataFrame, start: dt.date) -> DataFrame:
    """Adds ``pos`` to (scenario_id, month, flow): months since ``start``."""
    return series.withColumn("pos", month_number(F.col("month"), start))
