"""Runs of consecutive positions, by gaps and islands over one partitioning of the series.

A series is a frame with ``scenario_id``, a dense position ``pos`` and a value. Only rows that belong to a run are
numbered, so each function costs one shuffle by ``scenario_id`` however many windows it uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

QUALIFY, END_THRESHOLD = -1.0, 3


def number_runs(members: DataFrame, name: str, bridge: int = 1) -> DataFrame:
    """Adds ``name``: rows of a scenario share it while fewer than ``bridge`` positions are missing between them."""
    w = Window.partitionBy("scenario_id").orderBy("pos")
    opens = F.coalesce((F.col("pos") - F.lag("pos").over(w) > bridge).cast("int"), F.lit(1))
    return members.withColumn("__opens", opens).withColumn(name, F.sum("__opens").over(w)).drop("__opens")


def defined(value: Column, what: str) -> Column:
    return F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit(f"{what} is undefined"))).otherwise(value)


def drought_events(index: DataFrame, end_threshold: int = END_THRESHOLD) -> DataFrame:
    """Qualifying events of a standardized index (``scenario_id, pos, z``).

    Spells are maximal runs below zero; spells fewer than ``end_threshold`` positions apart form a cluster. The event of a
    cluster is every spell from the first one that reaches ``QUALIFY`` on; a cluster without one has no event.
    """
    below = index.withColumn("z", defined(F.col("z"), "a standardized index")).filter("z < 0")
    marked = number_runs(number_runs(below, "spell"), "cluster", end_threshold)
    lowest = F.min("z").over(Window.partitionBy("scenario_id", "spell"))
    marked = marked.withColumn("__reached", F.when(lowest <= QUALIFY, F.col("spell")))
    first = F.min("__reached").over(Window.partitionBy("scenario_id", "cluster"))
    event = marked.withColumn("__first", first).filter("spell >= __first")
    return event.groupBy("scenario_id", "cluster").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.min_by("pos", F.struct("z", "pos")).alias("peak"), F.count("*").alias("duration"), F.abs(F.sum("z")).alias("magnitude"), F.abs(F.min("z")).alias("severity"),
        F.min_by("z", "pos").alias("z_start"), F.max_by("z", "pos").alias("z_end"),
    )


def select_event(events: DataFrame, rule: str = "controlling") -> DataFrame:
    """One event a scenario: largest magnitude, largest severity, or the first; the earliest on a tie."""
    if rule not in ("controlling", "deepest", "first"):
        raise ValueError(f"unknown event rule: {rule!r}")
    order = {"controlling": [F.desc("magnitude")], "deepest": [F.desc("severity")], "first": []}[rule]
    w = Window.partitionBy("scenario_id").orderBy(*order, F.asc("start"))
    return events.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def drought_descriptors(index: DataFrame, rule: str = "controlling", end_threshold: int = END_THRESHOLD) -> DataFrame:
    """Nine drought columns for every scenario of ``index`` (``scenario_id, pos, z, z_pre``); zeros where no event qualifies.

    ``z_pre`` is the index one position before the first, null if undefined. An onset at the first position is truncated
    unless ``z_pre`` is zero or more; an end at the last position always is. A truncated phase has the rate observed
    inside the window, 0 if its peak is on the edge.
    """
    shape = index.groupBy("scenario_id").agg((F.max("pos") + 1).alias("n"), F.first("z_pre").alias("z_pre"))
    events = drought_events(index, end_threshold)
    totals = events.groupBy("scenario_id").agg(F.count("*").alias("event_count"), F.sum("magnitude").alias("total_deficit"))
    one = shape.join(select_event(events, rule), "scenario_id", "left").join(totals, "scenario_id", "left")
    s, e, p = F.col("start"), F.col("end"), F.col("peak")
    known_wet = F.coalesce(F.col("z_pre") >= 0, F.lit(False)) & ~F.coalesce(F.isnan("z_pre"), F.lit(False))
    onset_cut, end_cut = (s == 0) & ~known_wet, e == F.col("n") - 1
    low = -F.col("severity")
    development = F.when(onset_cut, F.when(p == s, 0.0).otherwise((F.col("z_start") - low) / (p - s))).otherwise(F.col("severity") / (p - s + 1))
    termination = F.when(end_cut, F.when(p == e, 0.0).otherwise((F.col("z_end") - low) / (e - p))).otherwise(F.col("severity") / (e - p + 1))
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return one.select(
        "scenario_id", number(F.col("magnitude")).alias("drought_magnitude"), number(F.col("duration")).alias("drought_duration"), number(F.col("severity")).alias("drought_severity"),
        number(development).alias("drought_development_rate"), number(termination).alias("drought_termination_rate"), number(onset_cut).alias("drought_onset_truncated"), number(end_cut).alias("drought_termination_truncated"),
        number(F.col("event_count")).alias("drought_event_count"), number(F.col("total_deficit")).alias("drought_total_deficit"),
    )
