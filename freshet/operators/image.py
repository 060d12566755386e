"""The hazard image: one row of descriptors for each scenario."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flood import flood_descriptors, regime_descriptors
from .runs import END_THRESHOLD, drought_descriptors
from .ssi import TIMESCALE, fit_months, reference_levels, scored_index

#: The column contract, dry to wet, then the supplement.
AXES = ("drought_magnitude", "drought_duration", "drought_severity", "drought_development_rate", "drought_termination_rate", "flood_peak_discharge", "flood_pulse_duration", "flood_rise_rate")
SUPPLEMENT = (
    "drought_onset_truncated", "drought_termination_truncated", "drought_event_count", "drought_total_deficit", "lowflow_min_12month", "lowflow_min_24month", "lowflow_min_year", "lowflow_min_7day",
    "flood_pulse_count", "flood_days_above", "flood_max_3day", "flood_pulse_volume", "highflow_max_year", "annual_cv", "flashiness",
)


@dataclass(frozen=True)
class Reference:
    """What scoring needs from a reference record: twelve gamma laws, the flood threshold, the mean flow."""

    fits: DataFrame
    threshold: float
    mean: float


def fit_reference(monthly: DataFrame, daily: DataFrame, timescale: int = TIMESCALE, percentile: float = 95.0) -> Reference:
    threshold, mean = reference_levels(daily, percentile)
    return Reference(fit_months(monthly, timescale), threshold, mean)


def hazard_image(monthly: DataFrame, daily: DataFrame, reference: Reference, wet_exclusion_days: int = 0, supplement: bool = False, rule: str = "controlling", end_threshold: int = END_THRESHOLD, timescale: int = TIMESCALE) -> DataFrame:
    """``scenario_id``, the eight axes and, if asked, the fifteen supplement columns.

    ``monthly`` is (scenario_id, pos, month, flow), ``daily`` (scenario_id, pos, month_ix, flow), both dense from 0.
    Days before ``wet_exclusion_days`` and months before ``timescale`` are not scored. A scenario must stand in both
    inputs; one that does not is an error. Every part is partitioned by ``scenario_id``, which the joins reuse.
    """
    if wet_exclusion_days < 0:
        raise ValueError("wet_exclusion_days must not be negative")
    dry = drought_descriptors(scored_index(monthly, reference.fits, timescale), rule, end_threshold)
    first = timescale if wet_exclusion_days else 0
    wet_days = daily.filter(F.col("pos") >= wet_exclusion_days).withColumn("pos", F.col("pos") - wet_exclusion_days)
    wet = flood_descriptors(wet_days, reference.threshold, reference.mean)
    both = dry.withColumn("__dry", F.lit(1)).join(wet.withColumn("__wet", F.lit(1)), "scenario_id", "full")
    whole = F.when(F.col("__dry").isNull() | F.col("__wet").isNull(), F.raise_error(F.lit("a scenario lacks its monthly or daily flows"))).otherwise(F.col("scenario_id"))
    both = both.withColumn("scenario_id", whole)
    if supplement:
        both = both.join(regime_descriptors(wet_days.withColumn("month_ix", F.col("month_ix") - first), reference.mean), "scenario_id")
    return both.select("scenario_id", *AXES, *(SUPPLEMENT if supplement else ()))
