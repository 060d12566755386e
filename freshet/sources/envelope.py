"""Climate-change envelopes: monthly factors of many model runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.calendars import water_position

#: Run names of future scenarios, the baseline period, the tail that tells runs of one model apart.
FUTURE, BASELINE, SIBLING = r"(?i)ssp\d", "1980_2019", r"(?i)_ssp\d+_.*"
SANE = (0.2, 5.0)


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    """(run, col, month, factor) from a CSV with a ``month`` column and one column per run."""
    wide = spark.read.csv(path, header=True, inferSchema=True)
    runs = [c for c in wide.columns if c != "month"]
    order = F.create_map(*(x for i, c in enumerate(runs) for x in (F.lit(c), F.lit(i))))
    long = wide.unpivot(["month"], runs, "run", "factor")
    return long.select("run", order[F.col("run")].alias("col"), F.col("month").cast("int").alias("month"), F.col("factor").cast("double").alias("factor"))


def load_envelope(factors: DataFrame, include_baseline: bool = False) -> DataFrame:
    """Future runs in water-year order (``water_pos`` 0 to 11). No run, or an overall mean outside ``SANE``, is an error."""
    kept = factors.filter(F.col("run").rlike(FUTURE))
    if not include_baseline:
        kept = kept.filter(~F.col("run").contains(BASELINE))
    n, mean = kept.agg(F.count("*"), F.avg("factor")).first()
    if not n:
        raise ValueError("the envelope has no future run")
    if not SANE[0] < mean < SANE[1]:
        raise ValueError(f"the envelope's mean factor {mean} is not plausible")
    return kept.withColumn("water_pos", water_position(F.col("month")))


def variance_envelope(mean: DataFrame, sd: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """(run, month, factor): each future run's coefficient of variation over that of its model's baseline run.

    Runs are paired with the baseline of the same model; a model's last baseline column wins; runs without one are left out.
    """
    both = mean.join(sd.select("run", "month", F.col("factor").alias("sd")), ["run", "month"]).filter(F.col("run").rlike(FUTURE))
    both = both.withColumn("model", F.regexp_replace("run", SIBLING, "")).withColumn("cv", F.col("sd") / F.col("factor"))
    w = Window.partitionBy("model", "month").orderBy(F.desc("col"))
    base = both.filter(F.col("run").contains(baseline)).withColumn("k", F.row_number().over(w)).filter("k = 1").select("model", "month", F.col("cv").alias("base_cv"))
    return both.filter(~F.col("run").contains(baseline)).join(base, ["model", "month"]).select("run", "month", (F.col("cv") / F.col("base_cv")).alias("factor"))
