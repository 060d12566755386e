"""Persistence-tilted bootstrap of historical years."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

_PHI = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), otypes=[float])


def wetness_order(residuals: DataFrame) -> DataFrame:
    """(wet_rank, year) from (year, period, site, value), driest year first, ties to the earlier year."""
    mean = residuals.groupBy("year").agg(F.avg("value").alias("wetness"))
    return mean.withColumn("wet_rank", F.row_number().over(Window.orderBy("wetness", "year")) - 1).select("wet_rank", "year")  # one row a year


def bootstrap_matrix(years: int, periods: int, order: Sequence[int], phi: float, lam: float, rng: np.random.Generator) -> np.ndarray:
    """(years, periods) of historical years, each cell even over them; cells of a year share an AR(1) state with loading ``lam``."""
    if not 0 <= phi < 1:
        raise ValueError("phi must be in [0, 1)")
    if not 0 <= lam <= 1:
        raise ValueError("lam must be in [0, 1]")
    state = np.empty(years)
    state[0] = rng.standard_normal()
    shocks = math.sqrt(1 - phi * phi) * rng.standard_normal(max(years - 1, 0))
    for t, shock in enumerate(shocks, 1):
        state[t] = phi * state[t - 1] + shock
    cells = math.sqrt(lam) * state[:, None] + math.sqrt(1 - lam) * rng.standard_normal((years, periods))
    n = len(order)
    return np.asarray(order)[np.minimum((_PHI(cells) * n).astype(int), n - 1)]


def bootstrap(spark: SparkSession, order: Sequence[int], realizations: int, years: int, periods: int, phi: float, lam: float, seed: int) -> DataFrame:
    """(realization, year, period, source_year): one matrix a realization, seeded by (seed, realization) and so the same on any executor."""
    schema = "realization long, year int, period int, source_year int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b["id"]:
                m = bootstrap_matrix(years, periods, order, phi, lam, np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(int(r),))))
                y, p = np.indices(m.shape)
                yield pd.DataFrame({"realization": r, "year": y.ravel(), "period": p.ravel(), "source_year": m.ravel()}).astype({"year": "int32", "period": "int32", "source_year": "int32"})

    return spark.range(realizations).mapInPandas(run, schema)
