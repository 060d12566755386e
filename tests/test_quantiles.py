import random

import pytest
from pyspark.sql import functions as F

from freshet.operators import quantiles


@pytest.mark.parametrize("n", [1, 2, 3, 102, 1999, 2000, 2001, 50_001])
def test_equal_sorting(spark, n):
    """Linear percentiles of groups with ties, many zeros and nulls, small and large beside each other."""
    rng = random.Random(n)
    values = [0.0 if rng.random() < 0.3 else round(rng.gauss(0, 5), 3) for _ in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("b", 4.0), ("b", 1.0)], "g string, v double").repartition(5)
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.8, 0.95, 0.99, 1.0)
    got = {r.g: r.q for r in quantiles.exact_percentiles(df, "g", "v", probs).collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-12, abs=1e-12) for g in got)
