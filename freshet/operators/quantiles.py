"""Exact percentiles of large groups without a group in one task.

A mergeable sketch first brackets each wanted rank; in a second pass all values below the bracket are one count, and only the
values inside it, a few thousandths of a group, are counted by value and ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Accuracy of the sketch: a rank is off by at most one in so many rows.
ACCURACY = 2000


def exact_percentiles(long: DataFrame, by: str, value: str, probs: Sequence[float]) -> DataFrame:
    """(``by``, q): the array of linear percentiles ``probs`` of ``value`` in each group, which are few; nulls do not count."""
    rows = long.filter(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("__v"))
    # a bracket reaches 4 / ACCURACY to both sides; in a group of fewer rows than ACCURACY it is the whole group
    ends = [min(1.0, max(0.0, p + s * 4 / ACCURACY)) for p in probs for s in (-1, 1)]
    sketch = rows.groupBy(by).agg(F.count("*").alias("__n"), F.percentile_approx("__v", ends, ACCURACY).alias("__e"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    few = F.col("__n") < ACCURACY
    marks = []
    for k in range(len(probs)):
        lo, hi = F.when(few, F.col("__min")).otherwise(F.col("__e")[2 * k]), F.when(few, F.col("__max")).otherwise(F.col("__e")[2 * k + 1])
        marks.append(F.when(F.col("__v") <= hi, F.struct(F.lit(k).alias("k"), F.when(F.col("__v") >= lo, F.col("__v")).alias("v"))))  # null: below the bracket
    both = rows.join(F.broadcast(sketch.select(by, "__n", "__e", "__min", "__max")), by)  # one row a group
    band = both.select(by, "__n", F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())).alias("__m")).groupBy(by, "__n", F.col("__m.k").alias("__k"), F.col("__m.v").alias("__v")).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(by, "__k").orderBy(F.col("__v").asc_nulls_first()))
    at = F.array(*(F.lit(p) * (F.col("__n") - 1) for p in probs))[F.col("__k")]
    ranked = band.select(by, "__k", "__v", "__c", at.alias("__at"), upto.alias("__to"))
    holds = lambda r: (r >= F.col("__to") - F.col("__c")) & (r < F.col("__to"))
    two = ranked.groupBy(by, "__k").agg(F.max("__at").alias("__at"), F.max(F.when(holds(F.floor("__at")), F.col("__v"))).alias("__x"), F.max(F.when(holds(F.ceil("__at")), F.col("__v"))).alias("__y"))
    part = F.col("__at") - F.floor("__at")
    q = F.when(part == 0, F.col("__x")).otherwise((F.ceil("__at") - F.col("__at")) * F.col("__x") + part * F.col("__y"))
    return two.groupBy(by).agg(*(F.max(F.when(F.col("__k") == k, q)).alias(f"__q{k}") for k in range(len(probs)))).select(by, F.array(*(f"__q{k}" for k in range(len(probs)))).alias("q"))
