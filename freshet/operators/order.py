"""Running totals and neighbours in sorted order without a group in one task.

A sample sort: a mergeable sketch of each group's values gives bounds of ranges, every row finds its range, and windows run within a (group, range). What lies
in the ranges below comes from one row a range, so totals and neighbours are exact wherever the bounds fall.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Ranges of a group as a multiple of the shuffle partitions.
RANGES_A_PARTITION = 4


def _sketch(rows: DataFrame, by: Sequence[str], value: str, ranges: int) -> DataFrame:
    """(by, __q): up to ``ranges`` - 1 rising bounds of each group, in parts of about their square root, with the first of each part in ``__h``."""
    step = max(1, math.isqrt(ranges))
    cuts = F.array_sort(F.array_distinct(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges)))
    found = rows.groupBy(*by).agg(cuts.alias("__c"))
    part = F.transform(F.sequence(F.lit(1), F.size("__c"), F.lit(step)), lambda i: F.slice(F.col("__c"), i, step))
    return found.filter(F.size("__c") > 0).select(*by, part.alias("__q"), F.transform(part, lambda p: p[0]).alias("__h"))


def _range(value: str) -> Column:
    """How many bounds are not above ``value``: a look through the first of each part, then through one part."""
    upto = lambda some: F.size(F.filter(some, lambda q: q <= F.col(value)))
    part = upto(F.col("__h"))
    inside = F.try_element_at("__q", F.greatest(part, F.lit(1)))
    step = F.size(F.col("__q")[0])
    return F.when(F.col("__h").isNull() | (part == 0), F.lit(0)).otherwise((part - 1) * step + upto(inside))


def ranged(rows: DataFrame, by: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``__r``, a range number that rises with ``value`` within each group of ``by`` (few groups); equal values share it.

    The bounds, ``ranges`` a group at most (by default in proportion to the shuffle partitions), are broadcast.
    """
    if ranges is None:
        ranges = RANGES_A_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ranges < 2:
        return rows.withColumn("__r", F.lit(0))
    return rows.join(F.broadcast(_sketch(rows, by, value, ranges)), list(by), "left").withColumn("__r", _range(value)).drop("__q", "__h")


def in_order(rows: DataFrame, by: Sequence[str], value: str, sums: Sequence[str] = (), carry: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """``rows`` (none with a null value) with what stands before and beside them in order of ``value``.

    For each column of ``sums``: ``<c>_upto``, its total over the values up to and with this one, and ``<c>_all``, its total over the group. ``previous`` and ``next`` are
    the values of the rows beside it, null at the ends; with ``carry`` they are structs of the value and those columns, which order rows of equal value. Rows of equal value share their totals.
    """
    placed = ranged(rows, by, value, ranges)
    row = F.struct(value, *carry) if carry else F.col(value)
    totals = placed.groupBy(*by, "__r").agg(*(F.sum(c).alias(f"__{c}") for c in sums), F.min(row).alias("__lo"), F.max(row).alias("__hi"))
    across = Window.partitionBy(*by).orderBy("__r")  # one row a range
    whole = Window.partitionBy(*by)
    beside = totals.select(
        *by, "__r", *(F.coalesce(F.sum(f"__{c}").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__{c}_before") for c in sums), *(F.sum(f"__{c}").over(whole).alias(f"{c}_all") for c in sums),
        F.lag("__hi").over(across).alias("__below"), F.lead("__lo").over(across).alias("__above"),
    )
    inside = Window.partitionBy(*by, "__r").orderBy(value)
    beside_it = Window.partitionBy(*by, "__r").orderBy(value, *carry)
    own = placed.select("*", *(F.sum(c).over(inside).alias(f"__{c}_in") for c in sums), F.lag(row).over(beside_it).alias("__lag"), F.lead(row).over(beside_it).alias("__lead"))
    both = own.join(F.broadcast(beside), [*by, "__r"])  # one row a group and range
    kept = [F.col(f"`{c}`") for c in rows.columns]
    return both.select(*kept, *(x for c in sums for x in ((F.col(f"__{c}_before") + F.col(f"__{c}_in")).alias(f"{c}_upto"), F.col(f"{c}_all"))), F.coalesce("__lag", "__below").alias("previous"), F.coalesce("__lead", "__above").alias("next"))


def unique_ranks(rows: DataFrame, by: Sequence[str], value: str, id_col: str) -> DataFrame:
    """``rows`` with ``rank``, from 0 in order of ``value`` within each group of ``by``, equal values in an order of their own.

    Values that are bounds of the sample are ranges of their own, and a range of one value is split by a hash of ``id_col``, so that no value's rows meet in one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = RANGES_A_PARTITION * parts
    sketch = rows.groupBy(*by).agg(F.array_sort(F.array_distinct(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges))).alias("__q"))
    below = lambda strict: F.size(F.filter("__q", lambda q: q < F.col(value) if strict else q <= F.col(value)))
    placed = rows.join(F.broadcast(sketch), list(by)).withColumn("__r", below(True) + below(False)).drop("__q")  # odd: equal to a bound
    placed = placed.withColumn("__s", F.when(F.col("__r") % 2 == 1, F.pmod(F.xxhash64(id_col), F.lit(parts))).otherwise(F.lit(0)).cast("int"))
    counts = placed.groupBy(*by, "__r", "__s").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__r", "__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part of a range
    inside = F.row_number().over(Window.partitionBy(*by, "__r", "__s").orderBy(value, id_col)) - 1
    ranked = placed.withColumn("__i", inside).join(F.broadcast(counts.select(*by, "__r", "__s", before.alias("__b"))), [*by, "__r", "__s"])
    return ranked.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("__b") + F.col("__i")).alias("rank"))
