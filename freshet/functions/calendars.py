"""Water-year order of months and the calendar guards of scored windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: October to September.
WATER_YEAR = (10, 11, 12, 1, 2, 3, 4, 5, 6, 7, 8, 9)
MONTHS = 12


def water_position(month: Column) -> Column:
    """0 for October up to 11 for September."""
    return F.pmod(month - 10, F.lit(MONTHS))


def to_water_year(values: Column) -> Column:
    """A calendar-ordered array of twelve values in water-year order."""
    return F.when(F.size(values) == MONTHS, F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: values[F.pmod(i + 9, F.lit(12)).cast("int")])).otherwise(F.raise_error(F.lit("twelve values are needed")))


def to_calendar(values: Column) -> Column:
    """A water-year-ordered array of twelve values in calendar order."""
    return F.when(F.size(values) == MONTHS, F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: values[F.pmod(i + 3, F.lit(12)).cast("int")])).otherwise(F.raise_error(F.lit("twelve values are needed")))


def add_months(day: dt.date, n: int) -> dt.date:
    y, m = divmod(day.year * 12 + day.month - 1 + n, 12)
    return dt.date(y, m + 1, 1)


def scored_month_days(start: dt.date, months: int, skipped: int, days: int) -> list[int]:
    """Day counts of the months scored after the first ``skipped``; the window must open on December 1 and fill ``days`` exactly."""
    if (start.month, start.day) != (12, 1):
        raise ValueError("a scored window opens on the first of a December")
    if (add_months(start, months) - start).days != days:
        raise ValueError(f"{months} months from {start} do not have {days} days")
    return [(add_months(start, k + 1) - add_months(start, k)).days for k in range(skipped, months)]
