"""Reference fits kept by what they were made from.

The key is a digest of the record's content, one aggregate whose parts do not depend on the order or the partitions of the rows, and of the fit's parameters. A record that
was fitted before, under whatever name or in whatever frame, is read from the store and not fitted again.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.image import Reference, fit_reference
from ..operators.ssi import TIMESCALE


def content_digest(df: DataFrame) -> str:
    """SHA-256 of the columns' names and types and of four order-free figures of the rows: their number, two sums and the exclusive or of 64-bit hashes with different seeds.

    Rows count as often as they occur; nulls, columns in another order and -0.0 beside 0.0 make no difference of their own. Equal frames have equal digests, different ones differ but for a chance of about 2**-128.
    """
    names = sorted(df.columns)
    # a null is told from any value by a flag beside it
    row = [x for c in names for x in (F.col(f"`{c}`").isNull(), F.when(F.col(f"`{c}`") == 0, F.lit(0)).otherwise(F.col(f"`{c}`")) if dict(df.dtypes)[c] in ("double", "float") else F.col(f"`{c}`"))]
    h = [F.xxhash64(F.lit(k), *row) for k in range(3)]
    exact = lambda x: F.sum(x.cast("decimal(20,0)")).cast("string")
    found = df.agg(F.count("*").alias("n"), exact(h[0]).alias("a"), exact(h[1]).alias("b"), F.bit_xor(h[2]).alias("x")).first()
    return hashlib.sha256(json.dumps([[(c, dict(df.dtypes)[c]) for c in names], *found]).encode()).hexdigest()


def reference_fits(monthly: DataFrame, daily: DataFrame, store: str, timescale: int = TIMESCALE, percentile: float = 95.0) -> Reference:
    """The fit of a reference record, from ``store`` (a folder that all executors share) where it is there, else made and written.

    Two digests and twelve rows are all that a known record costs. The result is the one that ``fit_reference`` gives.
    """
    spark = monthly.sparkSession
    key = hashlib.sha256(json.dumps([content_digest(monthly), content_digest(daily), int(timescale), float(percentile)]).encode()).hexdigest()
    path = f"{store}/{key}"
    try:
        kept = spark.read.parquet(path)
    except AnalysisException:  # no such folder, or one without a finished file
        made = fit_reference(monthly, daily, timescale, percentile)
        made.fits.withColumns({"threshold": F.lit(made.threshold), "mean": F.lit(made.mean)}).coalesce(1).write.mode("overwrite").parquet(path)
        kept = spark.read.parquet(path)
    levels = kept.select("threshold", "mean").first()
    return Reference(kept.select("cal_month", "shape", "scale"), levels.threshold, levels["mean"])
