"""Bounded, repeatable samples of rows to fit a model on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5; fold 0 is never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def sample_ids(rows: DataFrame, most: int, salt: str, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` distinct ids, those with the smallest salted CRC-32: the same ones for any partitioning.

    Only ids below a CRC that about twice as many pass are shuffled; with many repeated ids there may be fewer.
    """
    crc = F.crc32(F.concat(F.lit(salt), F.col(id_col).cast("string")).cast("binary"))
    known = rows.filter(F.col(id_col).isNotNull())
    cut = (2 * most + 1000) / max(1, known.count())
    return known.filter(crc < F.lit(int(min(1.0, cut) * (1 << 32)))).select(id_col).distinct().orderBy(crc, id_col).limit(most)
