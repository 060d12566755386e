"""Shards of near-equal bytes by histogram sort.

Rows are ordered by (hash of the text, hash of the id). Each round counts the exact bytes below candidate
boundaries: one grouped sum over the next ``DIGIT`` bits of the key, limited to the key ranges in which a splitter
still lies. A splitter is settled once a boundary is within ``tolerance`` of its share. Boundaries
between different texts are preferred up to ``group_tolerance``; only a larger group of equal texts is
cut, along the hashes of its ids. When all splitters are settled, the rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .tables import materialize, read_table

#: Bits of the key, and bits counted a round: at most 4,096 sums for each open range go to the driver.
KEY_BITS, DIGIT = 63, 12
#: Bits of the text's and of the id's hash that name a slot range: at most 2 ** 16 ranges and 2 ** 10 more a shard (some 5 MB, broadcast), however many rows.
RANGE_BITS, RANGE_ID_BITS = 6, 10


@dataclass
class Splitter:
    """A boundary being refined: ``goal`` bytes should lie below (text key, id key)."""

    goal: float
    text: int = 0
    ident: int = 0
    below: int = 0  # bytes below the open range
    left: int = KEY_BITS  # bits of the key not yet fixed
    in_group: bool = False  # the open range is one text; ids are being cut
    done: bool = False

    def settle(self, text: int, ident: int) -> None:
        self.text, self.ident, self.done = text, ident, True


def _key(col, seed: int):
    return F.xxhash64(F.lit(seed), col).bitwiseAND(F.lit((1 << KEY_BITS) - 1))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _key(text, 1).alias("k"), _key(F.col(id_col), 2).alias("d")
    )


def _round(keys: DataFrame, splitters: list[Splitter], tolerance: float, group_tolerance: float) -> None:
    """Count below the candidates of every open range and narrow or settle its splitter."""
    for in_group in (False, True):
        for left in sorted({s.left for s in splitters if not s.done and s.in_group == in_group}):
            mine = [s for s in splitters if not s.done and s.in_group == in_group and s.left == left]
            step = max(0, left - DIGIT)
            col = F.col("d" if in_group else "k")
            open_ = F.col("k").isin([s.text for s in mine]) if in_group else F.lit(True)
            if left < KEY_BITS:
                open_ = open_ & F.shiftright(col, left).isin([(s.ident if in_group else s.text) >> left for s in mine])
            group = F.col("k") if in_group else F.lit(0).cast("long")
            sums: dict[int, list[tuple[int, int]]] = {}
            for g, at, n in keys.filter(open_).groupBy(group.alias("g"), F.shiftright(col, step).alias("at")).agg(F.sum("size").alias("n")).collect():
                sums.setdefault(g, []).append((at << step, n))
            for s in mine:
                start = s.ident if in_group else s.text
                below = s.below
                for at, n in sorted(x for x in sums.get(s.text if in_group else 0, []) if start <= x[0] < start + (1 << left)):
                    if below + n < s.goal:
                        below += n
                        continue
                    ends = sorted([(abs(below - s.goal), at), (abs(below + n - s.goal), at + (1 << step))])
                    if ends[0][0] <= tolerance or (step == 0 and (in_group or ends[0][0] <= group_tolerance)):
                        s.settle(*((s.text, ends[0][1]) if in_group else (ends[0][1], 0)))
                    elif step == 0:
                        s.text, s.ident, s.below, s.left, s.in_group = at, 0, below, KEY_BITS, True
                    else:
                        s.below, s.left = below, step
                        s.text, s.ident = (s.text, at) if in_group else (at, 0)
                    break
                else:
                    s.settle(*((s.text, start + (1 << left)) if in_group else (start + (1 << left), 0)))


def splitters(keys: DataFrame, shards: int, tolerance: float, group_tolerance: float) -> list[tuple[int, int]]:
    """The ``shards - 1`` boundaries (text key, id key) in order."""
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    found = [Splitter(total * j / shards) for j in range(1, shards)]
    while total and any(not s.done for s in found):
        _round(keys, found, tolerance * total / shards, group_tolerance * total / shards)
    return sorted((s.text, s.ident) for s in found)


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, group_tolerance: float = 0.05) -> DataFrame:
    """``row`` (all columns of ``docs``), ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` for every row.

    A null text counts as empty (size 1). Rows equal in id and text are interchangeable; null ids hash
    alike. Slots run from 0 without gaps in each shard. Columns of any name are kept inside ``row``. An empty
    table gives no rows; with fewer rows than shards some shards stay empty.
    """
    keys = materialize(_keys(docs, id_col, text_col).select("size", "k", "d"), "shard-keys")
    cuts = splitters(keys, shards, tolerance, group_tolerance)

    def placed(df: DataFrame) -> DataFrame:
        past = [((F.col("k") > k) | ((F.col("k") == k) & (F.col("d") >= d))).cast("int") for k, d in cuts]
        spot = (F.shiftright("k", KEY_BITS - RANGE_BITS) * (1 << RANGE_ID_BITS) + F.shiftright("d", KEY_BITS - RANGE_ID_BITS)).cast("int")
        return df.withColumn("shard", sum(past, F.lit(0)).cast("int")).withColumn("spot", spot)

    sizes = placed(keys).groupBy("shard", "spot").agg(F.count("*").alias("n"))
    start = sizes.select(F.col("shard").alias("s"), F.col("spot").alias("p"), (F.sum("n").over(Window.partitionBy("shard").orderBy("spot")) - F.col("n")).alias("start"))
    rows = placed(_keys(docs, id_col, text_col))
    within = F.row_number().over(Window.partitionBy("shard", "spot").orderBy("k", "d"))
    return (
        rows.withColumn("within", within)
        .join(F.broadcast(start), (F.col("shard") == F.col("s")) & (F.col("spot") == F.col("p")))
        .select("row", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(read_table(spark, sf_dir, "documents")).select(F.col("row.doc_id").alias("doc_id"), "size", "text_crc32", "law", "shard", "slot", "grown_shard")
