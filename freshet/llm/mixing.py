"""Mixing sources to temperature weights, by DataFrame operations only.

A source's weight is its token share to the power alpha, normalised. Alpha is bisected, several probes a
round, to the value nearest 1 that reaches a target entropy, or to the flattest mix that repeats no source more than a
limit allows. The weights then become whole documents: a source's documents lie in blocks; each
pass over the source permutes the blocks and takes them while its token quota lasts, cutting the last block
along the hashes of its documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .tables import materialize, read_table

#: Least blocks of a source, documents for each further block, probes a round and rounds of the bisection (interval 17 ** -6 at the end).
BLOCKS, BLOCK_ROWS, PROBES, ROUNDS = 256, 20_000, 16, 6
#: Rows (about 100 bytes each) of the block plan that may be broadcast; a longer plan is joined by a shuffle on (source, block).
BROADCAST_PLAN = 100_000
MAX_REPEATS = 1.5
_TOP = (1 << 62) - 1


def _order(*cols) -> F.Column:
    return F.xxhash64(*cols).bitwiseAND(F.lit(_TOP))


def source_totals(measured: DataFrame) -> DataFrame:
    """(source, tokens, share of all tokens), one row per source."""
    t = measured.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    every = t.agg(F.sum("tokens").alias("all"))
    return t.crossJoin(F.broadcast(every)).select("source", "tokens", (F.col("tokens") / F.col("all")).alias("share"))  # one row


def exponent(totals: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None) -> float:
    """Alpha in [0, 1]. ``target_entropy`` is a share of the largest possible entropy; ``budget`` None: every document at least once."""
    lo, hi = 0.0, 1.0
    n, every = totals.agg(F.count("*"), F.sum("tokens")).first()
    if n < 2 or (target_entropy is None and max_repeats is None):
        return 1.0
    log = F.log("share")

    def fits(alphas: list[float]) -> list[bool]:
        cols = []
        for a in alphas:
            w = F.exp(a * log)
            cols += [F.sum(w), F.sum(w * log), F.max(w / F.col("tokens")), F.min(w / F.col("tokens"))]
        got = totals.agg(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()
        out = []
        for i, a in enumerate(alphas):
            z, zl, most, least = got[4 * i : 4 * i + 4]
            entropy = math.log(z) - a * zl / z
            repeats = most / least if budget is None else budget * most / z
            out.append(entropy >= target_entropy * math.log(n) if max_repeats is None else repeats <= max_repeats)
        return out

    for _ in range(ROUNDS):  # entropy and repeats both fall as alpha grows
        probes = [lo + (hi - lo) * (i + 1) / (PROBES + 1) for i in range(PROBES)]
        ok = fits(probes)
        if max_repeats is None:
            last = max((i for i, x in enumerate(ok) if x), default=-1)
            lo, hi = (probes[last] if last >= 0 else lo), (probes[last + 1] if last + 1 < PROBES else hi)
        else:
            first = next((i for i, x in enumerate(ok) if x), PROBES)
            lo, hi = (probes[first - 1] if first else lo), (probes[first] if first < PROBES else hi)
    return round(lo if max_repeats is None else hi, 6)


def weights(totals: DataFrame, alpha: float, budget: int | None = None) -> DataFrame:
    """(source, tokens, share, weight, quota): tokens that each source contributes."""
    raw = totals.withColumn("raw", F.pow("share", F.lit(alpha)))
    z = raw.agg(F.sum("raw").alias("z"), F.max(F.col("tokens") / F.col("raw")).alias("stretch"))
    w = raw.crossJoin(F.broadcast(z))  # one row
    quota = F.col("raw") * F.col("stretch") if budget is None else F.lit(budget) * F.col("raw") / F.col("z")
    return w.select("source", "tokens", "share", (F.col("raw") / F.col("z")).alias("weight"), F.floor(quota + F.lit(0.5)).cast("long").alias("quota"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: int | None = None, seed: int = 1, blocks: int | None = None
) -> DataFrame:
    """``row`` (all columns of ``docs``), ``source``, ``tokens``, ``epoch``, ``block_rank``, ``position`` for every document taken.

    Tokens are white-space words plus one per document. With ``budget`` None the quotas are the least that follow
    the weights and still take every document once, so nothing is dropped and smaller sources repeat. A null
    source is the source "". Null and empty texts count one token. Rows with equal ids, and rows with null ids and equal texts, share a place
    in the order and are taken together or, at a cut, by their running tokens. An empty table gives no rows. The number of
    ``blocks`` of a source follows the number of rows, so that a block is a bounded part of a task.
    (epoch, block_rank, position) is the order of reading within a source.
    """
    blocks = blocks or max(BLOCKS, docs.count() // BLOCK_ROWS)
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), (words + 1).cast("long").alias("tokens"),
        F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("text"), F.col(text_col))).otherwise(F.xxhash64(F.col(id_col))).alias("id")
    ).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(blocks)).cast("int"))
    measured = materialize(rows.select("source", "tokens", "id", "block"), "mix")
    totals = materialize(source_totals(measured), "totals")
    quotas = materialize(weights(totals, exponent(totals, target_entropy, max_repeats, budget), budget).withColumn("full", F.floor(F.col("quota") / F.col("tokens")).cast("int")).withColumn("rest", F.col("quota") - F.col("full") * F.col("tokens")), "quotas")

    rank_key = _order(F.lit(seed), F.col("source"), F.col("epoch"), F.col("block"))
    by_block = measured.groupBy("source", "block").agg(F.sum("tokens").alias("n"))
    last = by_block.join(quotas.filter("rest > 0").select("source", F.col("full").alias("epoch"), "rest"), "source")
    upto = F.sum("n").over(Window.partitionBy("source").orderBy(rank_key, "block"))
    last = last.withColumn("before", upto - F.col("n")).filter("before < rest")
    cut = last.filter(F.col("before") + F.col("n") > F.col("rest")).select("source", "block", "epoch", (F.col("rest") - F.col("before")).alias("room"))
    inside = measured.join(F.broadcast(cut) if cut.count() <= BROADCAST_PLAN else cut, ["source", "block"])
    key = _order(F.lit(seed), F.col("epoch"), F.col("id"))
    edge = inside.withColumn("key", key).withColumn("sum", F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))).filter("sum <= room")
    edge = edge.groupBy("source", "block").agg(F.max("key").alias("edge"))
    partial = last.join(cut.select("source", "block", "room"), ["source", "block"], "left").join(edge, ["source", "block"], "left")
    partial = partial.select("source", "block", "epoch", F.when(F.col("room").isNull(), F.lit(_TOP)).otherwise(F.coalesce("edge", F.lit(-1))).alias("edge"))
    whole = by_block.join(quotas.filter("full > 0").select("source", "full"), "source").select("source", "block", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"), F.lit(_TOP).alias("edge"))
    steps = whole.union(partial).withColumn("rank", F.row_number().over(Window.partitionBy("source", "epoch").orderBy(rank_key, "block")))
    plan = materialize(steps.groupBy("source", "block").agg(F.collect_list(F.struct("epoch", "rank", "edge")).alias("steps")), "plan")
    taken = rows.join(F.broadcast(plan) if plan.count() <= BROADCAST_PLAN else plan, ["source", "block"])
    out = taken.select("row", "source", "tokens", "id", F.explode("steps").alias("step")).select("row", "source", "tokens", "id", "step.*").withColumn("position", key)
    return out.filter("position <= edge").select("row", "source", "tokens", "epoch", F.col("rank").alias("block_rank"), "position")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select(F.col("row.doc_id").alias("doc_id"), "source", "tokens", "epoch", "block_rank", "position")
