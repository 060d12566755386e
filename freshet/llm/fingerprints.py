"""Document fingerprints by consistent weighted sampling.

For each term of weight S and each of K samples, fixed pseudo-random draws r, c ~ Gamma(2, 1) and b ~ U(0, 1)
give t = floor(ln S / r + b) and ln a = ln c - r (t - b) - r. The smallest ln a is the sample; two documents
have the same one with a probability equal to the generalised Jaccard likeness of their weighted
terms. A fingerprint keeps 16 bits of each sample, hashed from the sampled term and its t. Terms are white-space words weighted by their count.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .tables import read_table
from .texts import HASH_BITS, WHITE, chunks, lean, mix, pieces, span_hashes

SAMPLES = 64
#: Ranges of ids in which neighbours meet, for each shuffle partition; their first ids (one row a range) are broadcast.
RANGES_PER_PARTITION = 4
_BLOCK = 1024
_U = np.uint64


def _samples(term: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """For every (term, weight) row and sample a key that sorts like ln a, with 16 bits hashed from (term, t) at its end."""
    out = np.empty((len(term), k), _U)
    salt = mix(np.arange(1, k + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    unit = np.float32(2.0**-21)
    mask = _U((1 << 21) - 1)
    for s in range(0, len(term), _BLOCK):
        h = mix(term[s : s + _BLOCK, None] ^ salt[None, :])
        g = mix(h + _U(0xD1B54A32D192ED03))
        u = [(((x >> _U(n)) & mask).astype(np.float32) + np.float32(0.5)) * unit for x, n in ((h, 0), (h, 21), (h, 42), (g, 0), (g, 21))]
        r = -np.log(u[0] * u[1])
        log_c = np.log(-np.log(u[2] * u[3]))
        t = np.floor(np.log(weight[s : s + _BLOCK, None].astype(np.float32)) / r + u[4])
        bits = (log_c - r * (t - u[4] + np.float32(1))).view(np.uint32)
        rising = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))  # floats in order as integers
        out[s : s + _BLOCK] = (rising.astype(_U) << _U(32)) | (mix(h + t.astype(np.int64).view(_U)) >> _U(48))
    return out


def _terms(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, distinct ``row << 54 | word hash`` keys, their counts) of consecutive chunks."""
    for i, j, buf, offs in chunks(col):
        start, end, row = pieces(buf, offs, WHITE)
        key = (row.astype(_U) << _U(HASH_BITS)) | (span_hashes(buf, start, end) >> _U(64 - HASH_BITS))
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        yield i, j - i, key[first], np.diff(np.append(first, len(key)))


def signatures(col: pa.Array, k: int = SAMPLES) -> np.ndarray:
    """(rows, k) uint16; a text without words has only zeros, other samples are never zero."""
    out = np.zeros((len(col), k), np.uint16)
    code = lambda best: np.maximum(best & _U(0xFFFF), _U(1)).astype(np.uint16)
    for at, n, key, count in _terms(col):
        if not len(key):
            continue
        term, row = key & _U((1 << HASH_BITS) - 1), (key >> _U(HASH_BITS)).astype(np.int64)
        if n == 1:  # perhaps a very long text: its samples are minima over blocks of terms
            out[at] = code(np.minimum.reduce([_samples(term[s : s + _BLOCK], count[s : s + _BLOCK], k).min(axis=0) for s in range(0, len(term), _BLOCK)]))
            continue
        pair, where = np.unique(mix(term) + count.astype(_U) * _U(0x9E3779B97F4A7C15), return_inverse=True, return_index=True)[1:]
        a = _samples(term[pair], count[pair], k)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        for s in range(0, len(first), 64):  # bounded gathers of whole rows
            lo, hi = first[s], first[s + 64] if s + 64 < len(first) else len(row)
            out[at + row[first[s : s + 64]]] = code(np.minimum.reduceat(a[where[lo:hi]], first[s : s + 64] - lo, axis=0))
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal samples of paired rows."""
    return (x == y).mean(axis=1)


def _hex(codes: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in codes]


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(samples: int):
    def made(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        own, new = signatures(pa.array(texts, pa.large_string()), samples), signatures(pa.array(changed, pa.large_string()), samples)
        # the rows come in order, so the next text of most rows is the next row's own
        shifted = np.concatenate([own[1:], signatures(pa.array(following[-1:], pa.large_string()), samples)]) if texts else own
        odd = [k for k in range(len(texts) - 1) if following[k] is not texts[k + 1]]
        if odd:
            shifted[odd] = signatures(pa.array([following[k] for k in odd], pa.large_string()), samples)
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in changed]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), *(pa.array(x, pa.string()) for x in (sha, _hex(own), _hex(new))), *(pa.array(x, pa.float64()) for x in (likeness(own, new), likeness(own, shifted)))], [f.split()[0] for f in _OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (range, id, text) of the last row, whose next text is still to come
        ids, texts, following, held = [], [], [], 0
        for b in batches:
            for where, ghost, id_, text in zip(*(b.column(k) for k in range(4)), strict=True):
                where, ghost, id_, text = where.as_py(), ghost.as_py(), id_.as_py(), text.as_py() or ""
                if before and before[0] == where:
                    ids.append(before[1])
                    texts.append(before[2])
                    following.append(text)
                    held += len(text)
                before = None if ghost else (where, id_, text)
                if held > 1 << 21 or len(ids) >= 1000:
                    yield made(ids, texts, following)
                    ids, texts, following, held = [], [], [], 0
        if ids:
            yield made(ids, texts, following)

    return run


def _below(value: F.Column, bounds: list[int]) -> F.Column:
    """How many of the sorted ``bounds`` lie below ``value``: a look through every sqrt-th one, then through those after it."""
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    passed = lambda some: F.size(F.filter(some, lambda q: q < value))
    as_array = lambda some: F.from_json(F.lit(str(some)), "array<bigint>")  # noqa: E731  one literal, however many bounds
    part = passed(as_array([p[0] for p in parts]))
    inside = F.from_json(F.lit(str(parts)), "array<array<bigint>>")[part - 1]
    return F.when(part == 0, F.lit(0)).otherwise((part - 1) * step + passed(inside))


def _ranges(value: F.Column, tie: F.Column, bounds: list[int], nulls: int) -> F.Column:
    """The number of the range of (value, tie), rising with both, nulls lowest.

    ``bounds`` are quantiles of the ids: one that occurs several times is an id with more rows than a range should have. Such ids, and
    the rows without id (as many as ``nulls`` ranges should have), are split further by leading bits of the hash ``tie``, into
    more parts than that; so neither meet in one task.
    """

    def part(times: int) -> F.Column:  # rises with tie, a signed number
        return F.shiftrightunsigned(tie.bitwiseXOR(F.lit(-(1 << 63))), 64 - max(times, 1).bit_length())

    low = sorted(set(bounds))
    hot: dict[int, list[int]] = {}
    for x, times in Counter(bounds).items():
        if times > 1:
            hot.setdefault(1 << (times - 1).bit_length(), []).append(x)
    whole = (_below(value, low) + 1 if low else F.lit(1)).cast("long") * (1 << 32)
    out = F.when(value.isNull(), part(nulls))
    for times, of in hot.items():
        out = out.when(value.isin(of), whole + 1 + part(times))
    return out.otherwise(whole)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """For every row its fingerprint, that of its edited text, and their likeness (see ``_OUT``).

    The next document is the one before it in ascending (id, hash of the text) order, null ids lowest; after the last comes
    the first. Null texts are empty; two texts without words are alike. Other columns are ignored. Texts are
    shuffled once, to ranges of ids (of hashes where many rows share an id or have none); a range also gets the row that
    follows its last one. Only rows equal in id and text always meet.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = n * RANGES_PER_PARTITION
    found = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q"), F.count("id").alias("known"), F.count("*").alias("n")).first()
    nulls = math.ceil(ranges * (found.n - found.known) / max(found.n, 1))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("range", _ranges(F.col("id"), F.col("tie"), found.q or [], nulls))
    # the first row of each non-empty range also ends the range before it (the one above in id order)
    heads = rows.groupBy("range").agg(F.max(F.struct(F.col("id"), F.col("tie"))).alias("head"))
    up = Window.orderBy("range")  # one row a range
    heads = heads.withColumn("above", F.coalesce(F.lead("range").over(up), F.min("range").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = heads.select(F.col("range").alias("r"), "head", "above")
    at_head = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("tie") == F.col("head.tie"))
    placed = rows.join(F.broadcast(heads), F.col("range") == F.col("r")).withColumn("first", at_head)
    both = F.when(F.col("first"), F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("ghost")), F.struct(F.col("above").alias("range"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("ghost"))))
    spread = placed.select("id", "text", "tie", F.explode(both).alias("to")).select("to.range", "to.ghost", "id", "text", "tie")
    sorted_ = spread.repartition(n, "range").sortWithinPartitions("range", "ghost", F.desc_nulls_last("id"), F.desc("tie"))
    return sorted_.select("range", "ghost", "id", "text").mapInArrow(lean(_compare(samples)), _OUT.replace("doc_id", f"`{id_col}`"))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``id_col`` and ``fingerprint`` (4 hexadecimal digits a sample) for every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_hex(signatures(b.column(1), samples)), pa.string())], [id_col, "fingerprint"])

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(lean(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read_table(spark, sf_dir, "documents"))
