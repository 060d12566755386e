"""Maximal periodic runs of words, found in an enhanced suffix array.

The texts of a chunk are one sequence of word numbers with a separator of its own after each stretch. Its suffixes are sorted by prefix doubling; the
ranks of every doubling are kept, so that the common prefix or suffix of any two positions takes a look a doubling. Intervals of
the LCP array are pairs of nearest smaller values, read off a table of range minima; no tree is built. In an interval of depth d the suffixes of all
children but the largest are looked up in the inverse array: where i + d (or i - d) lies in the interval but in another child, i (or i - d)
begins a square of period d that the next word breaks. Each such square, rotated to the left as far as words repeat, is a maximal run, and every run
ends in one; squares of several periods that rotate to the same run leave the smallest.

A run of at least L words and two periods repeats each of its windows of L / 2 words, so words in no repeated window are left out first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table
from .texts import HASH_BITS, WHITE, Batches, chunks, lean, pieces, ranges, span_hashes, strings, windows

SHORTEST = 12
#: Suffixes of smaller children that are looked up at a time.
HELD = 1 << 20
RUNS = "array<struct<start: long, length: long, period: long>>"


def repeated(words: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Indices of the words that lie in a window of ``width`` words whose hash occurs twice or more in its row."""
    h, at = windows(words, row, width)
    key = (row[at].astype(np.uint64) << np.uint64(HASH_BITS)) | (h >> np.uint64(64 - HASH_BITS))
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    hit = at[np.isin(key, twice)]
    edge = np.bincount(hit, minlength=len(words) + 1) - np.bincount(hit + width, minlength=len(words) + 1)
    return np.flatnonzero(np.cumsum(edge)[:-1] > 0)


def suffix_ranks(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of ``x`` and the ranks of its parts of 1, 2, 4 ... entries; the last ranks are the inverse array. The last entry occurs once."""
    n = len(x)
    sa = np.argsort(x, kind="stable")
    new = np.concatenate([[True], x[sa[1:]] != x[sa[:-1]]])
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, h = [rank], 1
    size = np.bincount(rank, minlength=n)
    open_ = np.flatnonzero(size[rank] > 1)
    while len(open_):
        rank = levels[-1].copy()
        group, nxt = rank[open_].astype(np.int64), np.where(open_ + h < n, rank[np.minimum(open_ + h, n - 1)] + 1, 0)
        key = group * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        key, s, group = key[order], open_[order], group[order]
        count = np.arange(len(s))
        slot = group + count - np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), count, 0))
        sa[slot] = s
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[s] = np.maximum.accumulate(np.where(first, slot, 0))
        levels.append(rank)
        alone = first & np.concatenate([first[1:], [True]])
        open_ = s[~alone]
        h *= 2
    return sa, levels


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Entries that the suffixes at ``a`` and ``b`` share; they end before the end of the sequence."""
    a, b, start = a.copy(), b.copy(), a
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][a] == levels[k][b]).astype(np.int64) << k
        a += step
        b += step
    return a - start


def rotated(levels: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Where the squares at ``at`` come to begin when they are rotated to the left while the words repeat."""
    a, b = at.copy(), at + period
    for k in range(len(levels) - 1, -1, -1):
        there = a >= 1 << k
        x, y = np.where(there, a - (1 << k), 0), np.where(there, b - (1 << k), 0)
        step = (there & (levels[k][x] == levels[k][y])).astype(np.int64) << k
        a -= step
        b -= step
    return a


def intervals(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary in ``at`` the slots [low, high) of the widest interval with common prefixes of ``lcp[at]`` or more."""
    minima = [lcp]
    while 2 << (len(minima) - 1) <= len(lcp):
        half = 1 << (len(minima) - 1)
        minima.append(np.minimum(minima[-1][:-half], minima[-1][half:]))
    depth, low, high = lcp[at], at.copy(), at + 1
    for k in range(len(minima) - 1, -1, -1):
        m, width = minima[k], 1 << k
        left, right = low - width, high
        low = np.where((left >= 0) & (m[np.maximum(left, 0)] >= depth), left, low)
        high = np.where((right < len(m)) & (m[np.minimum(right, len(m) - 1)] >= depth), right + width, high)
    return low - 1, high


def squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, period) of the squares that the entry after them breaks; ``lcp[j]`` is of the suffixes in slots j - 1 and j."""
    n = len(sa)
    at = np.flatnonzero(lcp > 0)
    if not len(at):
        return
    low, high = intervals(lcp, at)
    depth = lcp[at]
    order = np.lexsort((at, depth, low))
    at, low, high, depth = at[order], low[order], high[order], depth[order]
    first = np.concatenate([[True], (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])])
    last = np.concatenate([first[1:], [True]])
    own = np.cumsum(first) - 1
    # the children of an interval: from its low end to its first boundary, then from each boundary to the next or the high end
    heads = np.flatnonzero(first)
    begin, end = np.concatenate([low[heads], at]), np.concatenate([at[heads], np.where(last, high, np.append(at[1:], 0))])
    of = np.concatenate([own[heads], own])
    by = np.lexsort((begin - end, of))  # the largest child of each interval comes first
    smaller = by[np.concatenate([[False], of[by][1:] == of[by][:-1]])]
    begin, end, of = begin[smaller], end[smaller], of[smaller]
    low, high, depth = low[heads][of], high[heads][of], depth[heads][of]
    upto = np.cumsum(end - begin)
    s = 0
    while s < len(begin):
        e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + HELD, "right")))
        each = np.repeat(np.arange(s, e), end[s:e] - begin[s:e])
        i, d = sa[ranges(begin[s:e], end[s:e])], depth[each]
        for other, inside in ((i + d, i + d < n), (i - d, i >= d)):
            slot = isa[np.where(inside, other, 0)]
            k = np.flatnonzero(inside & (slot >= low[each]) & (slot < high[each]) & ((slot < begin[each]) | (slot >= end[each])))
            yield np.minimum(i[k], other[k]), d[k]
        s = e


def runs_of(buf: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, smallest period) of the maximal runs of at least ``shortest`` words and two periods, by first word and period.

    The words are buf[start:end] in the rows ``row``, which rise; no run crosses rows. Words are compared whole, not by hashes.
    """
    none = (np.zeros(0, np.int64),) * 3
    kept = repeated(span_hashes(buf, start, end), row, max(1, shortest // 2))
    if not len(kept):
        return none
    word = strings(buf, start[kept], end[kept]).dictionary_encode()
    key = row[kept].astype(np.int64) * len(word.dictionary) + word.indices.to_numpy(zero_copy_only=False)
    code = np.unique(key, return_inverse=True)[1]
    stretch = np.cumsum(np.concatenate([[False], (np.diff(kept) != 1) | (np.diff(row[kept]) != 0)]))
    at = np.arange(len(kept)) + stretch
    n = len(kept) + int(stretch[-1]) + 1
    x = np.full(n, -1, np.int64)
    x[at] = code
    x[x < 0] = code.max() + 1 + np.arange(n - len(kept))
    sa, levels = suffix_ranks(x)
    lcp = np.concatenate([[-1], common_prefix(levels, sa[:-1], sa[1:]), [-1]])
    found = list(squares(sa, levels[-1], lcp))
    if not found:
        return none
    i, d = (np.concatenate(c) for c in zip(*found, strict=True))
    begin = rotated(levels, i, d)
    length = i + 2 * d - begin
    long = np.flatnonzero(length >= shortest)
    begin, length, d = begin[long], length[long], d[long]
    order = np.lexsort((d, length, begin))
    begin, length, d = begin[order], length[order], d[order]
    first = np.concatenate([[True], (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])]) if len(begin) else np.zeros(0, bool)
    begin, length, d = begin[first], length[first], d[first]
    word_at = np.zeros(n, np.int64)
    word_at[at] = kept
    begin = word_at[begin]
    order = np.lexsort((d, begin))
    return begin[order], length[order], d[order]


def _joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, n: int) -> pa.StringArray:
    """The words of each of ``n`` rows joined by single spaces."""
    size = end - start
    gap = np.concatenate([row[1:] == row[:-1], [False]]) if len(row) else np.zeros(0, bool)
    stop = np.cumsum(size + gap)
    out = np.full(stop[-1] if len(stop) else 0, 0x20, np.uint8)
    to = stop - gap - size
    out[ranges(to, to + size)] = buf[ranges(start, end)]
    ends = np.zeros(n + 1, np.int32)
    if len(stop):
        ends[1:] = np.concatenate([[0], stop])[np.searchsorted(row, np.arange(n), "right")]
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(out))


def _mine(shortest: int):
    fields = [pa.field(f, pa.int64()) for f in ("start", "length", "period")]

    def run(batches: Batches) -> Batches:
        for b in batches:
            for i, j, buf, offs in chunks(b.column(1)):
                n = j - i
                start, end, row = pieces(buf, offs, WHITE)
                first = np.searchsorted(row, np.arange(n + 1))
                begin, length, period = runs_of(buf, start, end, row, shortest)
                mine = row[begin]
                edge = np.bincount(begin + period, minlength=len(row) + 1) - np.bincount(begin + length, minlength=len(row) + 1)
                kept = np.cumsum(edge)[:-1] == 0
                text = _joined(buf, start[kept], end[kept], row[kept], n)
                cols = [pa.array(c) for c in (begin - first[mine], length, period)]
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(mine, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays(cols, fields=fields))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), pa.array(np.diff(first)), runs, text], ["id", "n_words", "runs", "text"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``id_col``, ``n_words``, ``runs`` (start, length, period by start, then period) and the collapsed ``text`` for every row.

    A run is a stretch of words with smallest period q and at least ``shortest`` words and two periods that no neighbouring word extends with that
    period. The collapsed text keeps of each run its first q words (words that another run drops too), joined by single spaces. Words are
    maximal runs of other characters than white space and compared byte by byte. Null and empty texts have no words, no runs and an empty text; repeated rows and ids each give their row; null ids stay null;
    other columns are ignored. A text of any length is worked whole, in a task of its own batch.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(lean(_mine(shortest)), f"`{id_col}` {kind}, n_words long, runs {RUNS}, text string")


def planted(id_: Column, text: Column) -> Column:
    """``text``, or for an id whose CRC-32 (as decimal text) is a multiple of 10 its words from some word a on replaced by a period of p words.

    With h the CRC, g = h // 10 and n > 0 words: a = g % n, p = 1 + (n - a) // (3 + g % 8), and word i >= a becomes word a + (i - a) % p. A null id changes nothing.
    """
    h = F.crc32(id_.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    g = F.floor(h / 10)

    def repeated_from(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        return F.when(n > 0, F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(w[(a + (i - a) % p).cast("int")])), " ")).otherwise(text)

    return F.when(h % 10 == 0, F.transform(F.array(words), repeated_from)[0]).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.p")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"), "n_words",
    )
