"""Exact n-gram Jaccard self-join as a blocked sparse product of the document by n-gram incidence matrix.

With sets A and B of sizes a and b, a Jaccard likeness of p % or more allows at most
``k = (a + b)(100 - p) / (100 + p)`` n-grams outside the overlap. The columns (n-gram hashes) are
therefore cut into ``m > k`` blocks, and a pair that agrees in none of its blocks cannot reach the bound. The equal blocks are the
mask of the product of the matrix with its transpose: only entries under the mask are formed. Overlap counts are accumulated
column block by column block over the rows of a batch of masked entries, and an entry leaves as soon as its count and what is left
in the smaller row fall short of the bound that its sizes set. Every link comes from this product.

* Rows are dealt to size classes so that a pair's sizes lie in one class or in two neighbours; a row stands in
  the blocks of its own class and of the next. No pair within the bound is missed.
* Blocks with too few n-grams to tell rows apart are left out where ``m - k - 1`` spare blocks cover them.
* N-grams that many otherwise different texts share (``common_grams``) are left out of the blocks, which would say little
  with them: rows without them differ in no more n-grams than before, so the bound still holds. They count in every product.
* A pair within the bound agrees in ``m - k`` blocks, of which those without enough n-grams are left out: at least ``d + 1`` of a row's
  blocks, ``d`` being the spare ones it has left. So each row leaves its ``d`` largest buckets, in one order of all: the first bucket that both
  rows of a pair stand in is never one of them. Rows that meet in few blocks, by chance or by a passage they share, so leave all.
* Rows with equal sets are one row of the matrix; their group is a star around its smallest id.
* In a bucket (rows with an equal block) the mask first has every member's entry with one centre only: the row that stands in
  the largest buckets. Where all members of a centre have come into one component, nothing is left to do.
* Else two members A and B of one bucket in different components are still open. In buckets of up to ``SMALL`` members all open pairs are
  formed at once. Members of larger ones, of centres whose members lie in several components, are taken apart into their n-grams: once each, whatever the number
  of their buckets and centres, so there are no more rows than n-grams in the texts. To link, A and B (a <= b n-grams) share ``o = p (a + b) / (100 + p)`` or more. In any
  one order of the n-grams, the first that they share then stands among the first ``a - o + 1`` of A and ``b - o + 1`` of B: at most the part ``(100 - p) / (100 + p)`` of the
  smaller and ``(100 - p) / 100`` of each. The order begins with n-grams on which no two components meet,
  so these are counted only; then comes how few members have the n-gram: what all of a group share comes last. Of those that meet
  on an n-gram, each first has entries with ``PARTNERS`` others only, in ``TURNS`` turns. All pairs that meet and still lie in different
  components are the mask of the last product. No link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .tables import discard, materialize, read_table
from .texts import HASH_BITS, chunks, lean, mix, shingle_sets

#: Ids or pairs of them that may be broadcast (8 bytes an id) to pick rows for the product; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Spare blocks as a share of those that the bound asks for: (least percent, share). Lower bounds cut blocks smaller, and more of them tell little.
SPARE = ((90, 0.1), (0, 0.25))
#: Common n-grams kept (8 bytes each, sent with the tasks), the texts looked at together, and in how many different ones an n-gram must stand.
COMMON, LOOK_ROWS, LOOK_BYTES, LOOK_TEXTS = 65_536, 2048, 4 << 20, 4
#: Column blocks over which overlap counts are summed; entries and n-grams of a batch of the product.
BLOCKS, ENTRIES, GRAMS = 4, 256, 1 << 18
#: Members of a bucket, besides its centre, up to which all their open pairs are formed; beyond it their n-grams are compared.
SMALL = 8
#: Turns in which members that meet on an n-gram are tied through a few of them, and how many, before all open pairs are formed.
TURNS, PARTNERS = 2, 6
#: Sets that a task remembers to tell copies; beyond it starts anew.
SEEN = 32_768
#: Ids below this are the table's own.
_OTHER = 1 << 62
SET, BLOCK, COPY = 0, 1, 2
#: Layout of a tag: 2 bits of kind, then ``leave``: whether the block is cut for the next class, and the row's spare blocks left (fewer than are left do no harm); then the row's size.
LEAVE_BITS = 18
_U = np.uint64
_MASK = _U((1 << HASH_BITS) - 1)


class Classes:
    """Size classes, and for each the number of blocks, of spare ones, and the least n-grams of a telling block."""

    def __init__(self, percent: int, largest: int):
        low = [1, 2]
        while low[-1] <= largest * 100 // percent + 1:
            low.append(max(low[-1] + 1, (low[-1] - 1) * 100 // percent + 1))
        self.low = np.array(low)
        most = np.append(self.low[1:], self.low[-1] * 2) - 1
        k = 2 * most * (100 - percent) // (100 + percent)
        spare = next(share for least, share in SPARE if percent >= least)
        self.m = np.where(k > 0, np.ceil((k + 1) * (1 + spare)), 0).astype(np.int64)
        self.spare = np.maximum(self.m - k - 1, 0)
        self.least = np.zeros(len(k), np.int64)
        for j in np.flatnonzero(self.m):
            mean, f, p, total = self.low[max(j - 1, 0)] / self.m[j], 0, 0.0, 0.0
            while True:  # Poisson: how many n-grams a block may hold and still be rare enough for the spare blocks
                p = math.exp(-mean) if f == 0 else p * mean / f
                total += p
                if total > 0.6 * self.spare[j] / self.m[j]:
                    break
                f += 1
            self.least[j] = f

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1


def _blocks(keys: np.ndarray, sizes: np.ndarray, rows: np.ndarray, label: np.ndarray, c: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row) of the telling blocks of ``rows``, cut as pairs with the larger row in class ``label`` need it, and for each of all rows its spare blocks left.

    Two rows within the bound agree in one more of their telling blocks than either has spare ones left.
    """
    m = np.zeros(len(sizes), np.int64)
    m[rows] = c.m[label]
    lab = np.zeros(len(sizes), np.int64)
    lab[rows] = label
    owner = (keys >> _U(HASH_BITS)).astype(np.int64)
    keys, owner = (keys[m[owner] > 0], owner[m[owner] > 0])
    base = np.concatenate([[0], np.cumsum(m)])
    h = keys & _MASK
    at = base[owner] + (((h >> _U(20)) * m[owner].astype(_U)) >> _U(HASH_BITS - 20)).astype(np.int64)
    count = np.bincount(at, minlength=base[-1])
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h), dtype=_U)])
    upto = np.cumsum(count)
    part_row = np.repeat(np.arange(len(sizes)), m)
    place = (lab[part_row].astype(_U) << _U(40)) | (np.arange(base[-1]) - base[part_row]).astype(_U)
    sig = mix(total[upto] - total[upto - count] + mix(place + _U(1)))
    few = count < c.least[lab[part_row]]
    left = c.spare[lab] - np.bincount(part_row[few], minlength=len(sizes))
    keep = ~few | (left < 0)[part_row]  # a row without enough telling blocks keeps all; its partner may keep fewer
    return sig[keep], part_row[keep], np.maximum(left, 0)


def _look(width: int):
    """Map step of ``common_grams``: n-grams of many texts of a stretch, with their number. Near copies mostly share their least n-gram and count once."""

    def count(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        of, h = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, _U) for k in (0, 1))
        pair = _pairs_once(h, of) if len(h) else h
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(pair)))
        many = n >= LOOK_TEXTS
        return pa.RecordBatch.from_arrays([pa.array(pair[first[many]].view(np.int64)), pa.array(n[many].astype(np.int64))], ["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows, held = [], 0, 0
        for b in batches:
            for i, j, buf, offs in chunks(b.column(0)):
                keys, sizes = shingle_sets(buf, offs, width)
                h = keys & _MASK
                start = np.cumsum(sizes) - sizes
                least = np.repeat(h[np.minimum(start, max(len(h) - 1, 0))] if len(h) else np.zeros(len(sizes), _U), sizes)  # keys are sorted
                parts.append((least, h))
                rows, held = rows + j - i, held + len(buf)
                if rows >= LOOK_ROWS or held >= LOOK_BYTES:
                    yield count(parts)
                    parts, rows, held = [], 0, 0
        yield count(parts)

    return run


def _pairs_once(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """``h``, sorted, without repeats of the same (h, of)."""
    key = np.sort((h >> _U(22) << _U(32)) | (mix(of) >> _U(32)))  # 32 bits of each: a clash only misjudges how common an n-gram is
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    kept = np.sort(h)
    kept = kept[np.concatenate([[True], kept[1:] != kept[:-1]])]
    return np.repeat(kept, np.bincount(np.searchsorted(kept >> _U(22), key >> _U(32)), minlength=len(kept)))


def common_grams(texts: DataFrame, width: int) -> np.ndarray:
    """The hashes, sorted, of the ``COMMON`` n-grams found most often among those common in some stretch of texts; all texts are read.

    Which ones they are decides how much work the join does, never its result.
    """
    found = texts.select("__text").mapInArrow(lean(_look(width)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r.gram for r in found.orderBy(F.desc("n"), "gram").limit(COMMON).collect()], np.int64)).view(_U)


def _is_common(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(h), bool)
    return common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h


def _incidence(width: int, percent: int, common: np.ndarray):
    """Map step: for each text its set's hash, and its telling blocks unless the task has met an equal set.

    A copy names a row met before; the smallest id met so far is always given as a row of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classes(percent, 4096)
        seen: dict[int, int] = {}
        for b in batches:
            ids = b.column(0).to_numpy()
            if len(seen) > SEEN:
                seen.clear()
            for i, j, buf, offs in chunks(b.column(1)):
                keys, sizes = shingle_sets(buf, offs, width)
                if sizes.max(initial=0) >= c.low[-2]:
                    c = Classes(percent, 2 * int(sizes.max()))
                total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(keys & _MASK), dtype=_U)])
                upto = np.cumsum(sizes)
                whole = mix(total[upto] - total[upto - sizes] + mix(sizes.astype(_U)))
                mine = ids[i:j]
                kind = np.full(j - i, SET)
                fresh = sizes > 0
                sig = whole.view(np.int64).copy()
                for r in np.flatnonzero(fresh).tolist():
                    key, id_ = int(sig[r]), int(mine[r])
                    if (first := seen.get(key)) is not None:
                        fresh[r] = False
                        if first <= id_:
                            kind[r], sig[r] = COPY, first
                            continue
                    seen[key] = id_
                rows = np.flatnonzero(fresh)
                label = c.of(sizes[rows])
                rare = keys[~_is_common(keys & _MASK, common)]
                s0, r0, left0 = _blocks(rare, sizes, rows, label, c)
                s1, r1, left1 = _blocks(rare, sizes, rows, label + 1, c)
                row = np.concatenate([np.arange(j - i), r0, r1])
                most = (1 << (LEAVE_BITS - 1)) - 1
                leave = np.concatenate([np.zeros(j - i, np.int64), 2 * np.minimum(left0, most)[r0], 2 * np.minimum(left1, most)[r1] + 1])
                tag = (sizes[row] << (LEAVE_BITS + 2)) + (leave << 2) + np.concatenate([kind, np.full(len(r0) + len(r1), BLOCK)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([sig, s0.view(np.int64), s1.view(np.int64)])), pa.array(mine[row]), pa.array(tag.astype(np.int64))], ["sig", "id", "tag"])

    return run


_BUCKETS = "kind int, sig long, id long, n int, rep long, rep_n int, leave int"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce step over rows sorted by (sig, id): every set with its smallest id, and buckets of two or more rows.

    Runs of equal hashes are followed across batches; only the first row of a run is ever held.
    """
    last = None  # (sig, kind, rep, rep_n, held, leave)

    def out(kind, sig, ids, n, rep, rep_n, leave):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, t)) for x, t in zip((kind, sig, ids, n, rep, rep_n, leave), (np.int32, np.int64, np.int64, np.int32, np.int64, np.int32, np.int32), strict=True)], ["kind", "sig", "id", "n", "rep", "rep_n", "leave"])

    for b in batches:
        sig, ids, tag = (b.column(k).to_numpy() for k in range(3))
        kind, leave, n = tag & 3, (tag >> 2) & ((1 << LEAVE_BITS) - 1), tag >> (LEAVE_BITS + 2)
        if (copy := kind == COPY).any():
            yield out(kind[copy], sig[copy], ids[copy], n[copy], sig[copy], n[copy], leave[copy])
            sig, ids, kind, n, leave = sig[~copy], ids[~copy], kind[~copy], n[~copy], leave[~copy]
        if not len(sig):
            continue
        starts = np.concatenate([[True], (sig[1:] != sig[:-1]) | (kind[1:] != kind[:-1])])
        run = np.cumsum(starts) - 1
        first = np.flatnonzero(starts)
        rep, rep_n, size = ids[first].copy(), n[first].copy(), np.bincount(run)
        if last and last[0] == sig[0] and last[1] == kind[0]:
            rep[0], rep_n[0] = last[2], last[3]
            size[0] += 1
            if last[4]:
                yield out([last[1]], [last[0]], [last[2]], [last[3]], [last[2]], [last[3]], [last[5]])
        alone = (kind == SET) & (n == 0)
        emit = (kind == SET) | (size[run] > 1)
        hold = kind[-1] == BLOCK and size[-1] == 1
        last = (sig[-1], kind[-1], rep[-1], rep_n[-1], hold, leave[-1])
        yield out(kind[emit], sig[emit], ids[emit], n[emit], np.where(alone, ids, rep[run])[emit], np.where(alone, n, rep_n[run])[emit], leave[emit])


def _rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in chunks(b.column(1)):
                keys, sizes = shingle_sets(buf, offs, width)
                cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(cut), pa.array((keys & _MASK).view(np.int64)))], ["id", "grams"])

    return run


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Bounded stretches of (a, b, x, y) with the lengths of x and y."""
    for whole in batches:
        a_len, b_len = (np.diff(whole.column(k).offsets.to_numpy()).astype(np.int64) for k in (2, 3))
        upto = np.cumsum(a_len + b_len)
        s = 0
        while s < whole.num_rows:
            e = int(np.searchsorted(upto, (upto[s - 1] if s else 0) + GRAMS, "right"))
            e = min(max(e, s + 1), s + ENTRIES)
            yield whole.slice(s, e - s), a_len[s:e], b_len[s:e]
            s = e


def _product(percent: int):
    """Masked product of two stretches of rows, accumulated over blocks of columns; yields the entries that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, a_len, b_len in _batches(batches):
            n = b.num_rows
            left, right = (b.column(k).flatten().to_numpy().view(_U) for k in (2, 3))
            entry = np.concatenate([np.repeat(np.arange(n), a_len), np.repeat(np.arange(n), b_len)])
            cols, of_a = np.concatenate([left, right]), np.arange(len(left) + len(right)) < len(left)
            block = ((cols * _U(BLOCKS)) >> _U(HASH_BITS)).astype(np.int8)
            need = -(-(percent * (a_len + b_len)) // (100 + percent))
            have, rest_a, rest_b = np.zeros(n, np.int64), a_len.copy(), b_len.copy()
            for k in range(BLOCKS):
                live = (need > 0) & (have + np.minimum(rest_a, rest_b) >= need)
                mine = block == k
                keys = np.sort((entry[mine & live[entry]].astype(_U) << _U(HASH_BITS)) | cols[mine & live[entry]])
                both = keys[1:][keys[1:] == keys[:-1]] >> _U(HASH_BITS)
                have += np.bincount(both.astype(np.int64), minlength=n)
                rest_a -= np.bincount(entry[mine & of_a], minlength=n)
                rest_b -= np.bincount(entry[mine & ~of_a], minlength=n)
            ok = pa.array((need > 0) & (have >= need))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    return run


def _rows_of(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(id, grams): the rows of the incidence matrix that ``pairs`` (a, b) name; the texts are read once."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return materialize(docs.join(wanted, "id", "left_semi").mapInArrow(lean(_rows(width)), "id long, grams array<long>"), "grams")


def _beside(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """(a, b, x, y, ...): the rows of each pair. A counted list of pairs goes to the rows, so that only rows named by it are moved."""
    left, right = grams.withColumnsRenamed({"id": "a", "grams": "x"}), grams.withColumnsRenamed({"id": "b", "grams": "y"})
    more = [c for c in pairs.columns if c not in ("a", "b")]
    if pairs.count() <= BROADCAST_IDS:
        right = right.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
        pairs = F.broadcast(pairs)
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", *more)


def _sized(member: DataFrame) -> DataFrame:
    """``member`` with the ``size`` of its bucket ``sig``, without those that are alone there."""
    return member.join(member.groupBy("sig").agg(F.count("*").alias("size")).filter("size > 1"), "sig")


def _first_buckets(member: DataFrame) -> DataFrame:
    """(sig, id, n) of the members, but for the largest buckets of each row (in either class): as many as it has spare blocks left."""
    place = F.row_number().over(Window.partitionBy("id", "leave").orderBy(F.desc("size"), "sig"))
    return member.withColumn("place", place).filter(F.col("place") > F.shiftright("leave", 1)).select("sig", "id", "n")


def _small_pairs(member: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of members, beside the centre, of buckets of up to ``SMALL`` of them that lie in different components and whose sizes allow a link."""
    left = materialize(_named(member.filter(F.col("size") <= SMALL + 1).select("sig", "b", "n"), roots), "small-members")
    right = left.select("sig", *(F.col(c).alias(f"_{c}") for c in ("b", "n", "root")))
    fit = (F.col("b") < F.col("_b")) & (F.col("root") != F.col("_root")) & _sizes_fit(percent)
    return left.join(right, "sig").filter(fit).select(F.col("b").alias("a"), F.col("_b").alias("b")).distinct()


def _heads(member: DataFrame, roots: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """(gram, b, n, pos): the first n-grams of members ``b`` of larger buckets, ``pos`` others before them, on which components meet; of centres whose members lie in several."""
    far = materialize(_named(member.filter(F.col("size") > SMALL + 1).select("a", "b", "n").distinct(), roots), "far-members")
    mixed = far.groupBy("a").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("a")
    at = materialize(far.join(mixed, "a", "left_semi").select("b", "n", "root").distinct(), "open-members")
    some = F.broadcast(at) if at.count() <= BROADCAST_IDS else at
    entries = materialize(grams.withColumnRenamed("id", "b").join(some, "b").select("b", "n", "root", F.explode("grams").alias("gram")), "differences")
    seen = _meeting(entries, F.count("*").alias("seen")).select("gram", "seen")
    mine = Window.partitionBy("b")
    pos = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("seen", "gram")) - 1  # n-grams that only one component has come first
    heads = entries.join(seen, "gram").withColumn("pos", pos).filter(F.col("pos") * 100 <= F.col("n") * (100 - percent))
    heads = materialize(heads.select("gram", "b", "n", "root", "pos"), "heads")
    met = _meeting(heads, F.max(F.col("pos") * (100 + percent) <= F.col("n") * (100 - percent)).alias("early")).filter("early").select("gram")
    heads = materialize(heads.join(met, "gram", "left_semi").select("gram", "b", "n", "pos"), "meeting-heads")
    discard(far, at, entries)
    return heads


def _meeting(rows: DataFrame, *more: Column) -> DataFrame:
    """The n-grams that rows of different components have, with ``more`` about these rows."""
    return rows.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *more).filter("lo <> hi")


def _named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of their column b."""
    return rows.join(roots.withColumnRenamed("node", "b"), "b", "left").withColumn("root", F.coalesce("root", "b"))


def _sizes_fit(percent: int) -> Column:
    return F.least("n", "_n") * 100 >= percent * F.greatest("n", "_n")


def _may_link(percent: int) -> Column:
    """Whether two heads of one n-gram, the second's columns with a ``_``, lie in different components and may link."""
    bound = F.floor((F.col("n") + F.col("_n")) * (100 - percent) / (100 + percent))
    left_over = F.least(F.col("n") - F.col("pos"), F.col("_n") - F.col("_pos"))
    return (F.col("root") != F.col("_root")) & _sizes_fit(percent) & (2 * left_over >= F.col("n") + F.col("_n") - bound)


def _star_pairs(heads: DataFrame, roots: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b): the heads of each n-gram beside ``PARTNERS`` of them: at first those it stands earliest in, then any."""
    named = _named(heads, roots)
    order = [F.xxhash64("gram", "b", F.lit(turn))] if turn else ["pos", "b"]
    some = named.withColumn("rank", F.row_number().over(Window.partitionBy("gram").orderBy(*order))).filter(F.col("rank") <= PARTNERS)
    some = some.select("gram", *(F.col(c).alias(f"_{c}") for c in ("b", "n", "root", "pos")))
    return named.join(some, "gram").filter(_may_link(percent)).select(F.least("b", "_b").alias("a"), F.greatest("b", "_b").alias("b")).distinct()


def _open_pairs(heads: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of heads that lie in different components and may link."""
    named = _named(heads, roots)
    named = materialize(named.join(_meeting(named).select("gram"), "gram", "left_semi"), "open-heads")
    left = named.filter(F.col("pos") * (100 + percent) <= F.col("n") * (100 - percent))
    right = named.select("gram", *(F.col(c).alias(f"_{c}") for c in ("b", "n", "root", "pos")))
    smaller = (F.col("n") < F.col("_n")) | ((F.col("n") == F.col("_n")) & (F.col("b") < F.col("_b")))
    return left.join(right, "gram").filter(smaller & _may_link(percent)).select(F.col("b").alias("a"), F.col("_b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node of ``links`` (a, b) but the roots themselves.

    Large-star and small-star rounds: each ties neighbours to the smallest node known, until no edge changes.
    Rounds grow with the logarithm of the largest component; nothing but the counts goes to the driver.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def with_nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``__node``: its id, but where rows of an id have different texts, a hash from 2 ** 62 up for all but one text of the id."""
    tie, id_ = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.col(id_col).cast("long")
    several = docs.filter(F.col(id_col).isNotNull()).groupBy(id_.alias("__k")).agg(F.min(tie).alias("__own"), F.max(tie).alias("__top")).filter("__own <> __top").select("__k", "__own")
    several = materialize(several, "shared-ids")
    if not (n := several.count()):
        return docs.withColumn("__node", id_)
    both = docs.join(F.broadcast(several) if n <= BROADCAST_IDS else several, id_ == F.col("__k"), "left")
    other = F.xxhash64(id_, tie).bitwiseAND(F.lit(_OTHER - 1)).bitwiseOR(F.lit(_OTHER))
    return both.withColumn("__node", F.when(F.col("__own") != tie, other).otherwise(id_)).drop("__k", "__own")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` for every row: the smallest id reachable by links of ``percent`` or more.

    Null, empty and white texts have no shingles and are components of their own; so are texts shorter than
    ``width`` words unless another has the same words. Rows that share an id but not the text are nodes of their own. Rows with a
    null id link with nothing and get a null component. Other columns are ignored. Ids are integers below 2 ** 62.
    """
    texts = with_nodes(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text")), "id", "__text")
    found = _by_node(texts, width, percent)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _by_node(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, id, n_shingles, component_id) for every row of (id, __text, __node)."""
    found = _roots(texts.select(F.col("__node").alias("id"), "__text"), width, percent)
    if texts.filter(F.col("__node") >= _OTHER).isEmpty():
        return found.select(F.col("id").alias("node"), "id", "n_shingles", F.col("root").alias("component_id"))
    named = texts.filter(F.col("__node") >= _OTHER).select(F.col("__node").alias("node"), F.col("id").alias("__doc")).distinct()
    found = found.withColumnRenamed("id", "node").join(named, "node", "left").withColumn("id", F.coalesce("__doc", "node"))
    low = found.filter("__doc is not null").groupBy(F.col("root").alias("__r")).agg(F.min("__doc").alias("__low"))
    found = found.join(F.broadcast(low) if named.count() <= BROADCAST_IDS else low, F.col("root") == F.col("__r"), "left")
    return found.select("node", "id", "n_shingles", F.least("root", "__low").alias("component_id"))


def _roots(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, n_shingles, root) for every row of (id, __text)."""
    spark = texts.sparkSession
    known, unknown = texts.filter("id is not null"), texts.filter("id is null")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    common = common_grams(known, width)
    entries = known.mapInArrow(lean(_incidence(width, percent, common)), "sig long, id long, tag long")
    buckets = materialize(entries.repartition(n, "sig").sortWithinPartitions("sig", "id").mapInArrow(lean(_gather), _BUCKETS), "buckets")
    sets = buckets.filter(F.col("kind") == SET).select("id", "n", "rep")
    moved = sets.filter("id <> rep").select("id", "rep").distinct()

    def to_sets(pairs: DataFrame, *names: str) -> DataFrame:
        for c in names:
            pairs = pairs.join(moved.withColumnsRenamed({"id": c, "rep": f"__{c}"}), c, "left").withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
        return pairs

    # buckets of different sets, each with its centre
    member = to_sets(buckets.filter(F.col("kind") == BLOCK).select("sig", "id", "n", "leave"), "id").distinct()
    member = materialize(_sized(_first_buckets(_sized(member))), "members")
    weight = member.groupBy("id").agg(F.sum("size").alias("weight"))
    centre = member.join(weight, "id").groupBy("sig").agg(F.max(F.struct("weight", (-F.col("id")).alias("back"))).alias("top")).select("sig", (-F.col("top.back")).alias("a"))
    member = materialize(member.join(centre, "sig").filter("id <> a").select("sig", "a", F.col("id").alias("b"), "n", "size"), "around")
    star = materialize(member.select("a", "b").distinct(), "pairs")
    grams = _rows_of(known, star, width)
    linked = "a long, b long"
    links = materialize(_beside(star, grams).mapInArrow(lean(_product(percent)), linked), "links")
    roots = components(links)

    def joined(pairs: DataFrame) -> DataFrame:
        """The components when the links among ``pairs`` are added."""
        more = materialize(_beside(pairs, grams).mapInArrow(lean(_product(percent)), linked), "links")
        return roots if more.isEmpty() else components(roots.toDF("a", "b").union(more))

    roots = joined(materialize(_small_pairs(member, roots, percent), "small-pairs"))
    heads = _heads(member, roots, grams, percent)
    # members that meet on a gram are first tied through a few of them; all pairs are left only between components
    for turn in range(TURNS):
        pairs = materialize(_star_pairs(heads, roots, percent, turn), "star-pairs")
        if pairs.isEmpty():
            break
        roots = joined(pairs)
    roots = joined(materialize(_open_pairs(heads, roots, percent), "open-pairs")).withColumnsRenamed({"node": "rep"})
    # the smallest id of each set stands for it, so the smallest root is the smallest id reachable
    few = roots.count() <= BROADCAST_IDS
    done = sets.join(F.broadcast(roots) if few else roots, "rep", "left").select("id", "n", F.coalesce("root", "rep").alias("root"))
    copies = buckets.filter(F.col("kind") == COPY).select("id", "n", F.col("rep").alias("near"))
    done = done.union(copies.join(done.select(F.col("id").alias("near"), "root").distinct(), "near").select("id", "n", "root"))
    done = done.select("id", F.col("n").cast("long").alias("n_shingles"), "root")
    lost = unknown.mapInArrow(lean(_rows(width)), "id long, grams array<long>").select("id", F.size("grams").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("root"))
    return done.union(lost)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; rows with a null id stay. Of rows equal in id and text one stays."""
    marked = with_nodes(docs, id_col, text_col)
    texts = marked.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text"), "__node")
    found = materialize(_by_node(texts, width, percent).filter("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("component_id").alias("component_id")), "nodes")
    send = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df
    gone = materialize(found.filter("id > component_id").select(F.col("node").alias("__node")), "gone")
    kept = marked.join(send(gone), "__node", "left_anti")
    twice = materialize(found.filter("n > 1 and id = component_id").select(F.col("node").alias("__node")), "repeated-rows")
    if twice.isEmpty():
        return kept.drop("__node")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    once = kept.join(send(twice), "__node", "left_semi").select("__node", row).groupBy("__node").agg(F.first("__row").alias("__row")).select("__row.*")
    return kept.join(send(twice), "__node", "left_anti").drop("__node").union(once)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=90)


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM words
), size AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), overlap AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM overlap JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), edge AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edge e ON e.x = r.node
)
SELECT r.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, min(r.node)::BIGINT AS component_id FROM reach r LEFT JOIN size s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""
