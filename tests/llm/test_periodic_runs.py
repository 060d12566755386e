import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import periodic_runs as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(w, shortest=12):
    """Maximal stretches for every period, smallest period of each stretch."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(shortest, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def edited(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def words_of(texts):
    joined = [" ".join(t).encode() for t in texts]
    buf = np.frombuffer(b"".join(joined), np.uint8)
    offs = np.cumsum([0, *map(len, joined)])
    from freshet.llm.texts import WHITE, pieces

    return buf, *pieces(buf, offs, WHITE)


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_those_of_every_period(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        w = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            at = rng.randint(0, len(w))
            w[at:at] = unit * rng.randint(2, 6) + unit[: rng.randint(0, len(unit))]
        texts.append(w)
    for shortest in (12, 5):
        buf, start, end, row = words_of(texts)
        begin, length, period = P.runs_of(buf, start, end, row, shortest)
        first = np.searchsorted(row, np.arange(len(texts)))
        got = [[] for _ in texts]
        for s, n, q in zip(begin.tolist(), length.tolist(), period.tolist(), strict=True):
            got[row[s]].append((s - int(first[row[s]]), n, q))
        assert got == [slow_runs(t, shortest) for t in texts]


def test_operator_on_odd_rows(spark, odd, none):
    assert P.periodic_runs(none).count() == 0
    got = P.periodic_runs(odd).collect()
    want = {r.doc_id: r.text for r in odd.collect()}
    assert len(got) == odd.count()
    for r in got:
        w = WORD.findall(want[r.doc_id] or "")
        runs = slow_runs(w) if len(w) < 500 else [(0, len(w), 1)]
        assert [tuple(x) for x in r.runs] == runs and r.n_words == len(w) and r.text == collapsed(w, runs)


def test_null_and_repeated_ids(spark):
    t = "a b " * 10
    rows = P.periodic_runs(spark.createDataFrame([(None, t), (1, t), (1, t), (1, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, len(r.runs), r.text) for r in rows) == [(0, 1, "a b"), (1, 0, ""), (1, 1, "a b"), (1, 1, "a b")]


def test_a_long_text(spark):
    """Over a chunk of 1 MB: distinct words, then 7 words over and over."""
    w = [f"w{i}" for i in range(60_000)] + [f"x{i % 7}" for i in range(400_000)]
    text = " ".join(w)
    assert len(text) > 1 << 20
    row = P.periodic_runs(spark.createDataFrame([(1, text), (2, "a")], "doc_id long, text string")).filter("doc_id = 1").first()
    assert [tuple(r) for r in row.runs] == [(60_000, 400_000, 7)] and row.text == " ".join(w[:60_007])


def test_query_equals_brute_force(spark, sf, texts):
    rows = P.op11_periodic_runs(spark, sf).collect()
    assert len(rows) == len(texts)
    assert sum(r.n_runs for r in rows) > 0
    for r in rows:
        w = edited(r.doc_id, texts[r.doc_id])
        if len(w) > 1500:
            continue  # quadratic
        runs = slow_runs(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()


def test_planted_words(spark, sf, texts):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", P.planted(F.col("doc_id"), F.col("text")).alias("t")).collect()
    assert all(WORD.findall(r.t or "") == edited(r.doc_id, texts[r.doc_id]) for r in rows)
