import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from freshet.llm import fingerprints as P
from freshet.llm.texts import span_hashes

from .conftest import ODD


def jaccard(x, y):
    x, y = (Counter(t.split()) for t in (x, y))
    top = sum((x | y).values())
    return sum((x & y).values()) / top if top else 1.0


def check(rows, texts):
    order = sorted(texts, reverse=True)
    follow = {k: texts[order[(i + 1) % len(order)]] or "" for i, k in enumerate(order)}
    assert len(rows) == len(texts)
    off = []
    for r in rows:
        t = texts[r.doc_id] or ""
        e = P.edited(t, follow[r.doc_id])
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        off += [r.near_edited - jaccard(t, e), r.near_next - jaccard(t, follow[r.doc_id])]
    return np.array(off)


def test_likeness_follows_weighted_jaccard(spark, sf, texts):
    rows = P.op7_fingerprints(spark, sf).collect()
    off = check(rows, texts)
    assert abs(off.mean()) < 0.01 and np.abs(off).mean() < 0.06 and np.abs(off).max() < 0.35
    by = {}
    for r in rows:
        assert by.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert sum(r.near_edited for r in rows) > 1.5 * sum(r.near_next for r in rows)


def test_next_document_across_ranges_and_partitions(spark):
    texts = {i * 7 - 900: " ".join(f"w{(i * k) % 53}" for k in range(i % 40)) for i in range(400)}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    a = P.fingerprint_edits(df).collect()
    check(a, texts)
    assert {tuple(r) for r in a} == {tuple(r) for r in P.fingerprint_edits(df.repartition(9)).collect()}


def test_odd_rows(spark, odd, none):
    check(P.fingerprint_edits(odd.dropDuplicates(["doc_id"])).collect(), dict(enumerate(ODD)))
    assert P.fingerprint_edits(odd).count() == len(ODD) + 2
    assert P.fingerprint_edits(none).count() == 0
    one = P.fingerprint_edits(odd.filter("doc_id = 6")).dropDuplicates().collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(17, 1.0)]
    lost = spark.createDataFrame([(None, "a b"), (None, "c d"), (3, "e f"), (3, "g h")], "doc_id long, text string")
    assert P.fingerprint_edits(lost).count() == 4
    assert P.fingerprint(odd).count() == len(ODD) + 2


def test_rows_without_id_and_of_one_id_are_spread(spark):
    rows = [(None, f"lost {i} of many") for i in range(900)] + [(7, f"text {i} of seven") for i in range(900)] + [(i, f"row {i}") for i in range(-100, 100) if i != 7]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.fingerprint_edits(df)
    tie = {r.text: r.t for r in df.selectExpr("text", "xxhash64(text) as t").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]), reverse=True)
    want = Counter()
    for i, (k, t) in enumerate(order):
        want[k, len(t), hashlib.sha256(P.edited(t, order[(i + 1) % len(order)][1]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got.collect()) == want
    spread = [sum(1 for _ in p) for p in got.rdd.glom().collect()]
    assert max(spread) < 2 * sum(spread) / len(spread)
    where = df.select("doc_id", "text", P._ranges(df.doc_id, P.F.xxhash64("text"), [-5, 7, 7, 7, 8], 5).alias("r")).collect()
    parts = lambda *ids: len({w.r for w in where if w.doc_id in ids})
    assert (parts(None), parts(7), parts(0, 3, 6), parts(8)) == (8, 8, 1, 1)
    ordered = sorted(where, key=lambda w: (w.doc_id is not None, w.doc_id or 0, tie[w.text]))
    assert [w.r for w in ordered] == sorted(w.r for w in where)


def test_many_bounds(spark):
    bounds = [k * k for k in range(20_000)]
    df = spark.createDataFrame([(k,) for k in (-1, 0, 1, 2, 99, 10_000, 10_001, 399_960_001, 10**12)], "v long")
    got = {r.v: r.n for r in df.select("v", P._below(df.v, bounds).alias("n")).collect()}
    assert got == {v: sum(b < v for b in bounds) for v in got}


def test_collisions_equal_jaccard_for_many_samples():
    x, y = "a a a b b c d e f f", "a b b b c d g h f"
    s = P.signatures(pa.array([x, y, "", None, "q"]), 20000)
    assert abs(P.likeness(s[:1], s[1:2])[0] - jaccard(x, y)) < 0.012
    assert not s[2].any() and not s[3].any() and s[4].all()


@pytest.mark.parametrize("n", [0, 999, 1000, 1001, 2000])
def test_any_number_of_rows_in_one_task(spark, n):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        texts = {i: f"text {i} of some {i % 7} words" for i in range(n)}
        df = spark.createDataFrame([*texts.items()], "doc_id long, text string").coalesce(1)
        check(P.fingerprint_edits(df).collect(), texts) if n else P.fingerprint_edits(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_very_long_texts(spark):
    texts = {1: " ".join(f"w{i * i % 99991}" for i in range(400_000)), 2: "short", 3: "x" * 2_500_000}
    assert len(texts[1]) > 2 << 20
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").coalesce(1)
    check(P.fingerprint_edits(df).collect(), texts)
    s = P.signatures(pa.array([texts[1], texts[1]]))
    assert (s[0] == s[1]).all()


def scalar(text, k):
    """The samples of one text, a term and a sample at a time."""
    M, f = (1 << 64) - 1, np.float32

    def mix(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & M
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & M
        return h ^ h >> 31

    out = []
    raw = text.encode()
    terms = Counter(text.split())
    hashes = {}
    for w in terms:
        at = raw.index(w.encode()) if raw.startswith(w.encode()) else raw.index(b" " + w.encode()) + 1
        hashes[w] = int(span_hashes(np.frombuffer(raw, np.uint8), np.array([at]), np.array([at + len(w.encode())]))[0]) >> 10
    for i in range(1, k + 1):
        best = None
        for w, n in terms.items():
            h = mix(hashes[w] ^ mix(i * 0x9E3779B97F4A7C15 & M))
            g = mix((h + 0xD1B54A32D192ED03) & M)
            u = [(f(x >> s & (1 << 21) - 1) + f(0.5)) * f(2.0**-21) for x, s in ((h, 0), (h, 21), (h, 42), (g, 0), (g, 21))]
            r, log_c = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3]))
            t = np.floor(np.log(f(n)) / r + u[4])
            a = log_c - r * (t - u[4] + f(1))
            now = (a, max(mix((h + int(t)) & M) >> 48, 1))
            best = now if best is None or now < best else best
        out.append(best[1])
    return out


def test_samples_equal_a_scalar_reference():
    for text in ("one", "a b a c a b d e", "the cat sat on the mat the end", "x y z x y x " * 9 + "tail"):
        assert P.signatures(pa.array([text, "other words"]), 48)[0].tolist() == scalar(text, 48)
        assert P.signatures(pa.array([text]), 48)[0].tolist() == scalar(text, 48)
