import random
import re
from collections import Counter

import pytest

from freshet.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"
LOW = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def by_hand(rows, longest=3, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    long = {}
    for (lang, p), c in f.items():
        if c >= least and len(p) > 2:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    long[lang, p[i : i + k]] = max(c, long.get((lang, p[i : i + k]), 0))
    out = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least and 100 * long.get((lang, p), 0) < share * a:
            score, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def sample(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "city", "é", "漢", "a-b", "x\x00y", "'"]
    make = lambda: "".join(rng.choice(vocabulary) + rng.choice([" "] * 9 + ["\t", ", ", ".", "\n", "  ", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
    return [(k % 100, rng.choice([None, "", make(), make(), make()]), rng.choice(["en", "de", "und", None])) for k in range(n)]


@pytest.mark.parametrize("seed,more", [(1, {}), (2, {"least": 3, "top": 20}), (3, {"longest": 4, "least": 2, "share": 80}), (4, {"longest": 2, "least": 5})])
def test_phrases_equal_counting_by_hand(spark, seed, more):
    rows = sample(seed)
    want = by_hand([(t, lang) for _, t, lang in rows], **more)
    for broadcast in (1 << 20, 0):
        got = C.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), broadcast_groups=broadcast, **more)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == want
    assert want


def test_files_read_together(spark):
    """Small files of a relation are read in order of their sizes, not of their documents."""
    rows = sample(5, 400)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = sorted(map(tuple, C.collocations(spark.createDataFrame(rows, SCHEMA).repartition(40), least=3).collect()))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == by_hand([(t, lang) for _, t, lang in rows], least=3)


def test_odd_rows(spark, odd, none):
    assert C.collocations(none).collect() == []
    rows = odd.collect()
    assert sorted(map(tuple, C.collocations(odd, least=2).collect())) == by_hand([(r.text, r.lang) for r in rows], least=2)


def test_a_text_over_a_chunk_and_repeated_rows(spark):
    rng = random.Random(7)
    long = " ".join(rng.choice(["ab", "cd", "efg", "h."]) for _ in range(400_000))
    assert len(long) > 1 << 20
    rows = [(1, long, "en"), (1, long, "en"), (None, "ab cd", "en")]
    assert sorted(map(tuple, C.collocations(spark.createDataFrame(rows, SCHEMA)).collect())) == by_hand([(t, lang) for _, t, lang in rows])


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**13
    for a, l, r in [(big, big, big), (big - 1, big + 7, big * 3 + 1), (999_999_937, 10**12 + 39, 10**13 + 37), (10, 10, 11)]:
        row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(C._ratio("a", "l", "r").alias("s")).first()
        assert row.s == 10**6 * a * a // (l * r)


def test_groups_numbered_past_31_bits_count_alike(spark):
    import numpy as np
    import pyarrow as pa

    at = pa.array([[0, 1, 2, 3], [0, 1]], pa.list_(pa.int32()))
    for kind in (pa.int32(), pa.int64()):
        code = pa.array([[5, 5, 5, 6], [5, 6]], pa.list_(kind))
        made = pa.Table.from_batches(C._count_pairs(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), at, code], ["doc", "at", "code"])])))
        assert sorted(zip(*(made[c].to_pylist() for c in ("left", "right", "n")), strict=True)) == [(5, 5, 2), (5, 6, 2)]
    assert np.dtype("int64") == made["left"].to_numpy().dtype


def test_occurrences_out_of_order_are_refused():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array([2, 1], pa.int32()), pa.array([1, 1], pa.int32())], ["doc", "at", "id"])
    with pytest.raises(ValueError, match="order"):
        list(C._nest(iter([b])))
