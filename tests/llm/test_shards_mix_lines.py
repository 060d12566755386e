import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from freshet.llm import line_dedup as L
from freshet.llm import mixing as M
from freshet.llm import sharding as S

from .conftest import ODD


def size(t):
    return len((t or "").encode()) + 1


def test_shards_are_even_and_gapless(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = S.op9_sharding(spark, sf).collect()
    assert {r.doc_id for r in got} == docs.keys() and len(got) == len(docs)
    loads, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        t = docs[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (size(t), zlib.crc32(t.encode()), "bytes", None)
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[t].add(r.shard)
    assert sorted(loads) == list(range(16))
    mean = sum(loads.values()) / 16
    longest = max(map(size, docs.values()))
    assert max(abs(x - mean) for x in loads.values()) <= longest + 0.05 * mean
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert max(map(len, groups.values())) <= 2


def test_a_hot_group_is_cut_and_small_groups_are_not(spark):
    texts = [(i, "copy " * 20) for i in range(3000)] + [(i, f"text {i % 2500} " * 9) for i in range(3000, 8000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = S.shard_by_bytes(df).select("row.doc_id", "size", "shard", "slot").collect()
    loads, split = Counter(), defaultdict(set)
    for r in got:
        loads[r.shard] += r.size
        split[texts[r.doc_id][1]].add(r.shard)
    mean = sum(loads.values()) / 16
    assert all(abs(x - mean) < 0.06 * mean for x in loads.values())
    assert len(split.pop("copy " * 20)) >= 6 and all(len(x) == 1 for x in split.values())


def test_shards_of_odd_rows(odd, none):
    got = S.shard_by_bytes(odd).collect()
    assert sorted(r["row"]["doc_id"] for r in got) == sorted([*range(len(ODD)), 5, 6])
    assert all(r["size"] == size(ODD[r["row"]["doc_id"]]) and r["row"]["hash"] == "clash" for r in got)
    assert S.shard_by_bytes(none).count() == 0


def tokens(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1


@pytest.mark.parametrize("how", [{}, {"max_repeats": None, "target_entropy": 0.97, "budget": 300_000}, {"max_repeats": 3.0}])
def test_mix_meets_its_quotas(spark, how):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumn("source", __import__("pyspark").sql.functions.expr("case when doc_id % 3 = 0 then 'hot' when doc_id % 7 = 0 then null else source end"))
    by = {r.doc_id: (r.source or "", tokens(r.text)) for r in docs.collect()}
    got = M.mix_sources(docs, **how).select("row.doc_id", "source", "tokens", "epoch", "block_rank", "position").collect()
    have, want = Counter(), Counter()
    for s, n in by.values():
        have[s] += n
    share = {s: n / sum(have.values()) for s, n in have.items()}
    probe = spark.createDataFrame([(s, n, share[s]) for s, n in have.items()], "source string, tokens long, share double")
    alpha = M.exponent(probe, how.get("target_entropy"), how.get("max_repeats", M.MAX_REPEATS), how.get("budget"))
    raw = {s: share[s] ** alpha for s in share}
    z = sum(raw.values())
    budget = how.get("budget") or z * max(have[s] / raw[s] for s in raw)
    longest = max(n for _, n in by.values())
    seen = set()
    for r in got:
        assert (r.source, r.tokens) == by[r.doc_id]
        assert (r.doc_id, r.epoch) not in seen
        seen.add((r.doc_id, r.epoch))
        want[r.source] += r.tokens
    for s in raw:
        quota = budget * raw[s] / z
        assert quota - longest <= want[s] <= quota + 1
    if not how.get("budget"):
        assert {k for k, e in seen if e == 0} == by.keys()
        assert max(want[s] / have[s] for s in have) <= how.get("max_repeats", M.MAX_REPEATS) + 1e-3
    else:
        import math

        assert abs(-sum(x / z * math.log(x / z) for x in raw.values()) - 0.97 * math.log(len(raw))) < 1e-3
    again = M.mix_sources(docs.repartition(7), **how).select("row.doc_id", "source", "tokens", "epoch", "block_rank", "position").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in again}


def test_mix_of_odd_rows(odd, none):
    got = M.mix_sources(odd).collect()
    assert {r["row"]["doc_id"] for r in got} == set(range(len(ODD)))
    assert M.mix_sources(none).count() == 0


def cut_up(text):
    return re.split(r"(?<=\n)|(?<=[.!?] )", text)


def brute_lines(texts):
    """(text, lines, removed pieces) by key; keys sort like (id, ...)."""
    parts = {k: (cut_up(t) if t is not None else []) for k, t in texts.items()}
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    first, gone, wins = {}, defaultdict(set), []
    for k in sorted(parts):
        at = [i for i, x in enumerate(parts[k]) if strip(x)]
        for i in range(len(at) - 2):
            w = tuple(strip(parts[k][p]) for p in at[i : i + 3])
            first.setdefault(w, (k, i))
            wins.append((w, k, i, at[i : i + 3]))
    for w, k, i, at in wins:
        if first[w] != (k, i):
            free = min(3, first[w][1] + 3 - i) if first[w][0] == k else 0
            gone[k] |= set(at[max(0, free) :])
    out = {}
    for k, t in texts.items():
        left = "".join(x for i, x in enumerate(parts[k]) if i not in gone[k])
        if parts[k] and len(parts[k]) - 1 in gone[k] and left[-1:] in (" ", "\n"):
            left = left[:-1]
        out[k] = (None, 0, 0) if t is None else (left, t.count("\n") + 1, len(gone[k]))
    return out


def test_lines_equal_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in L.op5_line_dedup(spark, sf).collect()}
    assert got == brute_lines(docs) and any(x[2] for x in got.values())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert {r[0]: r[1:] for r in con.execute(L.OP5_SQL).fetchall()} == got


def test_lines_of_odd_rows(spark, odd, none):
    more = {100: "a\nb\nc\nd", 101: "z\n a\nb \nc\nd\ny", 102: "q\nq\nq\nq\nq\nq", 103: "b\nc\nd\n\nb\nc\nd"}
    one = spark.createDataFrame([(k, v, None, None, 0, "", 0) for k, v in more.items()], odd.schema)
    rows = odd.dropDuplicates(["doc_id"]).union(one)
    got = {r["row"]["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in L.dedup_lines(rows).collect()}
    assert got == brute_lines({**dict(enumerate(ODD)), **more})
    assert got[101][0] == "z\ny" and got[103][0] == "" and got[102][2] == 3
    assert L.dedup_lines(none).count() == 0
    twice = {(r["row"]["doc_id"], r["text"], r["n_removed"]) for r in L.dedup_lines(odd).collect() if r["row"]["doc_id"] in (5, 6)}
    assert twice == {(5, ODD[5], 0), (6, ODD[6], 0)}


def test_lines_of_shared_ids(spark):
    a, b, c = "a\nb\nc\nd", "x\na\nb\nc", "u1\nu2\nu3\nu4"
    df = spark.createDataFrame([(1, a), (2, b), (2, c), (2, c), (None, a), (3, a)], "doc_id long, text string")
    got = sorted((r["row"]["doc_id"] or 0, r["row"]["text"], r["text"], r["n_removed"]) for r in L.dedup_lines(df).collect())
    # the null id counts as the first occurrence and stays whole; the repeated row is one document with its twin
    assert got == sorted([(0, a, a, 0), (1, a, "", 4), (2, b, "x", 3), (2, c, c, 0), (2, c, c, 0), (3, a, "", 4)])


def test_passages_in_one_long_line(spark):
    passage = " ".join(f"Sentence {i} has its own {i * 7} words and goes on for a while until it ends." for i in range(5))
    texts = {1: "Head of one. " + passage + " Tail of one.", 2: "Quite another text stands here. " + passage + " And it ends otherwise.", 3: "short. short. short. short.", 4: "short. short. short. short too."}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["text"] for r in L.dedup_lines(df).collect()}
    assert got == {**texts, 2: "Quite another text stands here. And it ends otherwise.", 3: "short. short. short.", 4: "short too."}
    assert got == {k: v[0] for k, v in brute_lines(texts).items()}


@pytest.mark.parametrize("n", [60, 199, 200, 201, 5000])
def test_the_length_of_a_line_does_not_matter(spark, n):
    passage = "One is said here. Two is said here. Three is said."
    texts = {1: passage, 2: "x" * (n - len(passage) - 3) + ". " + passage + "!", 3: "y" * (n - len(passage) - 2) + "! " + passage}
    assert len(texts[2]) == len(texts[3]) == n
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["text"] for r in L.dedup_lines(df).collect()}
    assert got == {1: passage, 2: texts[2], 3: "y" * (n - len(passage) - 2) + "!"}
    assert got == {k: v[0] for k, v in brute_lines(texts).items()}


def test_a_line_above_a_chunk(spark):
    passage = " ".join(f"Sentence {i} of many says {i * i}." for i in range(60_000))
    assert len(passage) > 1 << 20
    df = spark.createDataFrame([(1, passage), (2, "Another head. " + passage)], "doc_id long, text string")
    got = {r["row"]["doc_id"]: (r["text"], r["n_removed"]) for r in L.dedup_lines(df).collect()}
    assert got == {1: (passage, 0), 2: ("Another head.", 60_000)}


def test_hot_windows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_SHARE", 0.02)
    texts = {i: "Licence line one.\nLicence line two.\nLicence line three.\n" * (i % 3) + f"own {i % 40}\nwords {i % 40}\nhere {i % 40}\nrow {i}" for i in range(300)}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    assert {r["row"]["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in L.dedup_lines(df).collect()} == brute_lines(texts)


def test_texts_are_cut_once_for_the_windows(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd")], "doc_id long, text string")
    assert L.line_windows(df, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_only_ascii_white_space_is_trimmed(spark):
    texts = {1: "b\nc\nz \u2028", 2: "b\nc\nz\u2028", 3: "\x0b b \r\n\n c\t\nz\u2028 \x0c", 4: "z\x85\u3000\n\n \nb\nc", 5: "z\x85\u3000\nb\nc\n \nq", 6: "z\x85\nb\nc"}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r["row"]["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in L.dedup_lines(df).collect()}
    assert got == brute_lines(texts)
    assert got[2][2] == 0 and got[3][2] == 3 and got[5] == (" \nq", 5, 3) and got[6][2] == 0


def test_few_and_many_removed_pieces_take_the_same_join(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "b\nc\nd\ne")], "doc_id long, text string")
    out = L.dedup_lines(df)
    assert "broadcast" not in out._jdf.queryExecution().optimizedPlan().toString().lower()  # no hint by which the work would change with the input
    assert sorted((r["row"]["doc_id"], r["text"]) for r in out.collect()) == [(1, "a\nb\nc\nd"), (2, "e")]
