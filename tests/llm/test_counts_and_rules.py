import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from freshet.llm import quality_rules as Q
from freshet.llm import token_counts as T

from .conftest import ODD


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))


def test_token_counts_equal_the_library(spark, sf, texts, library):
    got = {r.doc_id: r for r in T.op1_token_counts(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len(t.encode()), n > 2048)


def test_token_counts_of_odd_texts(odd, none, library):
    got = T.count_tokens(odd, public_tokenizers.path(T.VOCABULARY)).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        assert r.n_tokens == len(library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids), ODD[r.doc_id]
    assert T.count_tokens(none, public_tokenizers.path(T.VOCABULARY)).count() == 0


def test_whole_tokens_are_proven(library):
    c = T.counter(public_tokenizers.path(T.VOCABULARY))
    assert len(c.whole) > 30000
    for w in [*c.whole][:: len(c.whole) // 500]:
        if c.words.findall(w) == [w] and w == w.lower():
            assert len(library.encode(w, add_special_tokens=False).ids) == 1


def brute(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:]))
    cover = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


def slack(r, k):
    unit = Q.RATIOS[k]
    return (Q.EVENTS + Q.SPREAD * math.sqrt(r[f"mid_{k}"] * r[unit])) / r[unit]


def test_rules_equal_brute_force(spark, sf, texts):
    for r in Q.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        b = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        over = any(r[k] > r[f"max_{k}"] + slack(r, k) for k in Q.RATIOS)
        assert r.kept == (not r.base_failed and not over)


def test_rules_on_odd_texts(odd, none):
    got = Q.judge(odd).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(ODD[r.doc_id]), ODD[r.doc_id]
        assert r.kept is not None
    assert Q.judge(none).count() == 0


def test_sketches_merge(odd):
    counts = Q.text_counts(odd)
    whole = {tuple(r[:4]): r.n for r in Q.sketch(counts).collect()}
    parts = Counter()
    for k in (0, 1):
        for r in Q.sketch(counts.filter(f"doc_id % 2 = {k}")).collect():
            parts[tuple(r[:4])] += r.n
    assert whole == dict(parts)


def test_rules_keep_clean_labelled_texts(spark):
    sf = "/root/testdata/sf0.01"
    rows = Q.op8_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.98 * len(clean)
    assert sum(junk) <= 0.15 * len(junk)


def quantile(values, p):
    """The middle of the 2 % bin that holds the p-quantile."""
    bins = sorted(math.floor(math.log(max(v, 1e-4)) / math.log(Q.WIDTH)) for v in values)
    return Q.WIDTH ** (bins[math.ceil(p * len(bins)) - 1] + 0.5)


def test_limits_equal_brute_force_and_adapt(spark):
    sf = "/root/testdata/sf0.01"
    rows = Q.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    groups, langs = {}, {}
    for r in rows:
        groups.setdefault((r.lang, r.source), []).append(r)
        langs.setdefault(r.lang, []).append(r)
    blend = lambda own, wide, n: (n * own + Q.PRIOR * wide) / (n + Q.PRIOR)
    for k in Q.RATIOS:
        found = set()
        for (lang, _), mine in groups.items():
            q = [blend(quantile([r[k] for r in mine], p), blend(quantile([r[k] for r in langs[lang]], p), quantile([r[k] for r in rows], p), len(langs[lang])), len(mine)) for p in (0.1, 0.5)]
            limit = q[1] + Q.SPREAD * (q[1] - q[0])
            limit = limit if k in Q.MEANS else min(limit, (1 + min(1, q[1])) / 2)
            assert {round(r[f"mid_{k}"], 9) for r in mine} == {round(q[1], 9)}
            assert {round(r[f"max_{k}"], 9) for r in mine} == {round(limit, 9)}
            found.add(round(limit, 6))
        assert len(found) > 10 or k not in ("upper_share", "word_length")  # half of the texts of every group have none of the others


def test_same_text_other_source_other_verdict(spark):
    words = [f"w{i}" for i in range(400)]
    text = lambda k, marks: " ".join(w + "#" * (j % 10 < marks) for j, w in enumerate(words[k : k + 100]))
    rows = [(k, text(k, 4 + k % 3), "en", "code") for k in range(200)] + [(1000 + k, text(k, 0), "en", "prose") for k in range(200)] + [(5000, text(7, 5), "en", "code"), (5001, text(7, 5), "en", "prose")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in Q.judge(docs).collect()}
    assert kept[5000] and not kept[5001]
    assert all(v for k, v in kept.items() if k != 5001)
    assert {r.doc_id for r in Q.keep_good(docs).collect()} == set(kept) - {5001}


def _clean(rng, n=120):
    """Words, now and then a capital, a line end or an exclamation mark."""
    words = ["".join(rng.choice("aeionrstlmdu") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    return "".join((w.capitalize() if rng.random() < 0.1 else w) + rng.choice([" "] * 40 + ["\n", "! "]) for w in words)


def _kept(spark, texts):
    rows = Q.judge(spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")).collect()
    return {r.doc_id: r.kept for r in rows}


@pytest.mark.parametrize("percent", [5, 9, 11, 15, 30, 45])
def test_junk_is_rejected_whatever_its_share(spark, percent):
    rng = random.Random(percent)
    n = 600
    bad = n * percent // 100
    junk = [" ".join(rng.choice(["#$%&", w]) for w in _clean(rng).split()) for _ in range(bad)]
    kept = _kept(spark, junk + [_clean(rng) for _ in range(n - bad)])
    assert not any(kept[i] for i in range(bad)) and sum(kept[i] for i in range(bad, n)) >= 0.99 * (n - bad)


def test_every_ratio_can_reject(spark):
    rng = random.Random(8)
    clean = [_clean(rng) for _ in range(400)]
    lines = _clean(rng).replace("\n", " ").split()
    planted = {
        "symbol_share": _clean(rng).replace("a", "#"), "upper_share": _clean(rng).upper(), "bang_share": _clean(rng).replace(" ", "! "), "word_length": " ".join(f"{k:x<60}" for k in range(80)),
        "repeat_share": "".join(w + ("\n" if k % 8 == 7 else " ") for k, w in enumerate(lines[:40] + lines[:3] * 18 + lines[40:])), "dup_line_share": "\n".join(w for w in lines for _ in range(2)),
    }
    docs = spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(clean + list(planted.values()))], "doc_id long, text string, lang string, source string")
    rows = {r.doc_id: r for r in Q.judge(docs).collect()}
    for k, (name, _) in enumerate(planted.items(), len(clean)):
        r = rows[k]
        assert not r.base_failed and not r.kept, name
        assert r[name] > r[f"max_{name}"] + slack(r, name), name
        assert name in Q.MEANS or r[f"max_{name}"] < 1
    assert sum(rows[k].kept for k in range(len(clean))) >= 0.99 * len(clean)
