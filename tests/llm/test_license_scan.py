import re

import pytest

from freshet.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def base_of(text):
    w = words(text)
    return sorted((i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def lcs_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def found_by_brute_force(text):
    """Labels with some stretch of words whose common subsequence with a template makes up SHARE of both."""
    w, out = words(text), set()
    for label, t in L.TEMPLATES:
        t = words(t)
        m, top = len(t), int(len(t) / L.SHARE)
        for s in range(len(w)):
            if w[s] in t and any(lcs_table(t, w[s:e]) >= L.SHARE * max(m, e - s) for e in range(s + int(L.SHARE * m), min(len(w), s + top) + 1)):
                out.add(label)
                break
    return out


def scan(spark, texts, **more):
    rows = L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3), **more).collect()
    return {r.doc_id: r for r in rows}


SHORT = [t for _, t in L.TEMPLATES if len(words(t)) < 20]
CASES = [
    "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "licensed under cc by 4.0 only", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
    "the mit license; apache license; MIT LICENSE", "released under a mit license", "This work is licensed under the very GNU General Public License, version 3.", "permission is granted", "general public general public license", "mit\nlicense", "mitlicense mit licensed",
    "a b c Released under the MIT License Released under the MIT License x Licensed under CC BY-NC-SA 4.0", "Σίσυφος mit licensé mit license",
]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_labels_equal_brute_force(spark, limit):
    got = scan(spark, CASES, broadcast_bands=limit)
    for k, text in enumerate(CASES):
        r = got[k]
        assert r.n_words == len(words(text))
        assert [(b.start, b.label) for b in r.base] == base_of(text)
        assert {f.label for f in r.found} == found_by_brute_force(text), text


def test_long_templates_with_edits(spark):
    texts, want = [], []
    for label, t in L.TEMPLATES:
        w = t.split()
        if len(w) < 20:
            continue
        few = [x for i, x in enumerate(w) if i % 25 != 7]
        put = [y for i, x in enumerate(w) for y in ([x, "extra"] if i % 25 == 9 else [x])]
        many = [x if i % 3 else "other" for i, x in enumerate(w)]
        for v, there in ((w, True), (few, True), (put, True), (many, False), (w[: len(w) // 2], False)):
            texts.append("some words before it " * 3 + " ".join(v) + " and after it")
            want.append((label, there))
    got = scan(spark, texts)
    for k, (label, there) in enumerate(want):
        found = [f for f in got[k].found if f.label == label]
        assert bool(found) == there, (label, texts[k])
        if there:
            assert max(f.share for f in found) > 0.9 and any(f.start == 12 for f in found)


def test_odd_rows(spark, odd, none):
    assert L.scan_licenses(none).count() == 0
    rows = L.scan_licenses(odd).collect()
    want = {r.doc_id: r.text for r in odd.collect()}
    assert len(rows) == odd.count()
    assert all(r.n_words == len(words(want[r.doc_id])) and not r.base and not r.found for r in rows)


def test_null_shared_and_repeated_ids(spark):
    t = CASES[0]
    rows = L.scan_licenses(spark.createDataFrame([(None, t), (1, t), (1, t), (1, "no"), (1, None), (2, f"{t} {t}")], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_words, len(r.base), len(r.found)) for r in rows) == [(0, 5, 1, 1), (1, 0, 0, 0), (1, 1, 0, 0), (1, 5, 1, 1), (1, 5, 1, 1), (2, 10, 2, 2)]


def test_a_text_over_a_chunk(spark):
    filler = "word and another " * 80_000
    text = f"{CASES[3]} {filler} {L.TEMPLATES[1][1]}"
    assert len(text) > 1 << 20
    r = scan(spark, [text, "x"])[0]
    assert [(b.start, b.label) for b in r.base] == base_of(text) and {(f.start, f.label) for f in r.found} == {(0, "apache"), (8 + 240_000, "mit")}


def test_query_equals_brute_force(spark, sf, texts):
    rows = L.op13_license_scan(spark, sf).collect()
    assert len(rows) == len(texts) and any(r.score == 1.0 for r in rows)
    for r in rows:
        base = base_of(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (len(words(texts[r.doc_id])), len(base))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({b for _, b in base}))
        # notices of the tables stand word for word
        exact = {label for label, t in L.TEMPLATES if f" {' '.join(words(t))} " in f" {' '.join(words(texts[r.doc_id]))} "}
        assert set(filter(None, r.labels.split(","))) == {b for _, b in base} | exact and (r.score == 1.0) == bool(exact)
