import numpy as np
import pytest

from freshet.llm import quality_model as Q
from freshet.llm import toxicity as T

from .conftest import ODD

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_labels(spark, labels):
    rows = Q.op6_quality_classifier(spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    got = [(r.quality, r.predicted, r.score) for r in rows.filter("held_out").join(labels, "doc_id").collect()]
    y, p, s = map(np.array, zip(*got, strict=True))
    assert len(y) > 500 and ((s >= 0) & (s <= 1)).all()
    assert (p[y == 1] == 1).mean() >= 0.97 and (p[y == 0] == 0).mean() >= 0.85


def test_quality_folds_and_repeatability(spark, sf):
    import zlib

    a = Q.op6_quality_classifier(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in a)
    b = {r.doc_id: r.score for r in Q.op6_quality_classifier(spark, sf).collect()}
    assert all(abs(b[r.doc_id] - r.score) < 1e-9 for r in a)


def test_quality_of_odd_rows(spark, odd, none):
    lab = spark.createDataFrame([(2, 1, 0), (5, 0, 1), (None, 1, None), (12, None, 1), (12, 1, 0)], "doc_id long, quality int, toxic int")
    m = Q.train(Q.measures(odd), lab)
    got = Q.score_quality(odd, m).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in got)
    assert Q.score_quality(none, Q.train(Q.measures(none), lab.limit(0))).count() == 0
    assert {r.score for r in Q.score_quality(odd, Q.train(Q.measures(odd), lab.limit(0))).collect()} == {0.5}
    t = T.score_toxicity(odd, T.train(odd, lab)).collect()
    assert len(t) == len(ODD) + 2 and all(0 <= r.severity <= 3 for r in t)
    assert T.score_toxicity(none, T.train(none, lab.limit(0))).count() == 0


def table(spark, x):
    return spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(4)


def test_nnpu_risk_separates_without_negatives(spark):
    g = np.random.default_rng(1)
    pos, neg = g.normal(1, 0.5, (4000, 26)), g.normal(-1, 0.5, (1000, 26))
    every = table(spark, np.concatenate([pos[2000:], neg]))
    assert abs(Q.fit_nnpu(every, pos[:2000]).prior - 2 / 3) < 0.05
    m = Q.fit_nnpu(every, pos[:2000], 2 / 3)
    assert (m.score(pos) > 0.5).mean() > 0.98 and (m.score(neg) < 0.5).mean() > 0.98


def test_nnpu_minimum_equals_brute_force(spark):
    """The distributed Newton steps end where plain gradient descent on the written-out risk ends."""
    g = np.random.default_rng(3)
    x = np.concatenate([g.normal(0.2, 1, (300, 26)), g.normal(-0.3, 1, (200, 26))])
    pos, prior = g.normal(0.2, 1, (250, 26)), 0.6
    m = Q.fit_nnpu(table(spark, x), pos, prior)
    assert np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.scale, x.std(axis=0) + 1e-6)
    p, u = (np.column_stack([np.clip((v - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -5, 5), np.ones(len(v))]) for v in (pos, x))
    ridge = Q.RIDGE * np.append(np.ones(26), 1e-3)
    sp = lambda v: np.logaddexp(0, v)

    def risk(w):
        v = sp(u @ w).mean() - prior * sp(p @ w).mean()
        return prior * sp(-p @ w).mean() + (v + np.hypot(v, Q.KINK)) / 2 + (ridge * w * w).sum() / 2

    here = risk(m.weight)
    assert all(here <= risk(m.weight + s * 0.02 * e) + 1e-9 for e in np.eye(27) for s in (1, -1))
    w = np.zeros(27)
    for _ in range(20000):
        su, s = (1 / (1 + np.exp(-(x @ w))) for x in (u, p))
        v = sp(u @ w).mean() - prior * sp(p @ w).mean()
        part = (1 + v / np.hypot(v, Q.KINK)) / 2
        w -= 0.2 * (-prior * (1 - s) @ p / len(p) + part * (su @ u / len(u) - prior * s @ p / len(p)) + ridge * w)
    assert here <= risk(w) + 1e-6 and risk(w) - here < 0.02


def test_toxic_on_held_out_labels(spark, labels):
    from freshet.llm.labelled import fold

    rows = T.op10_toxicity(spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    got = [(r.label, r.toxic, r.severity, r.grade) for r in rows.join(labels.withColumnRenamed("toxic", "label"), "doc_id").filter(fold() == 0).collect()]
    y, p, s, g = map(np.array, zip(*got, strict=True))
    print("recall", (p[y == 1] == 1).mean(), "clean", (p[y == 0] == 0).mean())
    assert (p[y == 1] == 1).mean() >= 0.9 and (p[y == 0] == 0).mean() >= 0.99
    assert s[y == 1].mean() > s[y == 0].mean() + 0.8 and set(g) <= {0, 1, 2, 3}


def test_ordinal_fit_recovers_thresholds():
    g = np.random.default_rng(2)
    x = g.normal(size=(6000, 3))
    z = x @ np.array([1.5, -1.0, 0.0]) + g.logistic(size=6000)
    grade = np.searchsorted([-1.0, 0.5, 2.0], z)
    w, theta = T.fit_ordinal(x, grade, np.ones(6000))
    assert np.allclose(w, [1.5, -1.0, 0.0], atol=0.15) and np.allclose(theta, [-1.0, 0.5, 2.0], atol=0.2)


def test_toxic_words_without_clean_texts(spark):
    """300 words of a dozen toxic and no clean texts each: all that learn enough enter the lexicon, and held-out texts are told apart."""
    from freshet.llm.labelled import fold

    toxic = [(i, " ".join(f"bad{(20 * i + k) % 300}" for k in range(20)) + " plain words here") for i in range(180)]
    clean = [(i, " ".join(f"good{(7 * i + k) % 90}" for k in range(20)) + " plain words here") for i in range(180, 780)]
    docs = spark.createDataFrame(toxic + clean, "doc_id long, text string").repartition(3)
    m = T.train(docs, spark.createDataFrame([(i, int(i < 180)) for i in range(780)], "doc_id long, toxic int"))
    assert (m.weight > 0).sum() > 256
    got = T.score_toxicity(docs, m).filter(fold() == 0).collect()
    assert {r.doc_id < 180 for r in got} == {True, False} and all((r.p_toxic >= 0.5) == (r.doc_id < 180) for r in got)


def test_ordinal_gradient_is_that_of_the_likelihood(monkeypatch):
    """One step of the fit moves against a gradient taken by differences of the written-out likelihood."""
    g = np.random.default_rng(4)
    x, grade = g.normal(size=(40, 3)), g.integers(0, 4, 40)
    weight = g.uniform(0.5, 2, 40)

    def loss(par):
        theta = par[3] + np.concatenate([[0], np.cumsum(np.exp(par[4:]))])
        total = 0.0
        for xi, k, w in zip(x, grade, weight / weight.sum(), strict=True):
            up = [1.0, *(1 / (1 + np.exp(t - xi @ par[:3])) for t in theta), 0.0]
            total -= w * np.log(up[k] - up[k + 1])
        return total + 2e-3 / 40**0.5 * (par[:3] ** 2).sum() / 2

    start, eps = np.array([0.0, 0, 0, 1, 0, 0]), 1e-6
    want = np.array([(loss(start + eps * np.eye(6)[k]) - loss(start - eps * np.eye(6)[k])) / (2 * eps) for k in range(6)])
    w, theta = T.fit_ordinal(x, grade, weight, steps=1, rate=1e-3)
    moved = np.concatenate([w, [theta[0]], np.log(np.diff(theta))]) - start
    assert np.allclose(moved, -1e-3 * np.sign(want), atol=1e-6)  # Adam's first step has the sign of the gradient
    many_w, many_theta = T.fit_ordinal(x, grade, weight, steps=4000)
    best = np.concatenate([many_w, [many_theta[0]], np.log(np.diff(many_theta))])
    assert all(loss(best) <= loss(best + 0.05 * np.eye(6)[k] * s) for k in range(6) for s in (1, -1))


def test_lexicon_counts_equal_brute_force(spark):
    import math
    import re

    g = np.random.default_rng(6)
    rows = [(int(k % 3 == 0), int(g.integers(0, 2)), " ".join(f"w{int(x)}" + "bad" * int(k % 3 == 0 and x % 5 == 0) for x in g.integers(0, 40, 30))) for k in range(120)]
    lex = T.lexicon(spark.createDataFrame(rows, "label int, half int, text string").repartition(5))
    n = np.zeros((2, 2))
    seen = {}
    for label, part, text in rows:
        n[part, label] += 1
        for w in set(re.findall(r"[a-z0-9']+", text)):
            seen.setdefault(w, np.zeros((2, 2)))[part, label] += 1
    part = lambda o, e: o * math.log(o / e) if o else 0.0
    want = []
    for c in seen.values():
        (b, a), (zeros, ones) = c.sum(axis=0), n.sum(axis=0)
        t, m = ones + zeros, a + b
        if 2 * (part(a, m * ones / t) + part(b, m * zeros / t) + part(ones - a, (t - m) * ones / t) + part(zeros - b, (t - m) * zeros / t)) >= T.LEAST_RATIO:
            odds = [max(0.0, math.log((c[k, 1] + 0.5) / (n[k, 1] + 1)) - math.log((c[k, 0] + 0.5) / (n[k, 0] + 1))) for k in (0, 1)]
            want.append((round(odds[1], 9), round(odds[0], 9)))
    assert want and sorted(want) == sorted((round(a, 9), round(b, 9)) for a, b in lex.evidence.T)


def test_grades_are_no_feature_and_ignore_the_own_label(spark):
    docs = spark.createDataFrame([(i, f"calm text {i} bad{i % 9} bad{i % 7}" if i % 2 else f"calm text {i}") for i in range(400)], "doc_id long, text string")
    label = [(i, i % 2) for i in range(400)]
    m = T.train(docs, spark.createDataFrame(label, "doc_id long, toxic int"))
    assert len(m.weight) == len(m.lexicon.words) and m.lexicon.evidence.shape == (2, len(m.weight))
    evidence = np.array([0.0, 1, 2, 3, 4, 5, 9, 9])
    assert T.grades(evidence, np.array([False, True, True, True, True, True, True, False])).tolist() == [0, 1, 1, 2, 2, 3, 3, 0]
    twice = T.train(docs, spark.createDataFrame([*label, (1, 0), (2, None), (None, 1)], "doc_id long, toxic int"))
    assert np.array_equal(m.weight, twice.weight)


def test_toxic_recall_of_each_language(spark, labels):
    from freshet.llm.labelled import fold

    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = T.op10_toxicity(spark, SF).join(labels.filter("toxic = 1").select("doc_id"), "doc_id").join(lang, "doc_id").filter(fold() == 0).groupBy("lang").agg({"toxic": "avg"}).collect()
    assert len(got) == 4 and all(r[1] >= 0.6 for r in got)
