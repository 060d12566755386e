import math

import numpy as np
import pytest

from freshet.operators import forcing, persistence
from freshet.sources import envelope

MONTHS = [10, 11, 12, 1, 2, 3, 4, 5, 6, 7, 8, 9]


def profiles(spark, a):
    return spark.createDataFrame([(f"r{k}", t, float(a[t, k])) for k in range(a.shape[1]) for t in range(12)], "run string, water_pos int, factor double")


def test_harmonics_invert(spark):
    rng = np.random.default_rng(0)
    p = [(k, rng.normal(0, 0.1), rng.uniform(0.05, 0.3), rng.uniform(-3, 3), rng.uniform(0.02, 0.1), rng.uniform(-3, 3)) for k in range(8)]
    df = spark.createDataFrame([tuple(map(float, x)) for x in p], "k double, m double, r1 double, psi1 double, r2 double, psi2 double")
    made = forcing.reconstruct(df).collect()
    env = profiles(spark, np.array([r.profile for r in made]).T)
    fit = {r.run: r for r in forcing.harmonic_fit(env).collect()}
    for k, m, r1, s1, r2, s2 in p:
        f = fit[f"r{k}"]
        assert [f.m, f.r1, f.psi1, f.r2, f.psi2] == pytest.approx([m, r1, s1, r2, s2])
    a = np.exp(rng.normal(0, 0.2, (12, 1)))
    six = forcing.harmonic_fit(profiles(spark, a), 6).first()
    back = forcing.reconstruct(forcing.harmonic_fit(profiles(spark, a), 6), 6, 0.0).first().profile
    assert back == pytest.approx(a[:, 0].tolist()) and six.r6 >= 0


def test_boxes_overrides_and_samples(spark):
    t = np.arange(12)
    a = 1 + 0.25 * np.sin(2 * math.pi * t / 12)[:, None] + 0.15 * np.random.default_rng(1).normal(size=(12, 20))
    env = profiles(spark, np.maximum(a, 0.3))
    box = forcing.parameter_box(forcing.harmonic_fit(env))
    assert all(lo < hi for lo, hi in box.values()) and box["r1"][0] >= 0
    o = forcing.override_bounds(box, {"m": (None, 9.0), "r1": (-1.0, 2.0)})
    assert o["m"] == (box["m"][0], 9.0) and o["r1"] == (0.0, 2.0)
    for bad in ({"zz": (0, 1)}, {"m": (2.0, 1.0)}):
        with pytest.raises(ValueError):
            forcing.override_bounds(box, bad)
    rows, names = forcing.sample_forcing(env, 50, 3)
    got = rows.orderBy("theta_ix").collect()
    assert names == ["m", "r1", "r2"] and len(got) == 50 and len({r.psi1 for r in got}) == 1 and all(len(r.profile) == 12 and min(r.profile) >= 0.2 for r in got)
    free, names = forcing.sample_forcing(env, 50, 3, fix_phase=False, method="iid")
    assert names == ["m", "r1", "psi1", "r2", "psi2"] and free.count() == 50
    digest = forcing.forcing_digest(rows, "e.csv", 0.0, 3, "2000-12-01", ("a", "b"), ("c", "d"))
    assert digest == forcing.forcing_digest(rows.repartition(5), "e.csv", 0.0, 3, "2000-12-01", ("a", "b"), ("c", "d"))
    assert digest != forcing.forcing_digest(rows, "e.csv", 0.1, 3, "2000-12-01", ("a", "b"), ("c", "d"))
    with pytest.raises(ValueError):
        forcing.draw_box(3, [(0, 1)], 1, "sobol")


def test_moment_adjustment_keeps_what_it_says(spark):
    df = spark.createDataFrame([(m, 0.3 * m - 1, 0.2 + 0.05 * m, 0.7 + 0.06 * m) for m in range(1, 13)], "month int, mean double, sd double, a double")
    real = lambda y, s: (math.exp(y + s * s / 2), math.sqrt(math.exp(s * s) - 1))
    for r in forcing.adjust_moments(df).collect():
        old, new = real(r.mean, r.sd), real(r.mean_new, r.sd_new)
        assert new[0] == pytest.approx(old[0] * r.a) and new[1] == pytest.approx(old[1])
    for r in forcing.adjust_moments(df, preserve_absolute_sd=True).collect():
        old, new = real(r.mean, r.sd), real(r.mean_new, r.sd_new)
        assert new[0] * new[1] == pytest.approx(old[0] * old[1])


def test_envelopes(spark, tmp_path):
    head = "month,hist_1980_2019,M1_ssp245_1980_2019_x,M1_ssp245_2020_2059,M2_SSP585_2060_2099"
    mean = "\n".join([head, *(f"{m},1.0,1.0,{1 + m / 100},{1.2}" for m in range(1, 13))])
    sd = "\n".join([head, *(f"{m},0.2,0.5,{0.6},{0.9}" for m in range(1, 13))])
    (tmp_path / "m.csv").write_text(mean)
    (tmp_path / "s.csv").write_text(sd)
    f = envelope.read_factors(spark, str(tmp_path / "m.csv"))
    e = envelope.load_envelope(f)
    assert {r.run for r in e.select("run").distinct().collect()} == {"M1_ssp245_2020_2059", "M2_SSP585_2060_2099"}
    assert [r.month for r in e.filter("run like 'M1%'").orderBy("water_pos").collect()] == MONTHS
    v = envelope.variance_envelope(f, envelope.read_factors(spark, str(tmp_path / "s.csv"))).collect()
    assert len(v) == 12 and all(r.factor == pytest.approx(0.6 / (1 + r.month / 100) / 0.5) for r in v)
    with pytest.raises(ValueError, match="no future run"):
        envelope.load_envelope(f.filter("run like 'hist%'"))
    with pytest.raises(ValueError, match="plausible"):
        envelope.load_envelope(f.withColumn("factor", f.factor * 100))


def test_bootstrap(spark):
    order = list(range(40))
    df = persistence.bootstrap(spark, order, 300, 12, 12, 0.6, 0.8, 5)
    a = df.toPandas()
    assert len(a) == 300 * 144
    counts = a.source_year.value_counts()
    assert counts.min() > 0.6 * len(a) / 40 and counts.max() < 1.5 * len(a) / 40
    m = a.groupby(["realization", "year"]).source_year.mean().unstack()
    assert np.corrcoef(m.to_numpy()[:, :-1].ravel(), m.to_numpy()[:, 1:].ravel())[0, 1] > 0.35
    again = persistence.bootstrap(spark, order, 20, 12, 12, 0.6, 0.8, 5).toPandas()
    b = a[a.realization < 20].sort_values(["realization", "year", "period"]).source_year.to_numpy()
    assert (again.sort_values(["realization", "year", "period"]).source_year.to_numpy() == b).all()
    for phi, lam in ((1.0, 0.5), (-0.1, 0.5), (0.5, 1.1)):
        with pytest.raises(ValueError):
            persistence.bootstrap_matrix(3, 3, order, phi, lam, np.random.default_rng(1))
    res = spark.createDataFrame([(y, p, s, float((y * 7) % 5 + p)) for y in range(5) for p in range(3) for s in range(2)], "year int, period int, site int, value double")
    assert [r.year for r in persistence.wetness_order(res).orderBy("wet_rank").collect()] == [0, 3, 1, 4, 2]
