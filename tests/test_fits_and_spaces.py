import datetime as dt
import json

import numpy as np
import pytest

from freshet.operators import image, normalize, select
from freshet.plans import spaces
from freshet.sources import fits, panel


@pytest.fixture(scope="module")
def record(spark):
    rng = np.random.default_rng(3)
    start = dt.date(1990, 12, 1)
    rows = [(1, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(rng.gamma(2.0, 5.0, 3000))]
    days = panel.dense_days(spark.createDataFrame(rows, "scenario_id long, day date, flow double"), start, start + dt.timedelta(days=3000)).persist()
    return panel.daily_to_monthly(days, "mean").persist(), days


def jobs(spark, run):
    spark.sparkContext.setJobGroup("fits-test", "")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fits-test"))
    out = run()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup("fits-test")) - before


def laws(ref):
    return sorted(map(tuple, ref.fits.collect())), ref.threshold, ref.mean


def test_a_known_record_is_not_fitted_again(spark, record, tmp_path, monkeypatch):
    monthly, daily = record
    calls = []
    real = fits.fit_reference
    monkeypatch.setattr(fits, "fit_reference", lambda *a: calls.append(a) or real(*a))
    want = laws(image.fit_reference(monthly, daily))
    first, cost = jobs(spark, lambda: fits.reference_fits(monthly, daily, str(tmp_path)))
    assert laws(first) == want and len(calls) == 1
    # the same rows in another frame, order and partitioning
    again, cheap = jobs(spark, lambda: fits.reference_fits(monthly.repartition(7).select(*reversed(monthly.columns)), daily.orderBy("flow"), str(tmp_path)))
    assert laws(again) == want and len(calls) == 1 and cheap < cost
    for change in ({"timescale": 3}, {"percentile": 90.0}):
        assert laws(fits.reference_fits(monthly, daily, str(tmp_path), **change)) == laws(real(monthly, daily, change.get("timescale", 6), change.get("percentile", 95.0)))
    assert len(calls) == 3
    other = fits.reference_fits(monthly, daily.withColumn("flow", daily.flow + 1e-9), str(tmp_path))
    assert len(calls) == 4 and other.mean != want[2]


def test_digests(spark):
    make = lambda rows, schema="a long, b double": spark.createDataFrame(rows, schema)
    base = [(1, 0.5), (2, None), (None, 0.0), (2, None)]
    d = fits.content_digest(make(base))
    assert d == fits.content_digest(make(base[::-1]).repartition(3)) == fits.content_digest(make([(b, a) for a, b in base], "b double, a long")) == fits.content_digest(make([(1, 0.5), (2, None), (None, -0.0), (2, None)]))
    others = [base[:3], [*base, base[0]], [(1, 0.5), (2, 0.0), (None, 0.0), (2, None)], [(1, 0.5), (None, 2.0), (None, 0.0), (2, None)], [(2, 0.5), (1, None), (None, 0.0), (2, None)], []]
    found = [fits.content_digest(make(r)) for r in others] + [fits.content_digest(make(base, "a long, c double")), fits.content_digest(make([(a, None if b is None else int(b * 2)) for a, b in base], "a long, b long"))]
    assert len({d, *found}) == len(found) + 1


def test_spaces(spark, tmp_path):
    rng = np.random.default_rng(5)
    h = np.column_stack([rng.gamma(1.0, 1.0, 300), rng.random(300), rng.normal(5, 1, 300)])
    axes = ["a", "b", "c"]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(h)], "row_ix long, a double, b double, c double").persist()
    got = spaces.compare_spaces(df, axes, 24, 3)
    assert (got["n"], got["M"], got["axes"]) == (24, 300, axes) and set(got["reports"]) == {"absolute", "absolute_full", "cdf"}
    rows = select.lhs_nearest(normalize.cdf_normalize(df, axes), axes, 24, 3).rows
    r = got["reports"]["cdf"]
    for k, a in enumerate(axes):
        mine = h[rows, k]
        assert r["per_axis"][a]["tail_share_p90"] == pytest.approx((mine > np.percentile(h[:, k], 90)).mean())
        assert r["per_axis"][a]["median_ratio"] == pytest.approx(np.median(mine) / np.median(h[:, k]))
        grid = np.sort(h[:, k])
        assert r["per_axis"][a]["ks_vs_pool"] == pytest.approx(np.abs(np.searchsorted(np.sort(mine), grid, "right") / 24 - np.arange(1, 301) / 300).max())
    rank = lambda v: np.argsort(np.argsort(v))
    rho = [abs(np.corrcoef(rank(h[rows, i]), rank(h[rows, j]))[0, 1]) for i in range(3) for j in range(i + 1, 3)]
    assert r["mean_abs_spearman"] == pytest.approx(np.mean(rho))
    # ranks keep the pool's frequencies, coordinates draw out the tail
    assert got["reports"]["absolute"]["mean_tail_share_p90"] > r["mean_tail_share_p90"]
    path = spaces.write_summary(spark, got, str(tmp_path / "summary"))
    assert json.loads(spark.read.text(path, wholetext=True).first().value.rstrip("\0")) == json.loads(json.dumps(got))
