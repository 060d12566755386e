import datetime as dt
import math

import numpy as np
import pytest

from freshet.functions import calendars
from freshet.functions.special import gamma_normal_score, gamma_shape, normal_tail
from freshet.operators import image, ssi
from freshet.sources import images, panel
from freshet.streaming.blocks import score_blocks

START = dt.date(2002, 12, 1)
D = dt.date.fromisoformat
#: The three scenarios (phase and changed stretches) and, in ``flow``, the law of their daily flows, which the expected image belongs to.
SCENARIOS = [(0.3, [("2008-04-10", "2008-04-14", 8.0)]), (1.8, [("2011-05-01", "2011-12-31", 0.5), ("2012-01-01", "2012-05-31", 0.75)]), (2.6, [("2002-12-01", "2003-04-30", 0.75), ("2003-05-01", "2003-10-31", 0.5)])]
#: The expected image of the three scenarios, in the order of the column contract.
GOLDEN = [
    [31.42620088, 27, 1.852262218, 0.1157663886, 0.1543551848, 13.9256068, 5, 12.15321138, 0, 0, 2, 49.07089459, 0.7585875668, 0.8014125273, 0.7646643318, 0.2416271357, 70, 177, 10.88627754, 31.96196128, 1.251869506, 0.1674533286, 0.2546616496],
    [29.22486653, 11, 3.675741761, 0.6126236268, 0.1957683928, 4.430454252, 5, 1.19660621, 0, 1, 2, 56.18450513, 0.5807317363, 0.8240432967, 0.5958141361, 0.1646693239, 57, 155, 4.03019916, 5.471837602, 1.189534445, 0.1996500389, 0.2502508401],
    [30.5164107, 29, 3.522347167, 0.4597174962, 0.1408938867, 4.457220128, 4, 1.173311897, 1, 0, 3, 59.33610168, 0.7745563473, 0.8489736397, 0.7745563473, 0.1713037905, 61, 154, 4.087465301, 6.046525043, 1.269064554, 0.1660976319, 0.2503017637],
]


def flow(day, phase):
    t = (day - dt.date(1900, 1, 1)).days
    year = 2 * math.pi * t / 365.25
    return 1000 * math.exp(0.5 * math.cos(year - 1.8) + 0.2 * math.sin(year / 3.7 + phase) + 0.1 * math.sin(year / 11.3 + 2 * phase) + 0.6 * math.sin(2 * math.pi * t / 9.3 + phase) + 0.4 * math.sin(2 * math.pi * t / 23.7 + 3 * phase))


def span(a, b):
    return [a + dt.timedelta(k) for k in range((b - a).days)]


@pytest.fixture(scope="module")
def scored(spark):
    schema = "scenario_id long, day date, flow double"
    ref = spark.createDataFrame([(0, d, flow(d, 0.0)) for d in span(dt.date(1945, 1, 1), dt.date(2023, 1, 1))], schema)
    rows = []
    for k, (phase, changes) in enumerate(SCENARIOS):
        for d in span(START, dt.date(2012, 6, 1)):
            x = flow(d, phase)
            for a, b, f in changes:
                x *= f if D(a) <= d <= D(b) else 1
            rows.append((k, d, x))
    ref_days = panel.dense_days(ref, dt.date(1945, 1, 1), dt.date(2023, 1, 1)).persist()
    days = panel.dense_days(spark.createDataFrame(rows, schema), START, dt.date(2012, 6, 1)).persist()
    return days, image.fit_reference(panel.daily_to_monthly(ref_days), ref_days)


def test_golden_image(scored):
    days, ref = scored
    out = image.hazard_image(panel.daily_to_monthly(days), days, ref, 182, supplement=True)
    assert out.columns == ["scenario_id", *image.AXES, *image.SUPPLEMENT]
    got = {r.scenario_id: list(r)[1:] for r in out.collect()}
    for k, want in enumerate(GOLDEN):
        np.testing.assert_allclose(got[k], want, rtol=1e-6)


def test_axes_do_not_depend_on_supplement_or_partitions(scored):
    days, ref = scored
    months = panel.daily_to_monthly(days)
    a = {tuple(round(x, 9) for x in r) for r in image.hazard_image(months, days, ref, 182).collect()}
    for n in (1, 17):
        b = image.hazard_image(months.repartition(n), days.repartition(n), ref, 182, supplement=True).select("scenario_id", *image.AXES)
        assert {tuple(round(x, 9) for x in r) for r in b.collect()} == a
    with pytest.raises(Exception, match="lacks"):
        image.hazard_image(months.filter("scenario_id < 2"), days, ref, 182).collect()
    with pytest.raises(ValueError):
        image.hazard_image(months, days, ref, -1)


def test_index_is_standard_normal_in_every_month(spark):
    x = np.random.default_rng(0).normal(100, 15, 78 * 12)
    rows = [(0, i, calendars.add_months(dt.date(1945, 1, 1), i), float(v)) for i, v in enumerate(x)]
    m = spark.createDataFrame(rows, "scenario_id long, pos int, month date, flow double")
    z = [(r.month.month, r.z) for r in ssi.standardize(m, ssi.fit_months(m)).collect() if r.z is not None]
    for k in range(1, 13):
        assert 0.9 <= np.std([v for q, v in z if q == k]) <= 1.1
    bad = spark.createDataFrame([(0, i, calendars.add_months(dt.date(2000, 1, 1), i), 0.0) for i in range(40)], m.schema)
    with pytest.raises(Exception, match="positive"):
        ssi.fit_months(bad)


def test_special_functions():
    rng = np.random.default_rng(4)
    x = rng.gamma(7.3, 2.0, 20000)
    k = gamma_shape(x.mean(), np.log(x).mean())
    assert k == pytest.approx(7.3, rel=0.05)
    z = gamma_normal_score(x, np.full(len(x), 7.3), np.full(len(x), 2.0))
    assert abs(z.mean()) < 0.03 and z.std() == pytest.approx(1, abs=0.03)
    for v in (0.0, 0.5, 1.0, 3.0, 6.0, 9.0):
        assert normal_tail(np.array([v]))[0] == pytest.approx(0.5 * math.erfc(v / math.sqrt(2)), rel=1e-12)
    # a gamma law of shape 1 is exponential: score and tail are known in both directions
    for t in (1e-8, 0.1, 1.0, 30.0, 200.0):
        s = gamma_normal_score(np.array([t]), np.ones(1), np.ones(1))[0]
        tail = 0.5 * math.erfc(abs(s) / math.sqrt(2))
        assert tail == pytest.approx(math.exp(-t) if s > 0 else -math.expm1(-t), rel=1e-9)


def test_calendar(spark):
    from pyspark.sql import functions as F

    a = [float(i) for i in range(1, 13)]
    r = spark.createDataFrame([(a,)], "a array<double>").select(calendars.to_water_year(F.col("a")).alias("w")).select("w", calendars.to_calendar(F.col("w")).alias("c")).first()
    assert r.w == [10.0, 11.0, 12.0, *a[:9]] and r.c == a
    days = calendars.scored_month_days(dt.date(2002, 12, 1), 42, 6, (dt.date(2006, 6, 1) - dt.date(2002, 12, 1)).days)
    assert len(days) == 36 and days[8] == 29
    for bad in ((dt.date(2003, 1, 1), 12, 6, 365), (dt.date(2002, 12, 1), 12, 6, 364)):
        with pytest.raises(ValueError):
            calendars.scored_month_days(*bad)


def test_resample_fills_empty_months(spark):
    rows = [(1, D("2001-01-05"), 2.0), (1, D("2001-01-09"), 4.0), (1, D("2001-03-01"), 6.0)]
    df = spark.createDataFrame(rows, "scenario_id long, day date, flow double")
    got = {r.month.month: r.flow for r in panel.resample_months(df).collect()}
    assert got == {1: 3.0, 2: None, 3: 6.0}
    assert {r.month.month: r.flow for r in panel.resample_months(df, "sum").collect()}[2] == 0.0


def test_image_round_trip_and_provenance(spark, scored, tmp_path):
    days, ref = scored
    img = image.hazard_image(panel.daily_to_monthly(days), days, ref, 182, supplement=True).persist()
    p = images.Provenance(supplement_rule=images.SUPPLEMENT_RULE, scenario_start=str(START))
    path = images.save_image(img, str(tmp_path / "img"), p, image.AXES, supplement=image.SUPPLEMENT)
    rows, meta = images.load_image(spark, path, p)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, img.collect())) and meta["chosen_axes"] == list(image.AXES)
    legs = ("scenario_start", "cut_months", "dry_rule", "wet_rule", "supplement_rule")
    for k, leg in enumerate(legs):
        for value in (None, "other"):
            # the first leg that fails is named, whatever comes after it
            with pytest.raises(ValueError, match=leg):
                images.check_provenance(meta | {later: "other" for later in legs[k + 1 :]} | {leg: value}, p)
    with pytest.raises(ValueError, match="reference_start"):
        images.check_provenance({k: v for k, v in meta.items() if k != "reference_start"} | {"scenario_start": None}, p)
    images.check_provenance(meta | {"reference_start": "1950-01-01"}, p)
    bare = images.save_image(img, str(tmp_path / "bare"), images.Provenance(supplement_rule="retired"), image.AXES)
    with pytest.raises(ValueError, match="supplement_rule"):  # also of an image without a supplement
        images.load_image(spark, bare)
    old = images.save_image(img, str(tmp_path / "old"), images.Provenance(scenario_start="1999-01-01"), image.AXES)
    with pytest.raises(ValueError, match="scenario_start"):
        images.load_image(spark, old)
    with pytest.raises(ValueError):
        images.save_image(img, path, p, ["nothing"])
    m = images.Manifest("d", 0, 2, 10, 1, [3, 4], "ab", ["x"], {"k": 1})
    assert images.Manifest.read(spark, m.write(spark, str(tmp_path / "m"))) == m


def test_streamed_blocks_equal_one_batch(spark, scored, tmp_path):
    days, ref = scored
    days.repartition(1).write.partitionBy("scenario_id").parquet(str(tmp_path / "blocks"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "blocks")).schema).parquet(str(tmp_path / "blocks"))
    q = score_blocks(stream, ref, str(tmp_path / "out"), str(tmp_path / "state"), 182)
    assert q.awaitTermination(300)
    whole = image.hazard_image(panel.daily_to_monthly(days), days, ref, 182)
    got = spark.read.parquet(str(tmp_path / "out")).select(whole.columns)
    assert {tuple(round(x, 9) for x in r) for r in got.collect()} == {tuple(round(x, 9) for x in r) for r in whole.collect()}
