import random

import pytest

from freshet.operators import flood, runs


def series(spark, lists, pre=None):
    rows = [(k, i, float(v)) for k, z in enumerate(lists) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "scenario_id long, pos int, z double")
    pres = spark.createDataFrame([(k, p) for k, p in enumerate(pre or [None] * len(lists))], "scenario_id long, z_pre double")
    return df.join(pres, "scenario_id")


def machine(z, end):
    """Month-by-month run theory, the model that the window form must equal."""
    out, cur, dry = [], None, 0
    for i, v in enumerate([*z, *[1.0] * end]):
        if v < 0:
            cur, dry = cur or [], 0
            cur.append(i)
        elif cur is not None:
            dry += 1
            if dry >= end:
                spells, last = [], None
                for p in cur:
                    if last is None or p != last + 1:
                        spells.append([])
                    spells[-1].append(p)
                    last = p
                hit = next((k for k, s in enumerate(spells) if min(z[p] for p in s) <= -1), None)
                if hit is not None:
                    keep = [p for s in spells[hit:] for p in s]
                    low = min(z[p] for p in keep)
                    out.append((keep[0], keep[-1], next(p for p in keep if z[p] == low), len(keep), round(-sum(z[p] for p in keep), 9), -low))
                cur, dry = None, 0
    return out


@pytest.mark.parametrize("end", [1, 2, 3, 4])
def test_windows_equal_the_sequential_machine(spark, end):
    rng = random.Random(end)
    lists = [[round(rng.gauss(0, 1), 3) for _ in range(rng.randrange(1, 60))] for _ in range(300)]
    got = {}
    for r in runs.drought_events(series(spark, lists), end).collect():
        got.setdefault(r.scenario_id, []).append((r.start, r.end, r.peak, r.duration, round(r.magnitude, 9), r.severity))
    assert {k: sorted(v) for k, v in got.items()} == {k: e for k, z in enumerate(lists) if (e := machine(z, end))}


WET = [0.9] * 4
EDGE = [-0.6, -1.0, -2.2, -0.7, -0.1, 1.0, 1.0, 1.0]
#: (index, value before it, what follows by hand from the definitions)
CASES = [
    ([*WET, -0.25, -1.75, -0.5, *WET], 0.9, {"magnitude": 2.5, "duration": 3, "severity": 1.75, "development_rate": 0.875, "termination_rate": 0.875, "onset_truncated": 0, "termination_truncated": 0, "event_count": 1, "total_deficit": 2.5}),
    (EDGE, None, {"magnitude": 4.6, "duration": 5, "onset_truncated": 1, "development_rate": 0.8, "termination_rate": 2.2 / 3, "termination_truncated": 0}),
    (EDGE, 0.2, {"onset_truncated": 0, "development_rate": 2.2 / 3}),
    (EDGE, -0.01, {"onset_truncated": 1, "development_rate": 0.8}),
    (EDGE, float("nan"), {"onset_truncated": 1, "development_rate": 0.8}),
    ([0.3, 0.3, -0.4, -1.4, -0.9, -0.65], 0.1, {"termination_truncated": 1, "termination_rate": 0.375, "development_rate": 0.7, "onset_truncated": 0}),
    ([1.1, -1.05, 1.1, 1.1, 1.1, -0.2, -1.3, 1.1, 1.1, 1.1], 1.0, {"event_count": 2, "total_deficit": 2.55, "magnitude": 1.5, "duration": 2, "development_rate": 0.65, "termination_rate": 1.3}),
    ([1.0, -1.6, 0.4, 0.4, -0.3, 1.0, 1.0, 1.0], None, {"magnitude": 1.9, "duration": 2, "development_rate": 1.6, "termination_rate": 0.4, "event_count": 1}),
    ([1.0, -0.8, 0.2, -1.2, -0.4, 1.0, 1.0, 1.0], None, {"magnitude": 1.6, "duration": 2, "development_rate": 1.2, "termination_rate": 0.6}),
    ([0.2, -0.99, -0.5, 0.1], None, {"magnitude": 0, "duration": 0, "severity": 0, "event_count": 0, "termination_truncated": 0}),
    ([-1.3], None, {"onset_truncated": 1, "termination_truncated": 1, "development_rate": 0, "termination_rate": 0, "severity": 1.3}),
]


def test_hand_computed_descriptors(spark):
    df = series(spark, [z for z, _, _ in CASES], [p for _, p, _ in CASES])
    got = {r.scenario_id: r.asDict() for r in runs.drought_descriptors(df).collect()}
    assert len(got) == len(CASES)
    for k, (_, _, want) in enumerate(CASES):
        for name, v in want.items():
            assert got[k][f"drought_{name}"] == pytest.approx(v), (k, name)


def test_rules_and_errors(spark):
    df = series(spark, [[-1.2, -1.1, 1, 1, 1, -2.0, 1, 1, 1, -1.0, -1.0, -0.3]])
    e = runs.drought_events(df)
    pick = lambda rule: runs.select_event(e, rule).first().start
    assert (pick("first"), pick("deepest"), pick("controlling")) == (0, 5, 0)
    with pytest.raises(ValueError):
        runs.select_event(e, "longest")
    with pytest.raises(Exception, match="undefined"):
        runs.drought_events(series(spark, [[0.1, float("nan")]])).collect()


def days(spark, lists, month=30):
    return spark.createDataFrame([(k, i, i // month, float(v)) for k, x in enumerate(lists) for i, v in enumerate(x)], "scenario_id long, pos int, month_ix int, flow double")


def test_pulses_by_hand(spark):
    r = flood.flood_descriptors(days(spark, [[2, 11, 3, 3, 12, 15, 3, 3, 3, 14, 13], [4, 4], [20, 6, 20]]), 10.5, 4.0).orderBy("scenario_id").collect()
    assert (r[0].flood_pulse_count, r[0].flood_days_above, r[0].flood_pulse_duration, r[0].flood_pulse_volume, r[0].flood_rise_rate) == (3, 5, 2, 1.5, 2.25)
    assert (r[1].flood_peak_discharge, r[1].flood_pulse_count, r[1].flood_rise_rate, r[1].flood_pulse_volume) == (1, 0, 0, 0)
    assert (r[2].flood_peak_discharge, r[2].flood_pulse_duration, r[2].flood_rise_rate) == (5, 1, 0)


def test_regime_by_hand(spark):
    x = [3.0] * 360 + [4.0] * 360
    x[30:37], x[600:603] = [0.7] * 7, [10.0] * 3
    r = flood.regime_descriptors(days(spark, [x]), 5.0).first()
    dry, wet, every = 1063.9 / 360, 1458 / 360, 2521.9
    want = {"lowflow_min_12month": dry / 5, "lowflow_min_24month": every / 720 / 5, "lowflow_min_year": dry / 5, "highflow_max_year": wet / 5, "lowflow_min_7day": 0.14, "flood_max_3day": 2, "annual_cv": (wet - dry) / 2**0.5 / ((dry + wet) / 2), "flashiness": 17.6 / every}
    for k, v in want.items():
        assert r[k] == pytest.approx(v), k
    with pytest.raises(Exception, match="24 months"):
        flood.regime_descriptors(days(spark, [x[:690]]), 5.0).collect()
