"""Results worked out by hand for small tables."""

import datetime as dt
import re
from collections import Counter

import pytest

from pulsegrid.operators import composites, context, daily, sleep
from pulsegrid.operators import workouts as W
from pulsegrid.plans.ranges import DateRange, composite_windows
from pulsegrid.plans.synth import Tables
from pulsegrid.schemas import TABLES
from pulsegrid.sources.store import Store


def at(text):
    return dt.datetime.fromisoformat(f"2024-{text}")


def make(spark, **rows):
    return Tables(**{n: spark.createDataFrame(rows.get(n, []), s) for n, s in TABLES.items()})


@pytest.fixture(scope="module")
def run(spark):
    hr = [(at(f"06-01 08:{m:02d}"), b, "w") for m, b in zip(range(5, 60, 10), (100.0, 110.0, 120.0, 120.0, 130.0, 140.0))]
    return make(spark, workouts=[("a", "Running", at("06-01 08:00"), at("06-01 09:00"), 3600.0, "w")], heart_rate=hr)


def test_drift(run):
    row = W.drift(run).first()
    assert (row.first_avg, row.second_avg, row.drift_class) == (110.0, 130.0, "high")
    assert row.drift_pct == pytest.approx(18.181818)


def test_zones(run):
    assert W.z2_ratio(run).first().z2_ratio == pytest.approx(2 / 6)
    assert [r.sample_count for r in W.zone_breakdown(run).collect()] == [2, 2, 2, 0, 0]
    assert [r.duration_sec for r in W.zone_time(run).collect()] == [240.0, 240.0, 240.0, 0.0, 0.0]


def test_load(run):
    row = W.load(run).first()
    assert (row.avg_hr, row.load) == (120.0, 432000.0)


def test_rolling_mean(spark):
    t = make(spark, resting_hr=[(at("06-01 05:00"), 52.0), (at("06-01 05:30"), 54.0), (at("06-02 05:00"), 56.0), (at("06-03 05:00"), 55.0)])
    assert [r.avg_rhr_7d for r in daily.resting_hr_rolling_7d(t).collect()] == pytest.approx([53, 54.5, 164 / 3])


def test_week_starts_on_monday(spark):
    span = lambda d, s: (d, "Running", at(d), at(d) + dt.timedelta(seconds=s), float(s), None)
    t = make(spark, workouts=[span("06-01 08:00", 3600), span("06-03 09:00", 1800), span("06-08 08:00", 2700)])
    assert [(str(r.week), r.workout_count, r.total_duration_sec) for r in daily.weekly_activity(t).collect()] == [("2024-05-27", 1, 3600.0), ("2024-06-03", 2, 4500.0)]


def test_pace_and_decoupling(spark):
    minutes = range(5, 60, 10)
    hr = [(at(f"06-04 08:{m:02d}"), b, None) for m, b in zip(minutes, (118.0, 122.0, 126.0, 128.0, 130.0, 132.0))]
    speeds = (3.6, 3.8, 3.7, 3.5, 3.4, 3.3)
    perf = [(at(f"06-04 08:{m:02d}"), None, s, None, None, None, None) for m, s in zip(minutes, speeds)]
    t = make(spark, workouts=[("r", "Running", at("06-04 08:00"), at("06-04 09:00"), 3600.0, None)], heart_rate=hr, performance=perf)
    pace = W.pace_at_hr(t).first()
    assert (pace.sample_count, pace.avg_speed_mps) == (4, pytest.approx(3.6))
    row = W.decoupling(t).first()
    first = (sum(1000 / s for s in speeds[:3]) / 3) / (366 / 3)
    second = (sum(1000 / s for s in speeds[3:]) / 3) / (390 / 3)
    assert row.decoupling_pct == pytest.approx((second - first) / first * 100)
    quality = context.sample_quality(t).first()
    assert (quality.sample_quality, quality.issues) == ("mixed", ["missing_power", "missing_route", "missing_context"])


def test_short_run_has_no_decoupling(spark):
    t = make(
        spark,
        workouts=[("s", "Running", at("06-06 08:00"), at("06-06 08:30"), 1800.0, None)],
        heart_rate=[(at("06-06 08:05"), 122.0, None)],
        performance=[(at("06-06 08:05"), None, 3.9, None, None, None, None)],
    )
    row = W.decoupling(t).first()
    assert (row.sample_count, row.decoupling_pct) == (1, None)
    assert "too_short" in context.sample_quality(t).first().issues


def test_equal_speed_samples_align_once_but_all_count_for_quality(spark):
    sample = (at("06-04 08:05"), None, 3.0, None, None, None, None)
    t = make(
        spark, workouts=[("r", "Running", at("06-04 08:00"), at("06-04 09:00"), 3600.0, None)], heart_rate=[(at("06-04 08:05:30"), 125.0, None), (at("06-04 08:04:30"), 121.0, None)], performance=[sample, sample]
    )
    assert [r.bpm for r in W.aligned(t).collect()] == [121.0]
    assert context.sample_quality(t).first().aligned_speed_hr_samples == 2


def test_nights(spark):
    raw = "HKCategoryValueSleepAnalysisAsleep"
    rows = [
        (at("05-31 22:30"), at("06-01 06:30"), "in_bed", None),
        (at("05-31 23:00"), at("06-01 02:00"), "asleep", raw + "Core"),
        (at("06-01 02:00"), at("06-01 03:00"), "asleep", raw + "Deep"),
        (at("06-01 03:00"), at("06-01 04:00"), "asleep", raw + "REM"),
        (at("06-01 04:00"), at("06-01 06:00"), "asleep", raw + "Core"),
        (at("06-01 06:00"), at("06-01 06:30"), "awake", None),
    ]
    t = make(spark, sleep=rows)
    row = sleep.nights(t).first()
    assert (str(row.day), row.asleep_hours, row.in_bed_hours, row.awake_hours, row.core_hours, row.deep_hours, row.rem_hours, row.unspecified_hours) == ("2024-05-31", 7.0, 8.0, 0.5, 5.0, 1.0, 1.0, 0.0)
    total = sleep.summary(t).first()
    assert (total.total_hours, total.efficiency, total.consistency_stddev) == (7.0, 7 / 8, None)


def test_windows():
    w = composite_windows(DateRange("2024-06-08", "2024-06-14"))
    assert (w.baseline.start, w.baseline.end) == ("2024-06-01", "2024-06-07")
    assert (w.acute7d.start, w.chronic28d.start, w.long_trend12w.start) == ("2024-06-08", "2024-05-18", "2024-03-23")
    with pytest.raises(ValueError):
        composite_windows(DateRange("2024-06-14", "2024-06-08"))


def test_offsets_go_to_utc():
    low, high, closed = DateRange("2024-06-01T02:00:00+02:00", "2024-06-02").bounds()
    assert (low, high, closed) == (dt.datetime(2024, 6, 1), dt.datetime(2024, 6, 3), False)


@pytest.mark.parametrize("current, state, action", [((60.0, 40.0, 6, 150.0), "Strained", "reduce_intensity"), ((45.0, 90.0, 8.5, 90.0), "Fresh", "push")])
def test_readiness(spark, current, state, action):
    rhr, hrv, hours, bpm = current
    days = [("06-03", 50.0, 70.0, 7.5, 110.0), ("06-04", rhr, hrv, hours, bpm)]
    t = make(
        spark,
        resting_hr=[(at(f"{d} 05:00"), r) for d, r, *_ in days],
        hrv=[(at(f"{d} 05:00"), v) for d, _, v, *_ in days],
        sleep=[(at(f"{d} 00:00"), at(f"{d} 00:00") + dt.timedelta(hours=h), "asleep", None) for d, _, _, h, _ in days],
        workouts=[(d, "Running", at(f"{d} 18:00"), at(f"{d} 19:00"), 3600.0, None) for d, *_ in days],
        heart_rate=[(at(f"{d} 18:30"), b, None) for d, *_, b in days],
    )
    row = composites.readiness(t, DateRange("2024-06-04", "2024-06-04")).first()
    assert (row.state, row.action_kind, row.confidence) == (state, action, "high")
    report = composites.advanced_report(t, DateRange("2024-06-04", "2024-06-04")).collect()
    assert [r.section for r in report] == ["fitness_direction", "easy_run_quality", "recovery_state", "workout_diagnoses"]


def test_empty_store(spark):
    t = make(spark)
    r = DateRange("2024-06-08", "2024-06-14")
    assert composites.recovery_debt(t, r).first().state == "needs more data"
    assert composites.run_economy(t, r).first().state == "insufficient data"
    assert W.zone_time(t).count() == 0
    assert composites.advanced_report(t, r).count() == 4


def scans(df):
    """How often a plan reads each table of a store."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return Counter(re.findall(r"Location: InMemoryFileIndex[^\[]*\[[^\]]*/(\w+)[,\]]", plan))


def test_composites_read_each_table_once(spark, tmp_path):
    t = Store(spark, str(tmp_path / "store")).tables()
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    r = DateRange("2024-06-08", "2024-06-14")
    tables = ("workouts", "heart_rate", "resting_hr", "hrv", "sleep", "performance", "steps")
    found = {name: {k: n for k, n in scans(getattr(composites, name)(t, r)).items() if k in tables} for name in ("readiness", "training_strain", "recovery_debt", "fitness_trend", "consistency_index")}
    assert found["readiness"] == {k: 1 for k in ("workouts", "heart_rate", "resting_hr", "hrv", "sleep")}
    assert found["training_strain"] == {k: 1 for k in ("workouts", "heart_rate", "resting_hr", "hrv")}
    assert found["recovery_debt"] == found["readiness"]
    assert found["fitness_trend"]["resting_hr"] == 1
    assert {k: n for k, n in found["consistency_index"].items() if k != "sleep"} == {k: 1 for k in ("workouts", "resting_hr", "steps")}
