"""States and actions of the composites for small histories whose outcome is known."""

import datetime as dt

import pytest

from pulsegrid.operators import composites as C
from pulsegrid.plans.ranges import DateRange
from pulsegrid.plans.synth import Tables
from pulsegrid.schemas import TABLES

MINUTES = (5, 20, 40, 55)
LAST_WEEK = DateRange("2024-06-24", "2024-06-30")


class History:
    """Rows of the health tables, added day by day."""

    def __init__(self):
        self.rows = {name: [] for name in TABLES}

    def run(self, name, day, bpm, speed=None, power=None, dynamics=(None, None, None), minutes=MINUTES):
        """An hour's run; values are one number or one for each half."""
        begin = dt.datetime.fromisoformat(f"{day} 08:00:00")
        self.rows["workouts"].append((name, "Running", begin, begin + dt.timedelta(hours=1), 3600.0, "w"))
        half = lambda v, m: None if v is None else float(v if not isinstance(v, tuple) else v[m >= 30])
        for m in minutes:
            at = begin + dt.timedelta(minutes=m)
            self.rows["heart_rate"].append((at, half(bpm, m), "w"))
            if speed is not None or power is not None:
                self.rows["performance"].append((at, None, half(speed, m), half(power, m), *dynamics))
        return self

    def morning(self, day, rhr=None, hrv=None, vo2=None):
        at = dt.datetime.fromisoformat(f"{day} 05:00:00")
        for table, row in (("resting_hr", (at, rhr)), ("hrv", (at, hrv)), ("performance", (at, vo2, None, None, None, None, None))):
            if row[1] is not None:
                self.rows[table].append(tuple(float(x) if isinstance(x, (int, float)) else x for x in row))
        return self

    def night(self, day, hours, in_bed=8, begin="00:00:00"):
        at = dt.datetime.fromisoformat(f"{day} {begin}")
        for state, raw, n in (("asleep", "HKCategoryValueSleepAnalysisAsleepCore", hours), ("in_bed", "HKCategoryValueSleepAnalysisInBed", in_bed)):
            self.rows["sleep"].append((at, at + dt.timedelta(hours=n), state, raw))
        return self

    def month(self, add):
        """``add(history, day, whether it is one of the last seven)`` for the 28 days to 30 June."""
        for back in range(27, -1, -1):
            add(self, (dt.date(2024, 6, 30) - dt.timedelta(days=back)).isoformat(), back < 7)
        return self

    def tables(self, spark):
        return Tables(**{n: spark.createDataFrame(self.rows[n], s) for n, s in TABLES.items()})


def outcome(spark, history, composite, r=LAST_WEEK):
    row = composite(history.tables(spark), r).first()
    return row, (row.state, row.action_kind, row.confidence)


@pytest.mark.parametrize(
    "bpm, rhr, hrv, want, evidence",
    [
        ((120, 120), (52, 51), (60, 63), ("productive", "push", "high"), (0, "Acute:chronic load", 1.0)),
        ((180, 120), (50, 58), (70, 45), ("excessive", "reduce_intensity", "high"), (1, "Recovery penalty", 2.0)),
    ],
)
def test_training_strain(spark, bpm, rhr, hrv, want, evidence):
    h = History().month(lambda h, day, late: h.run(day, day, bpm[not late], minutes=(30,)))
    row, got = outcome(spark, h.morning("2024-06-23", rhr[0], hrv[0]).morning("2024-06-30", rhr[1], hrv[1]), C.training_strain)
    place, label, value = evidence
    assert got == want and (row.evidence[place].label, row.evidence[place].value_num) == (label, value)


@pytest.mark.parametrize(
    "hours, rhr, hrv, bpm, want",
    [
        (7, (52, 52), (65, 64), (120, 120), ("short-term dip", "add_sleep", "high")),
        (6, (50, 57), (70, 50), (170, 110), ("accumulating", "reduce_intensity", "high")),
    ],
)
def test_recovery_debt(spark, hours, rhr, hrv, bpm, want):
    h = History().month(lambda h, day, late: (h.run(day, day, bpm[not late], minutes=(30,)), late and h.night(day, hours)))
    row, got = outcome(spark, h.morning("2024-06-23", rhr[0], hrv[0]).morning("2024-06-30", rhr[1], hrv[1]), C.recovery_debt)
    assert got == want and row.evidence[0].label == "Debt score"


@pytest.mark.parametrize(
    "bpm, speed, state, action, confidence",
    [
        ((120, 120), 3.2, "productive aerobic", "maintain", "high"),
        ((150, 150), 3.2, "junk intensity", "run_easier", "high"),
        ((170, 110), (3.4, 2.8), "high-strain low-quality", "reduce_intensity", None),
    ],
)
def test_load_quality(spark, bpm, speed, state, action, confidence):
    h = History().month(lambda h, day, late: h.run(day, day, bpm[not late], speed if late else 3.2))
    _, got = outcome(spark, h, C.load_quality)
    assert got[:2] == (state, action) and confidence in (None, got[2])


@pytest.mark.parametrize(
    "now, want",
    [
        (dict(speed=3.4, power=235, bpm=135, dynamics=(9.0, 280.0, 1.1)), ("fitness", "maintain", "high")),
        (dict(speed=3.2, power=240, bpm=140, dynamics=(11.5, 330.0, 0.9)), ("mechanics", "watch", "high")),
    ],
)
def test_run_economy(spark, now, want):
    before = dict(speed=3.0 if want[0] == "fitness" else 3.2, power=240, bpm=140, dynamics=(9.0, 280.0, 1.1))
    h = History().run("before", "2024-06-01", **before).run("now", "2024-06-08", **now)
    assert outcome(spark, h, C.run_economy, DateRange("2024-06-02", "2024-06-08"))[1] == want


@pytest.mark.parametrize(
    "speed, power, rhr, want",
    [((3.2, 3.6), (220, 250), (54, 51), ("Improving", "supported", "maintain")), ((3.5, 3.3), (240, 230), (52, 55), ("Declining", "isolated", "run_easier"))],
)
def test_fitness_trend(spark, speed, power, rhr, want):
    h = History()
    for k, day in enumerate(("2024-06-01", "2024-06-08")):
        h.run(day, day, 125, speed[k], power[k]).morning(day, rhr[k], vo2=(48, 51)[k])
    row, got = outcome(spark, h, C.fitness_trend, DateRange("2024-06-02", "2024-06-08"))
    assert (row.state, row.vo2_support, row.action_kind) == want and (got[2], row.sample_quality) == ("medium", "mixed")


def test_consistency_index(spark):
    h = History()
    for k, bpm in enumerate((52, 52, 53, 52, 53, 52, 52)):
        day = f"2024-06-{8 + k:02d}"
        h.morning(day, bpm).night(day, 8, begin="22:00:00").rows["steps"].append((dt.datetime.fromisoformat(f"{day} 12:00:00"), 8500.0))
        if k < 4:
            h.run(day, day, 120, minutes=())
    row, got = outcome(spark, h, C.consistency_index, DateRange("2024-06-08", "2024-06-14"))
    assert got == ("strong", "maintain", "medium") and (row.direction, row.sample_quality) == ("insufficient_data", "mixed")


def test_run_fatigue_flags(spark):
    h = History().run("drift", "2024-06-10", (118, 132), (3.3, 3.1), (220, 210)).run("poor", "2024-06-11", (118, 119)).run("even", "2024-06-12", (118, 119), 3.2, (220, 210))
    for name, day in (("drift", "2024-06-10"), ("even", "2024-06-12")):
        begin = dt.datetime.fromisoformat(f"{day} 08:00:00")
        h.rows["workout_routes"].append((name, begin, begin + dt.timedelta(hours=1), "w", "/r.gpx"))
    h.morning("2024-06-09", 52, 60).morning("2024-06-10", 51, 62)
    rows = C.run_fatigue_flags(h.tables(spark), DateRange("2024-06-09", "2024-06-12")).collect()
    assert [r.workout_id for r in rows] == ["even", "poor", "drift"]
    drift, poor = rows[2], rows[1]
    assert (drift.diagnosis, drift.action_kind, drift.sample_quality) == ("cardiac_drift", "run_easier", "high")
    assert [e.label for e in drift.evidence] == ["HR drift", "Decoupling", "Pace/power fade", "Pre-run recovery"]
    assert drift.evidence[0].value_text == "11.9%" and drift.evidence[3].value_text == "RHR -1.0 bpm, HRV +2.0 ms"
    assert (poor.diagnosis, poor.action_kind, poor.confidence, poor.sample_quality) == ("poor_sample_quality", "retest", "low", "poor")


def test_drift_is_divided_before_it_is_taken_in_per_cent(spark):
    """As in the SQL: the other order ends in another digit, here -3.3984375, whose sixth place is rounded to another one."""
    h = History().run("tie", "2024-06-10", 160, 3.0, 200, minutes=())
    begin = dt.datetime.fromisoformat("2024-06-10 08:00:00")
    h.rows["heart_rate"] += [(begin + dt.timedelta(minutes=m), bpm, "w") for m, bpm in ((5, 160.0), *[(40 + k, 154.5) for k in range(7)], (50, 155.0))]
    found = C.run_fatigue_flags(h.tables(spark), DateRange("2024-06-10", "2024-06-10")).first().drift_pct
    assert found == (154.5625 - 160.0) / 160.0 * 100 != (154.5625 - 160.0) * 100 / 160.0


def test_report_computes_shared_inputs_once(spark, monkeypatch):
    calls = []
    for name in ("_pace", "_loads", "_rhr", "_hrv"):
        monkeypatch.setattr(C, name, lambda *a, _f=getattr(C, name), _n=name, **k: (calls.append(_n), _f(*a, **k))[1])
    assert "next_week_action" in C.advanced_report(History().tables(spark), LAST_WEEK).columns
    assert sorted(calls) == ["_hrv", "_loads", "_pace", "_rhr"]
