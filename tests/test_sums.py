"""Sums over samples of workouts against all pairs, and that no query that only sums makes pairs."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import epoch
from pulsegrid.operators import composites, context, dashboard
from pulsegrid.operators import joins as J
from pulsegrid.operators import workouts as W
from pulsegrid.plans import queries
from pulsegrid.plans.ranges import DateRange
from pulsegrid.plans.synth import Tables, derived

T0 = dt.datetime(2024, 3, 1, 22)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def made(spark):
    """Workouts of a second to two days around midnight, some without heartbeats; samples in whole seconds, so that many stand on the ends."""
    rng = random.Random(5)
    spans = [(str(i), at(a), at(a + n), float(rng.choice([n, 3000, 9000]))) for i in range(80) for a, n in [(rng.randint(0, 20_000), rng.choice([1, 50, 70, 600, 4000, 9000, 170_000]))]]
    spans += [("z", at(90_000), at(90_500), 500.0), ("y", at(50), at(10), 5.0), ("x", None, at(10), 5.0), ("w", at(100), at(100), 3600.0)]
    beats = [(at(s), rng.choice([119.5, 121.0, 125.0, 150.0, 0.1]), "w") for s in rng.sample(range(0, 24_000), 500)] + [(at(100), 120.0, "w"), (None, 1.0, "w")]
    speeds = [(at(rng.randint(0, 24_000)), rng.choice([2.1, 3.3, 0.0, None]), rng.choice([None, 200.0])) for _ in range(900)] + [(at(90_100), 3.0, None)]
    return Tables(
        workouts=spark.createDataFrame(spans, "id string, start_ts timestamp_ntz, end_ts timestamp_ntz, duration_sec double"),
        heart_rate=spark.createDataFrame(beats, "ts timestamp_ntz, bpm double, source string"),
        performance=spark.createDataFrame(speeds, "ts timestamp_ntz, speed double, power double"),
    )


def rows(df):
    return {r[0]: tuple(None if x is None else round(x, 9) for x in r[1:]) for r in df.collect()}


def test_sums_equal_all_pairs(spark, made):
    points = [(float(s), v) for s, v in [(0, 1.1), (0, 2.2), (86_399, 3.3), (86_400, 1e300), (86_400, 4.4), (200_000, float("inf")), (300_000, float("-inf")), (400_000, float("nan")), (500_000, None), (500_001, 0.1)]]
    ends = [(i, float(a), float(b)) for i, (a, b) in enumerate([(0, 0), (0, 86_399), (1, 86_400), (86_401, 199_999), (100, 250_000), (100, 350_000), (350_000, 450_000), (450_000, 500_000), (450_000, 600_000), (500_001, 500_001), (5, 4)])]
    frame = spark.createDataFrame(points, "_at double, v double").select("_at", *J.measured("v"))
    pieces = F.array(J.piece("all", J.cut(F.col("a")), J.cut(F.col("b"), True)))
    got = J.interval_sums(spark.createDataFrame(ends, "id long, a double, b double"), pieces, frame, ["id"], ["all"]).select("id", J.mean("v", "all"), J.total("v_n", "all")).collect()
    assert {r[0] for r in got} == set(range(10))
    for i, m, n in got:
        inside = [v for s, v in points if ends[i][1] <= s <= ends[i][2] and v is not None]
        want = math.fsum(inside) / len(inside) if inside and not {math.inf, -math.inf} <= set(inside) else None
        assert n == len(inside)
        if any(map(math.isnan, inside)) or {math.inf, -math.inf} <= set(inside):
            assert math.isnan(m)
        else:
            assert m == pytest.approx(want) if want is not None else m is None


def test_halves_equal_all_pairs(made):
    inside = made.workouts.join(made.heart_rate, F.col("ts").between(F.col("start_ts"), F.col("end_ts")))
    first = epoch("ts") < (epoch("start_ts") + epoch("end_ts")) / 2
    pairs = inside.groupBy("id").agg(F.avg(F.when(first, F.col("bpm"))), F.avg(F.when(~first, F.col("bpm"))), F.count("*"))
    sums = W.heart_rate_sums(made, made.workouts).select("id", J.mean("bpm", "first"), J.mean("bpm", "second"), J.total("hr", *W.HALVES).alias("n")).filter("n > 0")
    assert rows(sums) == rows(pairs)


def test_aligned_sums_equal_all_pairs(made):
    each = W.aligned(made)
    pace = rows(each.groupBy("id").agg(*[f(F.when(F.col("bpm").between(120, 130) & (F.col("speed") > 0), F.col("speed"))) for f in (F.count, F.avg)]))
    got = rows(W.pace_at_hr(made).select("id", "sample_count", "avg_speed_mps"))
    assert len(got) == 84 and sum(n for n, _ in got.values()) > 100
    assert got == {i: pace.get(i, (0, None)) for i in got}
    hour = F.least("duration_sec", F.lit(3600.0))
    used = each.filter((F.col("speed") > 0) & (epoch("ts") <= epoch("start_ts") + hour))
    p, first = F.lit(1000.0) / F.col("speed"), epoch("ts") < epoch("start_ts") + hour / 2
    halves = rows(used.groupBy("id").agg(F.count("*"), *[F.avg(F.when(side, x)) for side in (first, ~first) for x in (p, F.col("bpm"))]))
    sums = rows(W.aligned_sums(made, made.workouts).select("id", J.total("used", "hour1", "hour2").alias("n"), *[J.mean(v, h) for h in ("hour1", "hour2") for v in ("pace", "bpm")]).filter("n > 0"))
    assert sums == halves


def aligned_pieces(made, f, monkeypatch):
    """Parts of workouts that a query sums."""
    seen, found = [], J.interval_sums
    monkeypatch.setattr(W, "interval_sums", lambda *args: (seen.append(args[4]), found(*args))[1])
    assert f(made).columns
    return seen


def test_pace_sums_whole_workouts_once(made, monkeypatch):
    assert aligned_pieces(made, W.pace_at_hr, monkeypatch) == [["all"]]


def test_load_quality_sums_the_first_hour_alone(spark, sf_dir, monkeypatch):
    assert aligned_pieces(derived(spark, sf_dir), lambda t: composites.load_quality(t, DateRange("2024-01-15", "2024-01-21")), monkeypatch) == [["all"], ["hour1", "hour2"]]


def test_fitness_trend_sums_whole_workouts_once(spark, sf_dir, monkeypatch):
    assert aligned_pieces(derived(spark, sf_dir), lambda t: composites.fitness_trend(t, DateRange("2024-01-15", "2024-01-21")), monkeypatch) == [["all"]]


def test_near_heartbeats_tell_whether_any_lies_inside(spark):
    """Workouts of 119 to 121 seconds and longer ones with heartbeats and speeds about both ends, against all pairs."""
    starts = range(0, 60_000, 1000)
    rng = random.Random(8)
    spans, beats, speeds = [], [], []
    for i, s in enumerate(starts):
        n = [0, 1, 60, 119, 120, 121, 180, 300, 500, 700][i % 10]
        spans.append((str(i), at(s), at(s + n), float(n)))
        beats += [(at(s + x), 125.0, "w") for x in rng.sample([-61, -60, -59, -1, 0, 1, 59, 60, 61, n - 61, n - 60, n - 1, n, n + 1, n + 30, n + 60], rng.choice([0, 1, 2]))]
        speeds += [(at(s + x), 3.0 + x / 1000, None) for x in {0, 1, 30, 59, 60, 61, 119, 120, n - 61, n - 60, n - 59, n - 1, n} if 0 <= x <= n]
    t = Tables(
        workouts=spark.createDataFrame([*spans, ("null", None, at(5), 5.0), ("turned", at(50), at(10), 5.0)], "id string, start_ts timestamp_ntz, end_ts timestamp_ntz, duration_sec double"),
        heart_rate=spark.createDataFrame(beats, "ts timestamp_ntz, bpm double, source string"),
        performance=spark.createDataFrame(speeds, "ts timestamp_ntz, speed double, power double"),
    )
    want = {}
    for i, s, e, _ in spans:
        mine = [b for b, *_ in beats if s <= b <= e]
        n = sum(s <= ts <= e and any(abs((b - ts).total_seconds()) <= 60 for b in mine) for ts, *_ in speeds)
        want |= {i: n} if n else {}
    got = W.aligned_sums(t, t.workouts).select("id", J.total("times", "all").alias("n")).filter("n > 0")
    assert len(want) > 20 and {r.id: r.n for r in got.collect()} == want


def test_near_samples_equal_all_pairs(made):
    inside = made.workouts.join(made.performance, F.col("ts").between(F.col("start_ts"), F.col("end_ts"))).filter("speed is not null").withColumn("n", F.monotonically_increasing_id()).collect()
    beats = [r.ts for r in made.heart_rate.filter("ts is not null").collect()]
    want = {}
    for r in inside:
        if any(r.start_ts <= b <= r.end_ts and abs((b - r.ts).total_seconds()) <= 60 for b in beats):
            want[r.id] = want.get(r.id, 0) + 1
    got = W.aligned_sums(made, made.workouts).select("id", J.total("times", "all").alias("n")).filter("n > 0")
    assert {r.id: r.n for r in got.collect()} == want


def test_halves_share_the_cut_between_them(spark):
    ends = {"a": (0, 3600), "midnight": (5000, 9000), "point": (70, 70), "turned": (90, 80)}  # T0 is two hours before midnight
    spans = spark.createDataFrame([(k, at(a), at(b)) for k, (a, b) in ends.items()], "id string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = J.cuts_of(spans, W._halves(), ["id"]).groupBy("id").agg(F.count("*").alias("n"))
    assert {r.id: r.n for r in got.collect()} == {"a": 3, "midnight": 4, "point": 3}


def test_means_of_whole_workouts_cut_them_at_their_ends_only(made, monkeypatch):
    monkeypatch.setattr(W, "_halves", None)  # would fail where halves are asked for
    inside = made.workouts.join(made.heart_rate, F.col("ts").between(F.col("start_ts"), F.col("end_ts")))
    want = rows(inside.groupBy("id").agg(F.first("duration_sec") * F.avg("bpm")))
    assert {i: x for i, (x,) in rows(W.load(made).select("id", "load")).items() if x is not None} == {i: pytest.approx(x) for i, (x,) in want.items()}
    assert rows(W.loads(made, made.workouts).select("id", "load")) == {i: pytest.approx(x) for i, x in want.items()}
    assert W.z2_ratio(made).columns and W.zone_breakdown(made).columns


def test_zone_time_equals_all_pairs(made):
    beats = sorted((r.ts, r.bpm) for r in made.heart_rate.filter("ts is not null").collect())
    want = {}
    for w in made.workouts.filter("start_ts <= end_ts").collect():
        mine = [b for b in beats if w.start_ts <= b[0] <= w.end_ts]
        for (ts, bpm), later in zip(mine, [b[0] for b in mine[1:]] + [w.end_ts]):
            zone = next((z for z, (a, b) in W.ZONES.items() if a <= bpm <= b), None)
            want[zone] = want.get(zone, 0) + min(120, (later - ts).total_seconds())
    got = {r.zone: r.duration_sec for r in W.zone_time(made).collect()}
    assert got == pytest.approx({z: want.get(z, 0) for z in W.ZONES})


def test_sums_make_no_pairs(spark, sf_dir, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("pairs of workouts and samples")

    monkeypatch.setattr(W, "interval_join", refuse)
    t = derived(spark, sf_dir)
    per_workout = (W.load, W.drift, W.fade, W.z2_ratio, W.zone_breakdown, W.zone_time, W.pace_at_hr, W.decoupling, W.detail, W.economy_averages)
    for f in (*per_workout, context.sample_quality, composites.run_fatigue_flags, dashboard.training_totals, dashboard.run_metrics):
        assert f(t).columns


def test_heart_rate_stream_is_not_sorted(spark, sf_dir):
    plan = W.hr_stream(derived(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort " not in plan


def test_pairs_of_workouts_and_samples_need_no_reckoning_of_time(spark, sf_dir):
    plan = W.aligned(derived(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert "unix_micros" in plan and "unix_micros" not in plan.split("Join Inner")[0]


def above_pairs(spark, sf_dir, name):
    plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" in plan
    return plan.split("Join Inner")[0]


def test_heart_rate_is_rounded_once_a_sample_not_once_a_pair(spark, sf_dir, made):
    assert "round(" not in above_pairs(spark, sf_dir, "workout_hr_stream")
    fine = Tables(workouts=made.workouts, heart_rate=made.heart_rate.withColumn("bpm", F.col("bpm") / 7))
    short, whole = W.hr_stream(fine, digits=6), W.hr_stream(fine)
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, whole.withColumn("bpm", F.round("bpm", 6)).collect()))


def test_aligned_samples_are_rounded_once_a_sample_not_once_a_pair(spark, sf_dir, made):
    assert "round(" not in above_pairs(spark, sf_dir, "aligned_samples")
    fine = Tables(workouts=made.workouts, heart_rate=made.heart_rate.withColumn("bpm", F.col("bpm") / 7), performance=made.performance.withColumn("speed", F.col("speed") / 3))
    short, whole = W.aligned(fine, digits=6), W.aligned(fine)
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, short.collect()), key=key) == sorted(map(tuple, whole.withColumn("speed", F.round("speed", 6)).withColumn("bpm", F.round("bpm", 6)).collect()), key=key)
    # against all pairs: the nearest heartbeat inside the workout, the earlier on ties
    inside = lambda table: made.workouts.join(table, F.col("ts").between(F.col("start_ts"), F.col("end_ts")))
    beats = {}
    for r in inside(fine.heart_rate).select("id", "ts").collect():
        beats.setdefault(r.id, []).append(r.ts)
    want = set()
    for r in inside(fine.performance.filter("speed is not null")).select("id", "ts", "speed").collect():
        near = sorted((abs((b - r.ts).total_seconds()), b) for b in beats.get(r.id, []) if abs((b - r.ts).total_seconds()) <= 60)
        want |= {(r.id, r.ts, r.speed, near[0][1])} if near else set()
    got = [tuple(r) for r in whole.select("id", "ts", "speed", "hr_ts").collect()]
    assert len(got) == len(want) > 500 and set(got) == want
