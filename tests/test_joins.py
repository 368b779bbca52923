"""Interval and nearest joins against all pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import joins as J

T0 = dt.datetime(2024, 3, 1)
ROW = "start_ts timestamp_ntz, end_ts timestamp_ntz"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def made(spark):
    """Intervals of seconds to half a year; half of all points lie in one hour."""
    rng = random.Random(3)
    spans = [(i, at(a), at(a + n)) for i in range(120) for a, n in [(rng.randint(-10**6, 10**6), rng.choice([0, 30, 600, 5000, 30_000, 200_000, 3_000_000, 15_000_000]))]]
    spans += [(200, at(7200), at(7300)), (201, at(9000), at(8000)), (202, None, at(5))]
    points = [(at(rng.randint(7200, 10_799)), float(i), "w") for i in range(1500)] + [(at(rng.randint(-10**6, 10**6)), float(i), "w") for i in range(1500)]
    points += [(at(7200), 0.0, "w")] * 3 + [(None, 1.0, "w")]
    return spark.createDataFrame(spans, f"id long, {ROW}"), spark.createDataFrame(points, "ts timestamp_ntz, bpm double, source string")


def all_pairs(intervals, points):
    return intervals.join(points, F.col("ts").between(F.col("start_ts"), F.col("end_ts")))


@pytest.mark.parametrize("sizes", [J.SIZES, (3600,), (600, 7200)])
@pytest.mark.parametrize("salts", [1, 8])
def test_interval_join_equals_all_pairs(made, sizes, salts):
    got = J.interval_join(*made, sizes=sizes, salts=salts)
    want = all_pairs(*made)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_bucket_holds_a_large_share_of_points(made):
    """Half of all samples lie in one hour; no part of a bucket holds more than an eighth of them."""
    _, points = made
    dealt = J.dealt_points(points, "ts", F.array(F.lit(3600).cast("long")), J.SALTS)
    most = dealt.groupBy("_size", "_bucket", "_salt").count().agg(F.max("count")).first()[0]
    assert most <= points.count() / 8
    hour = dealt.groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert hour >= points.count() / 2 - 10


def test_intervals_are_listed_in_few_buckets(made):
    intervals, _ = made
    listed = J.listed_intervals(intervals, "start_ts", "end_ts", J.SIZES, 1).groupBy("id", "_size").count()
    assert listed.filter("_size < 2592000").agg(F.max("count")).first()[0] <= J.LISTED
    assert {r["_size"] for r in listed.collect()} == set(J.SIZES)


def test_points_are_listed_for_sizes_in_use_only(made):
    intervals, points = made
    short = intervals.filter("id = 200")
    plan = J.interval_join(short, points)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" in plan
    used = J.listed_intervals(short, "start_ts", "end_ts", J.SIZES, 1).agg(F.collect_set("_size")).first()[0]
    assert used == [3600]
    assert J.interval_join(short.filter("false"), points).count() == 0


def test_points_meet_intervals_in_short_arrays(made):
    """All points once, in order of time, however many a part has; an interval joins arrays, not points."""
    intervals, points = made
    dealt = J.dealt_points(points.filter("ts is not null"), "ts", F.array(F.lit(3600).cast("long")), 2)
    packs = J.packed_points(dealt, "ts", points.columns, ["_size", "_bucket", "_salt"]).collect()
    assert sorted(tuple(p) for r in packs for p in r["_points"]) == sorted(tuple(p) for p in points.filter("ts is not null").collect())
    assert max(len(r["_points"]) for r in packs) == J.PACK
    assert all((r["_from"], r["_to"]) == (min(p.ts for p in r["_points"]), max(p.ts for p in r["_points"])) for r in packs)
    crowded = sorted((r["_from"], r["_to"]) for r in packs if r["_salt"] == 0 and r["_from"] >= at(7200) and r["_to"] < at(10_800))
    assert len(crowded) > 3 and all(a[1] <= b[0] for a, b in zip(crowded, crowded[1:]))
    assert "inline(_points" in J.interval_join(*made)._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]


def test_clashing_columns_are_refused(made):
    intervals, points = made
    with pytest.raises(ValueError, match="bpm"):
        J.interval_join(intervals.withColumn("bpm", F.lit(1)), points)


@pytest.mark.parametrize("stretch", [3600, 120])
def test_nearest_join_equals_all_pairs(spark, stretch):
    rng = random.Random(8)
    left = [(rng.randint(0, 2), at(rng.randint(0, 9000)), rng.choice([1.0, 2.0]), "x") for _ in range(400)]
    left += [left[0]] * 2 + [(0, at(3600), 1.0, "x"), (0, at(3599), 1.0, "x"), (9, at(0), 1.0, "x")]
    right = [(rng.randint(0, 2), at(s), float(rng.randint(0, 9))) for s in rng.sample(range(0, 9000), 250)] + [(0, at(3660), 5.0), (0, at(3540), 6.0)]
    a = spark.createDataFrame(left, "id long, ts timestamp_ntz, speed double, note string")
    b = spark.createDataFrame(right, "id long, hr_ts timestamp_ntz, bpm double")
    got = J.nearest_join(a, b, ["id"], "ts", "hr_ts", 60, ["id", "ts", "speed"], stretch)
    want = {}
    for i, t, v, _ in left:
        near = sorted((abs((u - t).total_seconds()), u, x) for j, u, x in right if i == j and abs((u - t).total_seconds()) <= 60)
        if near:
            want[i, t, v] = near[0][1:]
    assert got.columns == ["id", "ts", "speed", "note", "hr_ts", "bpm"]
    rows = got.collect()
    assert len(rows) == len(want) and {(r.id, r.ts, r.speed): (r.hr_ts, r.bpm) for r in rows} == want


def test_nearest_join_shuffles_once(spark):
    a = spark.range(10).selectExpr("id", "cast('2024-01-01' as timestamp_ntz) as ts", "1.0 as speed")
    b = spark.range(10).selectExpr("id", "cast('2024-01-01' as timestamp_ntz) as hr_ts", "2.0 as bpm")
    plan = J.neighbours(a, b, ["id"], "ts", "hr_ts", 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_moments_at_one_time(spark):
    a = spark.createDataFrame([(1, at(10))], "id long, ts timestamp_ntz")
    b = spark.createDataFrame([(1, at(5), 3.0), (1, at(5), 4.0), (1, at(70), 9.0)], "id long, hr_ts timestamp_ntz, bpm double")
    assert J.nearest_join(a, b, ["id"], "ts", "hr_ts", 60, ["id", "ts"]).first().bpm == 4.0
