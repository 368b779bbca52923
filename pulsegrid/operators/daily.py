"""Daily and weekly series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import within
from pulsegrid.plans.ranges import DateRange


def daily_mean(df: DataFrame, columns: dict[str, str], r: DateRange | None = None) -> DataFrame:
    """Mean of each column by UTC day; a day needs one value that is not null."""
    known = F.coalesce(*[F.col(c) for c in columns]).isNotNull()
    return (
        df.filter(within("ts", r) & known)
        .groupBy(F.to_date("ts").alias("day"))
        .agg(*[F.avg(c).alias(name) for c, name in columns.items()])
        .orderBy("day")
    )


def daily_sum(df: DataFrame, columns: dict[str, str], r: DateRange | None = None) -> DataFrame:
    """Sum of each column by UTC day, 0 where all are null."""
    return (
        df.filter(within("ts", r))
        .groupBy(F.to_date("ts").alias("day"))
        .agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(name) for c, name in columns.items()])
        .orderBy("day")
    )


def resting_hr_daily(t, r=None):
    return daily_mean(t.resting_hr.filter("bpm is not null"), {"bpm": "avg_rhr"}, r)


def hrv_daily(t, r=None):
    return daily_mean(t.hrv, {"value": "avg_hrv"}, r)


def walking_hr_daily(t, r=None):
    return daily_mean(t.walking_hr, {"bpm": "avg_walking_hr"}, r)


def vo2max_daily(t, r=None):
    return daily_mean(t.performance, {"vo2max": "avg_vo2max"}, r)


def speed_daily(t, r=None):
    return daily_mean(t.performance, {"speed": "avg_speed"}, r)


def power_daily(t, r=None):
    return daily_mean(t.performance, {"power": "avg_power"}, r)


def running_dynamics_daily(t, r=None):
    return daily_mean(
        t.performance,
        {
            "vertical_oscillation_cm": "avg_vertical_oscillation_cm",
            "ground_contact_time_ms": "avg_ground_contact_time_ms",
            "stride_length_m": "avg_stride_length_m",
        },
        r,
    )


def steps_daily(t, r=None):
    return daily_sum(t.steps, {"count": "total_steps"}, r)


def distance_daily(t, r=None):
    return daily_sum(t.distance, {"meters": "total_meters"}, r)


def energy_daily(t, r=None):
    return daily_sum(t.energy, {"active_kcal": "active_kcal", "basal_kcal": "basal_kcal"}, r)


def weekly_activity(t, r=None):
    """Workouts and their seconds by week, which starts on Monday."""
    return (
        t.workouts.filter(within("start_ts", r))
        .groupBy(F.to_date(F.date_trunc("week", "start_ts")).alias("week"))
        .agg(F.count("*").alias("workout_count"), F.coalesce(F.sum("duration_sec"), F.lit(0.0)).alias("total_duration_sec"))
        .orderBy("week")
    )


def rolling_7d(series: DataFrame, value: str, name: str, r: DateRange | None = None) -> DataFrame:
    """Mean over a day and the six before it, of the days that have a value; ``series`` has a row for each day."""
    day = F.datediff("day", F.lit(dt.date(1970, 1, 1)))
    out = series.withColumn(name, F.avg(value).over(Window.orderBy(day).rangeBetween(-6, 0))).select("day", name)
    if r is not None:
        first, last = r.days()
        out = out.filter(F.col("day").between(F.lit(first), F.lit(last)))
    return out.orderBy("day")


def resting_hr_rolling_7d(t, r=None):
    wide = r and DateRange((r.days()[0] - dt.timedelta(days=6)).isoformat(), r.end)
    return rolling_7d(resting_hr_daily(t, wide), "avg_rhr", "avg_rhr_7d", r)
