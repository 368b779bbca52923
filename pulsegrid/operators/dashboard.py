"""Summaries that a dashboard shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import exprs as X
from pulsegrid.operators import context, daily, sleep
from pulsegrid.operators import workouts as W


def series_summary(t, r=None) -> DataFrame:
    """For each daily series: days, mean, least, greatest, first, latest and the change between them."""
    series = {
        "resting_hr": (daily.resting_hr_daily, "avg_rhr"),
        "hrv": (daily.hrv_daily, "avg_hrv"),
        "walking_hr": (daily.walking_hr_daily, "avg_walking_hr"),
        "vo2max": (daily.vo2max_daily, "avg_vo2max"),
        "speed": (daily.speed_daily, "avg_speed"),
        "power": (daily.power_daily, "avg_power"),
        "steps": (daily.steps_daily, "total_steps"),
    }
    rows = [f(t, r).select(F.lit(n).alias("series"), "day", F.col(v).alias("v")) for n, (f, v) in series.items()]
    return (
        reduce(lambda a, b: a.union(b), rows)
        .groupBy("series")
        .agg(
            F.count("*").alias("days"),
            F.round(F.avg("v"), 6).alias("mean"),
            F.min("v").alias("least"),
            F.max("v").alias("greatest"),
            F.min_by("v", "day").alias("first_value"),
            F.max_by("v", "day").alias("latest"),
        )
        .withColumn("delta", F.round(F.col("latest") - F.col("first_value"), 6))
    )


def context_coverage(t) -> DataFrame:
    """How many runs have stats, routes, pauses and an outdoor mark, in one row."""
    runs = t.running.select("id")
    has = lambda child, name: child.select(F.col("workout_id").alias("id"), F.lit(1).alias(name)).distinct()
    pauses = t.workout_events.filter("type = 'HKWorkoutEventTypePause'")
    outdoor = t.workout_metadata.filter("key = 'HKIndoorWorkout' and value = '0'")
    names = {"with_stats": t.workout_stats, "with_routes": t.workout_routes, "with_pauses": pauses, "outdoor": outdoor}
    df = reduce(lambda a, kv: a.join(has(kv[1], kv[0]), "id", "left"), names.items(), runs)
    return df.agg(F.count("*").alias("runs"), *[F.count(n).alias(n) for n in names])


def training_totals(t, r=None) -> DataFrame:
    """Sum of load, weekly minutes and means of run metrics with their coverage, in one row."""
    load = W.load(t, r).agg(F.round(F.sum(F.coalesce("load", F.lit(0.0))), 3).alias("total_load"), F.round(F.sum("duration_sec") / 60, 6).alias("minutes"))
    drift = W.drift(t, t.running).agg(F.round(F.avg("drift_pct"), 6).alias("mean_drift_pct"), F.count("drift_pct").alias("drift_runs"))
    return load.crossJoin(drift)  # one row each


def zone_share(t, last: int = 10) -> DataFrame:
    """Z2 and other share of the latest runs."""
    runs = t.running.orderBy(F.desc("start_ts"), "id").limit(last)
    return W.z2_ratio(t, runs).select("id", "z2_ratio", (1 - F.col("z2_ratio")).alias("other_ratio"))


def run_metrics(t) -> DataFrame:
    """For each metric of a run: mean over the runs that have it, how many these are, and both as texts.

    Values are taken to six places first, so that the order of sums decides nothing.
    """
    runs = t.running.select("id", "start_ts", "end_ts", "duration_sec")
    sums = runs.join(W.heart_rate_sums(t, runs), "id", "left").join(W.aligned_sums(t, runs), "id", "left")
    found = sums.select(W.drift_columns()[2], W.decoupling_columns()[-1], W.pace_columns()[-1], W.z2_share())
    percent = lambda x: F.concat(X.fixed(x, 1), F.lit("%"))
    metrics = {
        "drift_pct": percent,
        "decoupling_pct": percent,
        "pace_sec_per_km": X.pace_text,
        "z2_ratio": lambda x: F.concat(X.half_up(x * 100).cast("string"), F.lit("%")),
    }
    means = found.agg(*[x for name in metrics for x in (F.round(F.avg(F.round(name, 6)), 6).alias(f"{name}_mean"), F.count(name).alias(f"{name}_runs"))])
    n = F.col("runs")
    told = F.when(n == 0, "No qualifying runs").when(n == 1, "1 qualifying run").otherwise(F.concat(n.cast("string"), F.lit(" qualifying runs")))

    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"{name}_mean").alias("mean"), F.col(f"{name}_runs").alias("runs")) for name in metrics]))
    shown = reduce(lambda rest, kv: F.when(F.col("metric") == kv[0], kv[1](F.col("mean"))).otherwise(rest), metrics.items(), F.lit(None).cast("string"))
    return means.select(rows.alias("m")).select("m.*").select("metric", "mean", "runs", F.coalesce(shown, F.lit("unknown")).alias("shown"), told.alias("coverage"))


def hours_and_km(t, r=None) -> DataFrame:
    """Points of two series: hours of training by week and kilometres by day, each at the beginning of its day."""
    hours = daily.weekly_activity(t, r).select(F.lit("Hours").alias("series"), F.col("week").alias("at"), (F.col("total_duration_sec") / 3600).alias("value"))
    km = daily.distance_daily(t, r).select(F.lit("Distance km").alias("series"), F.col("day").alias("at"), (F.col("total_meters") / 1000).alias("value"))
    return hours.union(km).select("series", F.col("at").cast("timestamp_ntz").alias("at"), "value").orderBy("series", "at")


def sleep_page(t, r=None, night: str | None = None) -> DataFrame:
    """One row: the night that is asked for or else the latest, its segments, and sums over all nights of the range; no row without nights."""
    stages = [F.col(f"{s}_hours") for s in ("core", "deep", "rem", "unspecified")]
    nights = sleep.nights(t, r).select("day", F.round("asleep_hours", 6).alias("asleep_hours"), F.round("efficiency", 6).alias("efficiency"), F.coalesce(*stages).isNotNull().alias("staged"))
    asked = F.col("day") == F.lit(night).cast("date") if night else F.lit(False)
    chosen = F.max_by(F.struct("day", "asleep_hours", "efficiency"), F.struct(asked, "day")).alias("chosen")
    sums = nights.agg(
        chosen, F.count("*").alias("nights"), F.sum("asleep_hours").alias("total_asleep_hours"), F.avg("asleep_hours").alias("avg_asleep_hours"), F.avg("efficiency").alias("avg_efficiency"), F.count_if("staged").alias("staged_nights")
    ).filter("nights > 0")
    per_night = sleep.segments(t, r).groupBy("night").agg(F.count("*").alias("segments"))
    out = sums.join(per_night, F.col("chosen.day") == F.col("night"), "left")
    named = [F.col("chosen.day").alias("selected_night"), F.col("chosen.asleep_hours").alias("selected_asleep_hours"), F.col("chosen.efficiency").alias("selected_efficiency"), F.coalesce("segments", F.lit(0)).alias("selected_segments")]
    return out.select(*named, "nights", "total_asleep_hours", "avg_asleep_hours", "avg_efficiency", "staged_nights")
