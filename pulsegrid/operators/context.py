"""What surrounds a workout: child rows, sample quality and context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import workouts as W
from pulsegrid.operators.joins import total


def stats(t) -> DataFrame:
    return t.workout_stats.orderBy("workout_id", "type")


def events(t) -> DataFrame:
    return t.workout_events.orderBy("workout_id", "ts", "type")


def metadata(t) -> DataFrame:
    return t.workout_metadata.orderBy("workout_id", "key", "value")


def routes(t) -> DataFrame:
    return t.workout_routes.orderBy("workout_id", "start_ts")


def _counted(base: DataFrame, child: DataFrame, name: str) -> DataFrame:
    return base.join(child.groupBy(F.col("workout_id").alias("id")).agg(F.count("*").alias(name)), "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def quality_of(t, sums: DataFrame) -> DataFrame:
    """Workouts with sums over their heart rate, performance and aligned samples, with their counts, issues and quality added."""
    halves = W.HALVES
    base = sums.select(
        "*",
        total("hr", *halves).alias("hr_samples"),
        total("speed_n", *halves).alias("speed_samples"),
        total("power_n", *halves).alias("power_samples"),
        total("times", "all").alias("aligned_speed_hr_samples"),
    )
    for child, name in ((t.workout_routes, "route_count"), (t.workout_stats, "n_stats"), (t.workout_events, "n_events"), (t.workout_metadata, "n_metadata")):
        base = _counted(base, child, name)
    base = base.withColumn("context_count", F.col("n_stats") + F.col("n_events") + F.col("n_metadata") + F.col("route_count"))
    issue = lambda name, when: F.when(when, F.lit(name))
    zero = lambda c: F.col(c) == 0
    gap = (F.col("speed_samples") > 0) & (F.col("hr_samples") > 0) & zero("aligned_speed_hr_samples")
    hard = (F.col("duration_sec") < W.MIN_WINDOW_SECONDS) | zero("hr_samples") | zero("speed_samples") | gap
    issues = F.array_compact(
        F.array(
            issue("too_short", F.col("duration_sec") < W.MIN_WINDOW_SECONDS),
            issue("missing_hr", zero("hr_samples")),
            issue("missing_speed", zero("speed_samples")),
            issue("missing_power", zero("power_samples")),
            issue("alignment_gap", gap),
            issue("missing_route", zero("route_count")),
            issue("missing_context", zero("context_count")),
        )
    )
    return base.withColumn("issues", issues).withColumn("sample_quality", F.when(hard, "poor").when(F.size("issues") > 0, "mixed").otherwise("high"))


def sample_quality(t, workouts=None) -> DataFrame:
    """Sample counts, issues in a fixed order, and poor, mixed or high."""
    spans = t.workouts if workouts is None else workouts
    return quality_of(t, W.with_sums(t, spans.select("id", "start_ts", "end_ts", "duration_sec"))).select(
        F.col("id").alias("workout_id"),
        "sample_quality",
        "issues",
        "duration_sec",
        "hr_samples",
        "speed_samples",
        "power_samples",
        "aligned_speed_hr_samples",
        "route_count",
        "context_count",
    )


def context_summary(t, workouts=None) -> DataFrame:
    """Counts of child rows, weather and elevation flags, and where the workout took place."""
    key, value = F.lower("key"), F.lower("value")
    flags = t.workout_metadata.groupBy(F.col("workout_id").alias("id")).agg(
        F.count("*").alias("metadata_count"),
        F.count_if(key.contains("indoor") & value.isin("1", "true", "yes")).alias("indoor"),
        F.count_if(key.contains("indoor") & value.isin("0", "false", "no")).alias("outdoor"),
        F.count_if(key.contains("weather") | value.contains("weather")).alias("weather"),
        F.count_if(key.contains("elevation") | key.contains("altitude") | value.contains("elevation") | value.contains("altitude")).alias("elevation"),
    )
    kinds = t.workout_events.groupBy(F.col("workout_id").alias("id")).agg(
        F.count_if(F.lower("type").contains("pause")).alias("pause_count"), F.count_if(F.lower("type").contains("segment")).alias("segment_count")
    )
    base = (t.workouts if workouts is None else workouts).select("id").join(flags, "id", "left").join(kinds, "id", "left")
    base = _counted(_counted(base, t.workout_routes, "route_count"), t.workout_stats, "stat_count")
    base = base.fillna(0, ["metadata_count", "indoor", "outdoor", "weather", "elevation", "pause_count", "segment_count"])
    label = F.when(F.col("indoor") > 0, "indoor").when(F.col("route_count") > 0, "outdoor_route").when(F.col("outdoor") > 0, "outdoor_no_route").otherwise("unknown")
    return base.select(
        F.col("id").alias("workout_id"),
        label.alias("context_label"),
        "route_count",
        "stat_count",
        "pause_count",
        "segment_count",
        "metadata_count",
        (F.col("weather") > 0).alias("has_weather"),
        (F.col("elevation") > 0).alias("has_elevation"),
    )
