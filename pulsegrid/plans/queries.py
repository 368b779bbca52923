"""Queries of the analytics engine, by name; each takes a session and a folder of tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import composites, context, daily, dashboard, sleep
from pulsegrid.operators import workouts as W
from pulsegrid.plans.ranges import DateRange
from pulsegrid.plans.synth import derived
from pulsegrid.schemas import SLEEP_STATES
from pulsegrid.sources import mappers as M
from pulsegrid.sources import store

#: The events of the tables lie in January 2024.
WEEK = DateRange("2024-01-15", "2024-01-21")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles of results rounded, since sums depend on the order of rows in the last digit."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _flat(df: DataFrame) -> DataFrame:
    """A composite with its evidence as one text, label=value; the recommendation only words its action."""
    number = lambda e: F.concat(F.lit("n:"), F.format_string("%.4f", e.value_num))
    shown = lambda e: F.when(e.value_text.isNotNull(), e.value_text).when(e.value_num.isNotNull(), number(e)).otherwise("none")
    told = F.array_join(F.transform("evidence", lambda e: F.concat(F.translate(e.label, " ", "_"), F.lit("="), shown(e))), "; ")
    return df.drop("recommendation").withColumn("evidence", told)


def _ingest_rows(spark, sf_dir) -> DataFrame:
    """Events, each fifth one twice, as rows with keys."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    again = events.filter("event_id % 5 = 0").withColumn("event_id", F.col("event_id") + 1_000_000)
    both = events.union(again)
    return both.select(
        F.concat_ws("|", "event_type", F.col("user_id").cast("string"), M.text_of(F.col("ts"))).alias("dedup_key"), F.col("event_id").alias("place"), F.col("ts").alias("end_ts_key"), "event_type"
    )


def _units(spark, sf_dir) -> DataFrame:
    """All unit rules over line items, with units dealt out by key."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("v"))
    pick = lambda *units: F.element_at(F.array(*[F.lit(u) for u in units]), (F.col("l_orderkey") % len(units) + 1).cast("int"))
    return df.select(
        "l_orderkey",
        "l_linenumber",
        M.meters(F.col("v"), pick("m", " KM", "mi", "ft", "yd")).alias("meters"),
        M.kcal(F.col("v"), pick("kcal", "Cal", "kJ", "wh")).alias("kcal"),
        M.meters_per_second(F.col("v"), pick("m/s", "km/hr", "mi/h", "kn")).alias("mps"),
        M.length(F.col("v"), pick("m", "cm", "mm", "in")).alias("length"),
        M.seconds(F.col("v"), pick("s", "min", "hr", "Min")).alias("seconds"),
        M.contact_ms(F.col("v"), pick("s", "ms")).alias("contact_ms"),
    )


def _numbers(spark, sf_dir) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    forms = F.element_at(F.array(*[F.lit(x) for x in ("12", " 3.5 ", "", "1e3", "NaN", "12kg", ".5")]), (F.col("event_id") % 7 + 1).cast("int"))
    return events.select("event_id", M.number(forms).alias("value"), M.prefix_number(forms).alias("prefix"))


def _sleep_states(spark, sf_dir) -> DataFrame:
    """All states of the export and one that it does not know, dealt out over events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = F.array(*[F.lit(n) for n in [*SLEEP_STATES, "Dozing"]])
    raw = F.element_at(names, (F.col("event_id") % (len(SLEEP_STATES) + 1) + 1).cast("int"))
    return events.groupBy(raw.alias("raw"), M.sleep_state(raw).alias("mapped")).agg(F.count("*").alias("n"))


def _workout_ids(spark, sf_dir) -> DataFrame:
    t = derived(spark, sf_dir)
    return t.workouts.select("id", M.workout_id(F.concat(F.lit(M.WORKOUT_PREFIX), F.col("type")), F.col("start_ts"), F.col("end_ts")).alias("workout_id"))


def queries():
    plain = {
        "resting_hr_daily": daily.resting_hr_daily,
        "hrv_daily": daily.hrv_daily,
        "walking_hr_daily": daily.walking_hr_daily,
        "vo2max_daily": daily.vo2max_daily,
        "speed_daily": daily.speed_daily,
        "power_daily": daily.power_daily,
        "running_dynamics_daily": daily.running_dynamics_daily,
        "steps_daily": daily.steps_daily,
        "distance_daily": daily.distance_daily,
        "energy_daily": daily.energy_daily,
        "weekly_activity": daily.weekly_activity,
        "resting_hr_rolling_7d": lambda t: daily.resting_hr_rolling_7d(t, DateRange("2024-01-05", "2024-01-25")),
        "workouts_list": lambda t: W.listed(t, WEEK, "Running"),
        "workouts_page": lambda t: W.listed(t, limit=20, offset=40),
        "workout_summary": W.listed,
        "workout_hr_stream": lambda t: W.hr_stream(t, digits=6),
        "load_per_workout": W.load,
        "drift_per_workout": W.drift,
        "fade_per_workout": W.fade,
        "z2_ratio_range": lambda t: W.z2_ratio_range(t, WEEK),
        "z2_ratio_per_workout": W.z2_ratio,
        "zone_breakdown": W.zone_breakdown,
        "zone_time_distribution": W.zone_time,
        "sleep_summary": lambda t: sleep.summary(t, WEEK),
        "sleep_nightly": sleep.nightly,
        "sleep_nights": sleep.nights,
        "sleep_segments": sleep.segments,
        "aligned_samples": lambda t: W.aligned(t, digits=6).select("id", "ts", "speed", "hr_ts", "bpm"),
        "pace_at_hr": W.pace_at_hr,
        "decoupling": W.decoupling,
        "workout_detail": W.detail,
        "workout_stats": context.stats,
        "workout_events": context.events,
        "workout_metadata": context.metadata,
        "workout_routes": context.routes,
        "sample_quality": lambda t: context.sample_quality(t).withColumn("issues", F.array_join("issues", ",")),
        "workout_context": context.context_summary,
        "economy_averages": lambda t: W.economy_averages(t, WEEK),
        "readiness": lambda t: _flat(composites.readiness(t, WEEK)),
        "training_strain": lambda t: _flat(composites.training_strain(t, WEEK)),
        "recovery_debt": lambda t: _flat(composites.recovery_debt(t, WEEK)),
        "fitness_trend": lambda t: _flat(composites.fitness_trend(t, WEEK)),
        "aerobic_efficiency": lambda t: _flat(composites.aerobic_efficiency(t, WEEK)),
        "load_quality": lambda t: _flat(composites.load_quality(t, WEEK)),
        "consistency_index": lambda t: _flat(composites.consistency_index(t, WEEK)),
        "run_economy": lambda t: _flat(composites.run_economy(t, WEEK)),
        "run_fatigue_flags": lambda t: _flat(composites.run_fatigue_flags(t)),
        "advanced_report": lambda t: _flat(composites.advanced_report(t, WEEK)),
        "dashboard_series_summary": dashboard.series_summary,
        "run_context_coverage": dashboard.context_coverage,
        "dashboard_training_totals": lambda t: dashboard.training_totals(t, WEEK),
        "run_zone_share": dashboard.zone_share,
        "run_metric_summary": dashboard.run_metrics,
        "hours_km_series": dashboard.hours_and_km,
        "sleep_page": dashboard.sleep_page,
    }
    digits = {"load_per_workout": 4, "workout_detail": 4, "dashboard_training_totals": 3}
    before_pairs = ("workout_hr_stream", "aligned_samples")  # rounded once a sample

    def over_tables(name, f):
        if name in before_pairs:
            return lambda spark, sf_dir: f(derived(spark, sf_dir))
        return lambda spark, sf_dir: rounded(f(derived(spark, sf_dir)), digits.get(name, 6))

    found = {name: over_tables(name, f) for name, f in plain.items()}
    cutoff = dt.datetime(2024, 1, 20) - store.LOOKBACK
    found["ingest_dedup_first_wins"] = lambda s, d: store.first_wins(_ingest_rows(s, d)).select("dedup_key", "place")
    found["ingest_incremental_filter"] = lambda s, d: store.not_older(_ingest_rows(s, d), cutoff).groupBy("event_type").agg(F.count("*").alias("n"))
    found["ingest_unseen"] = lambda s, d: store.unseen(_ingest_rows(s, d), _ingest_rows(s, d).filter("place % 2 = 0")).groupBy("event_type").agg(F.count("*").alias("n"))
    found["unit_normalisation"] = lambda s, d: rounded(_units(s, d))
    found["number_parsing"] = lambda s, d: rounded(_numbers(s, d))
    found["sleep_state_map"] = _sleep_states
    found["workout_id_sha1"] = _workout_ids
    return found
