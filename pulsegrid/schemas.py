"""Tables of the health store: names, columns and allowed values."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"text": T.StringType(), "ts": T.TimestampNTZType(), "num": T.DoubleType()}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split(":") for c in columns.split())])


TABLES = {
    "workouts": _schema("id:text type:text start_ts:ts end_ts:ts duration_sec:num source:text"),
    "heart_rate": _schema("ts:ts bpm:num source:text"),
    "resting_hr": _schema("ts:ts bpm:num"),
    "hrv": _schema("ts:ts value:num"),
    "walking_hr": _schema("ts:ts bpm:num"),
    "steps": _schema("ts:ts count:num"),
    "distance": _schema("ts:ts meters:num"),
    "energy": _schema("ts:ts active_kcal:num basal_kcal:num"),
    "sleep": _schema("start_ts:ts end_ts:ts state:text raw_state:text"),
    "performance": _schema("ts:ts vo2max:num speed:num power:num vertical_oscillation_cm:num ground_contact_time_ms:num stride_length_m:num"),
    "workout_stats": _schema("workout_id:text type:text start_ts:ts end_ts:ts average:num minimum:num maximum:num sum:num unit:text"),
    "workout_events": _schema("workout_id:text type:text ts:ts duration_sec:num"),
    "workout_metadata": _schema("workout_id:text key:text value:text"),
    "workout_routes": _schema("workout_id:text start_ts:ts end_ts:ts source:text path:text"),
}
STATE_TABLES = {
    "_migrations": T.StructType([T.StructField("id", T.StringType(), False), T.StructField("applied_at", T.TimestampNTZType())]),
    "_ingest_state": T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType())]),
    "_ingest_seen": T.StructType(
        [T.StructField("dedup_key", T.StringType(), False)] + [T.StructField(c, t) for c, t in (("record_type", T.StringType()), ("start_ts", T.TimestampNTZType()), ("end_ts", T.TimestampNTZType()), ("source", T.StringType()))]
    ),
}

# Sleep states of the export, their state and their stage.
SLEEP_STATES = {
    "Asleep": ("asleep", None),
    "InBed": ("in_bed", None),
    "Awake": ("awake", None),
    "HKCategoryValueSleepAnalysisInBed": ("in_bed", None),
    "HKCategoryValueSleepAnalysisAsleep": ("asleep", None),
    "HKCategoryValueSleepAnalysisAsleepUnspecified": ("asleep", "unspecified"),
    "HKCategoryValueSleepAnalysisAsleepCore": ("asleep", "core"),
    "HKCategoryValueSleepAnalysisAsleepDeep": ("asleep", "deep"),
    "HKCategoryValueSleepAnalysisAsleepREM": ("asleep", "rem"),
    "HKCategoryValueSleepAnalysisAwake": ("awake", None),
}
