"""Streaming ingest of exports with bounded deduplication: records, and workouts with their children."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.sources import mappers as M
from pulsegrid.sources.xml_export import RECORD, WORKOUT, cleaned, cleaned_workouts, record_rows, workout_rows

LATENESS = "24 hours"


def _each_once(rows: DataFrame, time: str) -> DataFrame:
    """Rows in time, each key once within the lateness that its own event time allows."""
    timed = rows.withColumn("event_time", F.col(time).cast("timestamp"))
    return timed.withWatermark("event_time", LATENESS).dropDuplicatesWithinWatermark(["dedup_key"])


def record_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Records of exports that arrive in a folder, each once within a day of event time."""
    raw = spark.readStream.format("xml").option("rowTag", "Record").schema(RECORD).load(folder)
    rows = cleaned(raw)
    key = M.dedup_key(F.col("type"), F.col("start_ts"), F.col("end_ts"), F.col("raw_value"), F.col("source"))
    return _each_once(rows.withColumn("dedup_key", key), "end_ts")


def workout_streams(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Workouts of exports that arrive in a folder, and their statistics, events, metadata and routes, as streams by table.

    A child is judged by its own end: each stream has its own event time and watermark, so a late event of a workout is left out though
    the workout itself is in time, and a repeated child is left out though its workout came in another export.
    """
    raw = spark.readStream.format("xml").option("rowTag", "Workout").schema(WORKOUT).load(folder)
    return {name: _each_once(rows, "end_ts_key") for name, rows in workout_rows(cleaned_workouts(raw)).items()}


def daily_heart_rate(records: DataFrame) -> DataFrame:
    """Mean heart rate by tumbling day, complete once the watermark has passed it."""
    beats = records.filter(F.col("type") == "HKQuantityTypeIdentifierHeartRate").withColumn("bpm", M.number(F.col("raw_value")))
    return beats.groupBy(F.window("event_time", "1 day")).agg(F.avg("bpm").alias("avg_bpm"), F.count("bpm").alias("n")).select(F.to_date("window.start").alias("day"), "avg_bpm", "n")


def weekly_activity(in_time: DataFrame) -> DataFrame:
    """Workouts and their seconds by week from Monday, as a stream of rows that never change: a week comes out once the watermark has passed it.

    Windows begin at the epoch, a Thursday, so weeks are shifted by four days. A workout belongs to the week of its start,
    by ``workouts_in_time``.
    """
    weeks = in_time.groupBy(F.window("event_time", "1 week", "1 week", "4 days"))
    totals = weeks.agg(F.count("*").alias("workout_count"), F.coalesce(F.sum("duration_sec"), F.lit(0.0)).alias("total_duration_sec"))
    return totals.select(F.to_date("window.start").alias("week"), "workout_count", "total_duration_sec")


def workouts_in_time(spark: SparkSession, folder: str) -> DataFrame:
    """Workouts of exports that arrive in a folder, for windows over their start; equal workouts count once."""
    raw = spark.readStream.format("xml").option("rowTag", "Workout").schema(WORKOUT).load(folder)
    return _each_once(workout_rows(cleaned_workouts(raw))["workouts"], "start_ts")


def into_store(records: DataFrame, store, checkpoint: str) -> StreamingQuery:
    """Append each batch to a store exactly once: the store leaves out keys that it has."""

    def batch(df: DataFrame, _: int) -> None:
        store.append(record_rows(df.drop("dedup_key", "event_time")))

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def workouts_into_store(streams: dict[str, DataFrame], store, checkpoint: str) -> list[StreamingQuery]:
    """One query for each table, so that every kind of row keeps its own watermark; batches of one that fail do not hold up the others."""

    def start(name: str, rows: DataFrame) -> StreamingQuery:
        def batch(df: DataFrame, _: int) -> None:
            store.append({name: df.drop("event_time")})

        return rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()

    return [start(name, rows) for name, rows in streams.items()]
