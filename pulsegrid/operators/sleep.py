"""Sleep: segments, nights and summaries. A night is named after its evening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import epoch, night, ratio, seconds_crossed, within
from pulsegrid.schemas import SLEEP_STATES

STAGES = {raw: stage for raw, (_, stage) in SLEEP_STATES.items() if stage}


def _hours():
    return seconds_crossed("start_ts", "end_ts") / F.lit(3600.0)


def segments(t, r=None) -> DataFrame:
    stage = F.lit(None).cast("string")
    for raw, name in STAGES.items():
        stage = F.when(F.col("raw_state") == raw, name).otherwise(stage)
    return (
        t.sleep.filter(within("start_ts", r))
        .select(night("start_ts").alias("night"), "start_ts", "end_ts", "state", "raw_state", stage.alias("stage"), _hours().alias("duration_hours"))
        .orderBy("start_ts", "end_ts")
    )


def _sums(df: DataFrame) -> DataFrame:
    of = lambda state: F.sum(F.when(F.col("state") == state, _hours()).otherwise(0.0)).alias(f"{state}_hours")
    return df.groupBy(night("start_ts").alias("day")).agg(
        F.min("start_ts").alias("bedtime"),
        F.max("end_ts").alias("wake_time"),
        of("asleep"),
        of("in_bed"),
        of("awake"),
        F.count_if(F.col("state") == "asleep").alias("asleep_rows"),
        F.count_if(F.col("state") == "in_bed").alias("in_bed_rows"),
        F.count_if(F.col("raw_state").isin(list(STAGES))).alias("stage_rows"),
        *[F.sum(F.when(F.col("raw_state") == raw, _hours()).otherwise(0.0)).alias(f"{stage}_value") for raw, stage in STAGES.items()],
    )


def nights(t, r=None) -> DataFrame:
    """All nights with times, hours by state and hours by stage; stages are null without any staged row."""
    return _sums(t.sleep.filter(within("start_ts", r))).select(
        "day",
        "bedtime",
        "wake_time",
        "asleep_hours",
        "in_bed_hours",
        "awake_hours",
        ratio(F.col("asleep_hours"), F.col("in_bed_hours")).alias("efficiency"),
        *[F.when(F.col("stage_rows") > 0, F.col(f"{s}_value")).alias(f"{s}_hours") for s in ("core", "deep", "rem", "unspecified")],
    ).orderBy("day")


def nightly(t, r=None) -> DataFrame:
    """Nights with sleep: hours asleep, hours in bed, efficiency."""
    rows = _sums(t.sleep.filter(within("start_ts", r))).filter("asleep_rows > 0")
    in_bed = F.when(F.col("in_bed_rows") > 0, F.col("in_bed_hours"))
    return rows.select("day", "asleep_hours", in_bed.alias("in_bed_hours"), ratio(F.col("asleep_hours"), in_bed).alias("efficiency")).orderBy("day")


def summary(t, r=None) -> DataFrame:
    """Hours asleep, spread of the time of falling asleep and efficiency, in one row."""
    by_night = (
        t.sleep.filter(within("start_ts", r))
        .groupBy(night("start_ts").alias("day"))
        .agg(
            F.min(F.when(F.col("state") == "asleep", F.col("start_ts"))).alias("first_asleep"),
            F.sum(F.when(F.col("state") == "asleep", seconds_crossed("start_ts", "end_ts"))).alias("asleep"),
            F.sum(F.when(F.col("state") == "in_bed", seconds_crossed("start_ts", "end_ts"))).alias("in_bed"),
        )
    )
    sums = by_night.agg(F.sum("asleep").alias("asleep"), F.sum("in_bed").alias("in_bed"), F.stddev_samp(epoch("first_asleep") % 86400).alias("consistency_stddev"))
    return sums.select(
        F.coalesce(F.col("asleep") / F.lit(3600.0), F.lit(0.0)).alias("total_hours"),
        "consistency_stddev",
        ratio(F.col("asleep").cast("double"), F.col("in_bed").cast("double")).alias("efficiency"),
    )
