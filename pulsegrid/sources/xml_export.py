"""The health export: one scan for records, one for workouts, and a row set for each table.

Each row set has the table's columns beside ``dedup_key``, ``record_type``, ``end_ts_key`` (the row's own end) and ``place``,
which rises with the position in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.schemas import TABLES
from pulsegrid.sources import files
from pulsegrid.sources import mappers as M

QUANTITY, CATEGORY = "HKQuantityTypeIdentifier", "HKCategoryTypeIdentifier"
ENTRY = "array<struct<_key:string,_value:string>>"
RECORD = f"_type string, _sourceName string, _unit string, _startDate string, _endDate string, _value string, MetadataEntry {ENTRY}"
WORKOUT = (
    f"_workoutActivityType string, _duration string, _durationUnit string, _sourceName string, _startDate string, _endDate string, MetadataEntry {ENTRY}, "
    "WorkoutStatistics array<struct<_type:string,_startDate:string,_endDate:string,_average:string,_minimum:string,_maximum:string,_sum:string,_unit:string>>, "
    "WorkoutEvent array<struct<_type:string,_date:string,_duration:string,_durationUnit:string>>, "
    "WorkoutRoute array<struct<_sourceName:string,_startDate:string,_endDate:string,FileReference:struct<_path:string>>>"
)
# Record types and the tables and columns that they fill.
TYPES = {
    "HeartRate": ("heart_rate", "bpm"),
    "RestingHeartRate": ("resting_hr", "bpm"),
    "HeartRateVariabilitySDNN": ("hrv", "value"),
    "WalkingHeartRateAverage": ("walking_hr", "bpm"),
    "StepCount": ("steps", "count"),
    "DistanceWalkingRunning": ("distance", "meters"),
    "ActiveEnergyBurned": ("energy", "active_kcal"),
    "BasalEnergyBurned": ("energy", "basal_kcal"),
    "VO2Max": ("performance", "vo2max"),
    "RunningSpeed": ("performance", "speed"),
    "RunningPower": ("performance", "power"),
    "RunningVerticalOscillation": ("performance", "vertical_oscillation_cm"),
    "RunningGroundContactTime": ("performance", "ground_contact_time_ms"),
    "RunningStrideLength": ("performance", "stride_length_m"),
}


def _manual() -> Column:
    return F.coalesce(F.exists("MetadataEntry", lambda m: (m["_key"] == "HKWasUserEntered") & (m["_value"] == "1")), F.lit(False))


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("inferSchema", "false").option("mode", "FAILFAST").schema(schema).load(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """Supported records that were not typed in by hand."""
    return cleaned(_read(spark, path, "Record", RECORD))


def cleaned(raw: DataFrame) -> DataFrame:
    known = [QUANTITY + t for t in TYPES] + [CATEGORY + "SleepAnalysis"]
    return raw.filter(F.col("_type").isin(known) & ~_manual()).select(
        F.col("_type").alias("type"),
        F.col("_sourceName").alias("source"),
        F.col("_unit").alias("unit"),
        F.col("_value").alias("raw_value"),
        M.moment(F.col("_startDate")).alias("start_ts"),
        M.moment(F.col("_endDate")).alias("end_ts"),
        (F.lit(0).cast("long") if raw.isStreaming else F.monotonically_increasing_id()).alias("place"),
    )


def workouts(spark: SparkSession, path: str) -> DataFrame:
    """Workouts with a proper type and not typed in by hand, with their children as arrays."""
    return cleaned_workouts(_read(spark, path, "Workout", WORKOUT))


def cleaned_workouts(raw: DataFrame) -> DataFrame:
    kind = F.col("_workoutActivityType")
    found = raw.filter(kind.startswith(M.WORKOUT_PREFIX) & (F.length(kind) > len(M.WORKOUT_PREFIX)) & ~_manual()).select(
        kind.alias("type"),
        F.col("_sourceName").alias("source"),
        "_duration",
        "_durationUnit",
        M.moment(F.col("_startDate")).alias("start_ts"),
        M.moment(F.col("_endDate")).alias("end_ts"),
        (F.lit(0).cast("long") if raw.isStreaming else F.monotonically_increasing_id()).alias("place"),
        "MetadataEntry",
        "WorkoutStatistics",
        "WorkoutEvent",
        "WorkoutRoute",
    )
    return found.withColumn("id", M.workout_id(F.col("type"), F.col("start_ts"), F.col("end_ts")))


def _value(column: str, value: Column, unit: Column) -> Column:
    rules = {
        "meters": M.meters(value, unit),
        "active_kcal": M.kcal(value, unit),
        "basal_kcal": M.kcal(value, unit),
        "speed": M.meters_per_second(value, unit),
        "vertical_oscillation_cm": M.length(value, unit) * 100.0,
        "ground_contact_time_ms": M.contact_ms(value, unit),
        "stride_length_m": M.length(value, unit),
    }
    return rules.get(column, value)


def _keyed(df: DataFrame, table: str, kind: Column, start: Column, end: Column, token: Column, source: Column) -> DataFrame:
    """The table's columns with what deduplication and the watermark need."""
    names = [f.name for f in TABLES[table]]
    return df.select(
        *[F.col(f"o.{n}").cast(TABLES[table][n].dataType).alias(n) for n in names],
        M.dedup_key(kind, start, end, token, source).alias("dedup_key"),
        kind.alias("record_type"),
        end.alias("end_ts_key"),
        "place",
    )


def _struct(table: str, **columns: Column) -> Column:
    return F.struct(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table]]).alias("o")


def record_rows(found: DataFrame) -> dict[str, DataFrame]:
    """Row sets of the record tables; rows without a usable value are dropped."""
    start, end, source, unit = F.col("start_ts"), F.col("end_ts"), F.col("source"), F.col("unit")
    out: dict[str, DataFrame] = {}
    for suffix, (table, column) in TYPES.items():
        rows = found.filter(F.col("type") == QUANTITY + suffix).withColumn("v", _value(column, M.number(F.col("raw_value")), unit)).filter("v is not null")
        rows = rows.withColumn("o", _struct(table, ts=start, source=source, **{column: F.col("v")}))
        rows = _keyed(rows, table, F.col("type"), start, end, F.col("raw_value"), source)
        out[table] = out[table].unionByName(rows) if table in out else rows
    naps = found.filter(F.col("type") == CATEGORY + "SleepAnalysis").withColumn("state", M.sleep_state(F.col("raw_value"))).filter("state is not null")
    naps = naps.withColumn("o", _struct("sleep", start_ts=start, end_ts=end, state=F.col("state"), raw_state=F.col("raw_value")))
    out["sleep"] = _keyed(naps, "sleep", F.col("type"), start, end, F.col("raw_value"), source)
    return out


def workout_rows(found: DataFrame) -> dict[str, DataFrame]:
    """Row sets of workouts and of their children, which are judged by their own times."""
    start, end, source = F.col("start_ts"), F.col("end_ts"), F.col("source")
    stated = M.seconds(M.prefix_number(F.col("_duration")), F.col("_durationUnit"))
    elapsed = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)
    seconds = F.greatest(F.lit(0.0), F.coalesce(stated, elapsed))
    main = found.withColumn("seconds", seconds).withColumn("o", _struct("workouts", id=F.col("id"), type=M.workout_type(F.col("type")), start_ts=start, end_ts=end, duration_sec=F.col("seconds"), source=source))
    out = {"workouts": _keyed(main, "workouts", F.col("type"), start, end, F.col("seconds"), source)}

    stats = found.select("id", "place", "source", F.explode("WorkoutStatistics").alias("s")).filter("s._type is not null")
    stats = stats.withColumn("a", M.moment(F.col("s._startDate"))).withColumn("b", M.moment(F.col("s._endDate")))
    numbers = {n: M.number(F.col(f"s._{n}")) for n in ("average", "minimum", "maximum", "sum")}
    stats = stats.withColumn("o", _struct("workout_stats", workout_id=F.col("id"), type=F.col("s._type"), start_ts=F.col("a"), end_ts=F.col("b"), unit=F.col("s._unit"), **numbers))
    token = F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in (*numbers.values(), F.col("s._unit"))])
    out["workout_stats"] = _keyed(stats, "workout_stats", F.col("s._type"), F.col("a"), F.col("b"), token, F.col("source"))

    events = found.select("id", "place", "source", F.explode("WorkoutEvent").alias("e")).filter("e._type is not null and e._date is not null").withColumn("a", M.moment(F.col("e._date")))
    length = M.seconds(M.number(F.col("e._duration")), F.col("e._durationUnit"))
    events = events.withColumn("o", _struct("workout_events", workout_id=F.col("id"), type=F.col("e._type"), ts=F.col("a"), duration_sec=length))
    out["workout_events"] = _keyed(events, "workout_events", F.col("e._type"), F.col("a"), F.col("a"), length, F.col("source"))

    meta = found.select("id", "place", "source", "start_ts", "end_ts", F.explode("MetadataEntry").alias("m")).filter("m._key is not null")
    meta = meta.withColumn("o", _struct("workout_metadata", workout_id=F.col("id"), key=F.col("m._key"), value=F.col("m._value")))
    token = F.concat_ws(",", "id", F.col("m._key"), F.coalesce(F.col("m._value"), F.lit("")))
    out["workout_metadata"] = _keyed(meta, "workout_metadata", F.lit("metadata"), start, end, token, F.col("source"))

    ways = found.select("id", "place", F.explode("WorkoutRoute").alias("r")).withColumn("a", M.moment(F.col("r._startDate"))).withColumn("b", M.moment(F.col("r._endDate")))
    ways = ways.withColumn("o", _struct("workout_routes", workout_id=F.col("id"), start_ts=F.col("a"), end_ts=F.col("b"), source=F.col("r._sourceName"), path=F.col("r.FileReference._path")))
    token = F.concat_ws(",", "id", F.coalesce(F.col("r.FileReference._path"), F.lit("")))
    out["workout_routes"] = _keyed(ways, "workout_routes", F.lit("route"), F.col("a"), F.col("b"), token, F.col("r._sourceName"))
    return out


def all_rows(spark: SparkSession, path: str, staged=lambda name, df: df) -> dict[str, DataFrame]:
    """Row sets of all tables; ``staged(name, df)`` may keep the parsed nodes, which every row set reads."""
    return record_rows(staged("records", records(spark, path))) | workout_rows(staged("workouts", workouts(spark, path)))


#: Attributes and children that a cropped export keeps beside those that are read.
KEPT_RECORD = RECORD + ", _sourceVersion string, _device string, _creationDate string, HeartRateVariabilityMetadataList struct<InstantaneousBeatsPerMinute:array<struct<_bpm:string,_time:string>>>"
KEPT_WORKOUT = WORKOUT + ", _sourceVersion string, _device string, _creationDate string, _totalDistance string, _totalDistanceUnit string, _totalEnergyBurned string, _totalEnergyBurnedUnit string"
LOCALE = "en_GB"


def _fates(rows: DataFrame, supported: Column, manual: Column, cutoff) -> DataFrame:
    """``fate`` of each node: kept, old, unsupported or manual."""
    dated = F.col("_endDate").isNotNull()
    fate = F.when(~F.coalesce(supported & dated, F.lit(False)), "unsupported").when(manual, "manual")
    if cutoff is None:
        return rows.withColumn("fate", F.coalesce(fate, F.lit("kept")))
    late = F.when(fate.isNull(), M.moment(F.col("_endDate")) >= F.lit(cutoff).cast("timestamp_ntz"))
    return rows.withColumn("fate", F.coalesce(fate, F.when(late, "kept").otherwise("old")))


def _nodes(spark: SparkSession, path: str, cutoff) -> dict[str, DataFrame]:
    known = [QUANTITY + t for t in TYPES] + [CATEGORY + "SleepAnalysis"]
    kind = F.col("_workoutActivityType")
    named = kind.startswith(M.WORKOUT_PREFIX) & (F.length(kind) > len(M.WORKOUT_PREFIX))
    return {
        "Record": _fates(_read(spark, path, "Record", KEPT_RECORD), F.col("_type").isin(known), _manual(), cutoff),
        "Workout": _fates(_read(spark, path, "Workout", KEPT_WORKOUT), named, F.lit(False), cutoff),
    }


def crop(spark: SparkSession, path: str, cutoff, out: str) -> dict[str, int]:
    """Write one export of the supported nodes that end at the cutoff or later (all for None), and count what was seen, kept and left out.

    The export's locale, date and person stay. Its lines are rows ordered by section and place, written in parts by all tasks: a header, what stood
    before the nodes, the records, the workouts, the end of the root. The parts in a row are the document; they become one file, ``out``.
    A node that never ends raises.
    """
    nodes = _nodes(spark, path, cutoff)
    fates = ("kept", "old", "unsupported", "manual")
    total = dict.fromkeys(("seen", *fates), 0)
    seen = {}
    for tag, rows in nodes.items():
        counts = rows.agg(*[F.count_if(F.col("fate") == f).alias(f) for f in fates]).first()
        seen[tag] = sum(counts)
        for f in fates:
            total[f] += counts[f]
        total["seen"] += seen[tag]
    source = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("place"))
    opened = lambda tag: F.sum(F.size(F.split("value", f"<{tag}[ >]")) - 1).alias(tag)
    found = source.agg(opened("Record"), opened("Workout"), F.min(F.when(F.col("value").contains("<HealthData"), F.regexp_extract("value", r'\blocale="([^"]+)"', 1))).alias("locale")).first()
    for tag in nodes:
        if (found[tag] or 0) > seen[tag]:
            raise ValueError(f"a {tag} of {path} never ends")
    line = lambda section, text: spark.range(1).select(F.lit(section).alias("section"), F.lit(0).cast("long").alias("place"), F.lit(text).alias("value"))
    before = source.filter(F.ltrim("value").rlike("^<(ExportDate|Me) ")).select(F.lit(1).alias("section"), "place", "value")
    lines = line(0, f'<?xml version="1.0" encoding="UTF-8"?>\n<HealthData locale="{found["locale"] or LOCALE}">').unionByName(before)
    for section, (tag, rows) in enumerate(nodes.items(), 2):
        kept = rows.withColumn("place", F.monotonically_increasing_id()).filter("fate = 'kept'")
        text = F.to_xml(F.struct(*[c for c in kept.columns if c not in ("fate", "place")]), {"rowTag": tag})
        lines = lines.unionByName(kept.select(F.lit(section).alias("section"), "place", text.alias("value")))
    parts = f"{out}__parts"
    lines.unionByName(line(9, "</HealthData>")).orderBy("section", "place").select("value").write.mode("overwrite").text(parts)
    files.joined(spark, parts, out)
    files.delete(spark, parts)
    return total
