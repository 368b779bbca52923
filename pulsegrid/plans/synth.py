"""Health tables derived from the star schema, by SQL that Spark and an oracle engine both run."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.schemas import TABLES

#: Workouts of 5 minutes to 2 hours, and one in fifty of 5 hours.
SECONDS = "(CASE WHEN event_id % 50 = 3 THEN 18000 ELSE 300 + event_id % 10 * 733 END)"
#: One SELECT for each table, over events, orders and lineitem.
VIEWS = {
    "workouts": f"""SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 3 = 0 THEN 'Walking' ELSE 'Running' END AS type,
        ts AS start_ts, ts + {SECONDS} * INTERVAL 1 SECOND AS end_ts, CAST({SECONDS} AS DOUBLE) AS duration_sec, event_type AS source
        FROM events WHERE event_type = 'signup'""",
    "heart_rate": """SELECT ts, CAST(90 + event_id % 80 AS DOUBLE) + CASE WHEN event_id % 7 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS bpm,
        event_type AS source FROM events WHERE event_type IN ('view', 'click')""",
    "resting_hr": "SELECT ts, CAST(48 + event_id % 15 AS DOUBLE) AS bpm FROM events WHERE event_type = 'purchase'",
    "hrv": "SELECT ts, CAST(30 + event_id % 60 AS DOUBLE) AS value FROM events WHERE event_type = 'error'",
    "walking_hr": "SELECT ts, CAST(85 + event_id % 25 AS DOUBLE) AS bpm FROM events WHERE event_type = 'view' AND event_id % 4 = 0",
    "steps": "SELECT ts, CAST(100 + event_id % 900 AS DOUBLE) AS count FROM events WHERE event_type = 'click'",
    "distance": "SELECT CAST(l_shipdate AS {ntz}) AS ts, CAST(l_extendedprice AS DOUBLE) AS meters FROM lineitem",
    "energy": """SELECT CAST(o_orderdate AS {ntz}) AS ts, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS DOUBLE) END AS active_kcal,
        CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_totalprice AS DOUBLE) END AS basal_kcal FROM orders""",
    "sleep": """SELECT ts AS start_ts, ts + INTERVAL 47 MINUTE + (event_id % 5400) * INTERVAL 1 SECOND + INTERVAL 700 MILLISECOND AS end_ts,
        CASE event_id % 3 WHEN 0 THEN 'asleep' WHEN 1 THEN 'in_bed' ELSE 'awake' END AS state,
        CASE event_id % 7 WHEN 0 THEN 'HKCategoryValueSleepAnalysisAsleepCore' WHEN 1 THEN 'HKCategoryValueSleepAnalysisAsleepDeep'
        WHEN 2 THEN 'HKCategoryValueSleepAnalysisAsleepREM' WHEN 3 THEN 'HKCategoryValueSleepAnalysisAsleepUnspecified' END AS raw_state
        FROM events WHERE event_type = 'error'""",
    "performance": """SELECT ts, CASE WHEN event_id % 6 = 0 THEN CAST(40 + event_id % 15 AS DOUBLE) END AS vo2max,
        CASE WHEN event_id % 6 IN (1, 2) THEN CAST(2 + (event_id % 30) / CAST(10 AS DOUBLE) AS DOUBLE) END AS speed,
        CASE WHEN event_id % 6 IN (3, 4) THEN CAST(180 + event_id % 90 AS DOUBLE) END AS power,
        CASE WHEN event_id % 6 = 5 THEN CAST(8 + event_id % 5 AS DOUBLE) END AS vertical_oscillation_cm,
        CASE WHEN event_id % 6 = 5 THEN CAST(280 + event_id % 50 AS DOUBLE) END AS ground_contact_time_ms,
        CASE WHEN event_id % 6 = 5 THEN CAST(0.8 + (event_id % 4) / CAST(10 AS DOUBLE) AS DOUBLE) END AS stride_length_m
        FROM events WHERE event_type IN ('purchase', 'error')""",
    "workout_stats": f"""SELECT CAST(event_id AS VARCHAR) AS workout_id, 'HKQuantityTypeIdentifierHeartRate' AS type, ts AS start_ts, ts + {SECONDS} * INTERVAL 1 SECOND AS end_ts,
        CAST(100 + event_id % 40 AS DOUBLE) AS average, CAST(80 AS DOUBLE) AS minimum, CAST(150 AS DOUBLE) AS maximum, CAST(NULL AS DOUBLE) AS sum,
        'count/min' AS unit FROM events WHERE event_type = 'signup' AND event_id % 2 = 1""",
    "workout_events": f"""SELECT CAST(event_id AS VARCHAR) AS workout_id, 'HKWorkoutEventTypePause' AS type, ts, CAST(NULL AS DOUBLE) AS duration_sec
        FROM events WHERE event_type = 'signup' AND event_id % 2 = 0
        UNION ALL SELECT CAST(event_id AS VARCHAR), 'HKWorkoutEventTypeSegment', ts + {SECONDS} * INTERVAL 1 SECOND, CAST(300 AS DOUBLE)
        FROM events WHERE event_type = 'signup' AND event_id % 3 = 0""",
    "workout_metadata": """SELECT CAST(event_id AS VARCHAR) AS workout_id, 'HKIndoorWorkout' AS key, CASE WHEN event_id % 4 = 0 THEN '1' ELSE '0' END AS value
        FROM events WHERE event_type = 'signup' AND event_id % 5 <> 0
        UNION ALL SELECT CAST(event_id AS VARCHAR), 'HKWeatherTemperature', '15 degC' FROM events WHERE event_type = 'signup' AND event_id % 7 = 0""",
    "workout_routes": f"""SELECT CAST(event_id AS VARCHAR) AS workout_id, ts AS start_ts, ts + {SECONDS} * INTERVAL 1 SECOND AS end_ts, event_type AS source,
        'route.gpx' AS path FROM events WHERE event_type = 'signup' AND event_id % 3 = 1""",
}


def spark_sql(name: str) -> str:
    return VIEWS[name].replace("AS VARCHAR", "AS STRING").replace("{ntz}", "TIMESTAMP_NTZ").replace("* INTERVAL 1 SECOND", "* INTERVAL '1' SECOND").replace("INTERVAL 700 MILLISECOND", "INTERVAL '0.7' SECOND")


def oracle_ctes(*names: str) -> str:
    """WITH clause of these tables for the oracle."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].replace('{ntz}', 'TIMESTAMP')})" for n in (names or VIEWS))


class Tables:
    """The health tables by name, as attributes."""

    def __init__(self, **frames: DataFrame):
        self.__dict__.update(frames)

    @classmethod
    def from_store(cls, spark: SparkSession, path: str) -> Tables:
        """Tables of a store folder, one Parquet folder each."""
        return cls(**{n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in TABLES.items()})

    @cached_property
    def running(self) -> DataFrame:
        return self.workouts.filter("type = 'Running'")


def derived(spark: SparkSession, sf_dir: str) -> Tables:
    """Health tables over the tables of a folder; nothing is read before a query needs it."""
    bases = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("events", "orders", "lineitem")}

    def view(name):
        text = spark_sql(name)
        for base in bases:
            text = text.replace(f"FROM {base}", f"FROM {{{base}}}")
        return spark.sql(text, **{b: f for b, f in bases.items() if f"{{{b}}}" in text})

    return Tables(**{n: view(n) for n in VIEWS})
