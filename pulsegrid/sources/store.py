"""The health store: Parquet folders, keys seen so far, versioned state and a ledger of schema steps.

An import appends only rows whose key is new. Rows go in before their keys, so a failed import repeats at
worst the rows of its last table, which the next import finds by the keys of the table itself. Keys lie in folders by table, record type
and month of their end, which is part of a key, so an import reads only the months that it meets, and writers of different tables do not meet.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.plans.synth import Tables
from pulsegrid.schemas import STATE_TABLES, TABLES
from pulsegrid.sources import files, migrations, xml_export
from pulsegrid.sources.state import State

LOOKBACK = dt.timedelta(hours=24)


def first_wins(rows: DataFrame) -> DataFrame:
    """The first row of each key, by place."""
    order = Window.partitionBy("dedup_key").orderBy("place")
    return rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def unseen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    return rows.join(seen.select("dedup_key"), "dedup_key", "left_anti")


def not_older(rows: DataFrame, cutoff: dt.datetime | None) -> DataFrame:
    return rows if cutoff is None else rows.filter(F.col("end_ts_key") >= F.lit(cutoff).cast("timestamp_ntz"))


def _month(end: str) -> Column:
    return F.coalesce(F.date_format(end, "yyyy-MM"), F.lit("none"))


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.state_files = State(spark, f"{self.path}/_ingest_state")
        self.migrated = migrations.migrate(self)

    def read(self, name: str) -> DataFrame:
        if name == "_ingest_seen":
            return self.seen()
        return self.spark.read.schema((TABLES | STATE_TABLES)[name]).parquet(f"{self.path}/{name}")

    def tables(self) -> Tables:
        return Tables.from_store(self.spark, self.path)

    def state(self, key: str) -> str | None:
        return self.state_files.get(key)

    def set_state(self, key: str, value: str | None) -> None:
        self.state_files.set(key, value)

    @staticmethod
    def by_month(keys: DataFrame, end: str) -> DataFrame:
        return keys.withColumn("month", _month(end))

    def seen(self, table: str | None = None, met: DataFrame | None = None) -> DataFrame:
        """Keys seen so far, of one table or all; with ``met`` (record_type, end_ts_key) only the folders that its rows meet."""
        path = f"{self.path}/_ingest_seen"
        schema = T.StructType([*STATE_TABLES["_ingest_seen"], T.StructField("table", T.StringType()), T.StructField("month", T.StringType())])
        if not any(n.startswith("table=") for n in files.names(self.spark, path)):
            return self.spark.createDataFrame([], schema)
        keys = self.spark.read.schema(schema).option("basePath", path).parquet(path)
        if table is not None:
            keys = keys.filter(F.col("table").isin(table, migrations.OLD))
        if met is None:
            return keys
        # a row for each record type and month of the import
        folders = [tuple(r) for r in met.select("record_type", _month("end_ts_key").alias("month")).distinct().collect()]
        by_type: dict[str, list[str]] = {}
        for kind, month in folders:
            by_type.setdefault(kind, []).append(month)
        inside = [(F.col("record_type") == kind) & F.col("month").isin(months) for kind, months in sorted(by_type.items())]
        return keys.filter(reduce(lambda a, b: a | b, inside, F.lit(False)))

    def last_import(self) -> dt.datetime | None:
        text = self.state("last_import_ts")
        try:
            return dt.datetime.fromisoformat(text) if text else None
        except ValueError:
            return None

    def staged(self, name: str, found: DataFrame) -> DataFrame:
        """Parsed nodes written once, in a folder for each type, so that a table reads only its own; the next import replaces them."""
        path = f"{self.path}/_staged/{name}"
        found.write.mode("overwrite").partitionBy("type").parquet(path)
        return self.spark.read.schema(found.schema).parquet(path)

    def append(self, rows: dict[str, DataFrame]) -> dict[str, int]:
        """New rows of each table; returns how many went in."""
        counts = {}
        for name, found in rows.items():
            new = first_wins(unseen(found, self.seen(name, found)))
            if name == "workouts":  # the id is a second key
                new = new.join(self.read("workouts").select("id"), "id", "left_anti")
                new = new.withColumn("_rank", F.row_number().over(Window.partitionBy("id").orderBy("place"))).filter("_rank = 1").drop("_rank")
            new = new.persist()
            counts[name] = new.count()
            if counts[name]:
                new.select(*[f.name for f in TABLES[name]]).write.mode("append").parquet(f"{self.path}/{name}")
                keys = new.select("dedup_key", "record_type", F.lit(None).cast("timestamp_ntz").alias("start_ts"), F.col("end_ts_key").alias("end_ts"), F.lit(None).cast("string").alias("source"))
                keys = self.by_month(keys, "end_ts").repartition("record_type", "month")
                keys.write.mode("append").partitionBy("record_type", "month").parquet(f"{self.path}/_ingest_seen/table={name}")
            new.unpersist()
        return counts

    def ingest(self, export: str, full: bool = False) -> dict[str, int]:
        """Read an export; rows that end a day or more before the last import are left out unless ``full``."""
        last = None if full else self.last_import()
        cutoff = last - LOOKBACK if last else None
        rows = {name: not_older(found, cutoff) for name, found in xml_export.all_rows(self.spark, export, self.staged).items()}
        counts = self.append(rows)
        ends = reduce(lambda a, b: a.union(b), [found.select("end_ts_key") for found in rows.values()])
        newest = ends.agg(F.max("end_ts_key").alias("t")).first()["t"]
        marks = [x for x in (self.last_import(), newest) if x]
        if marks:
            self.set_state("last_import_ts", max(marks).isoformat())
        self.set_state("last_import_file", export)
        return counts

    def rebuild(self, export: str) -> dict[str, int]:
        """Empty all tables and read the export whole."""
        for name, schema in TABLES.items():
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/{name}")
        files.delete(self.spark, f"{self.path}/_ingest_seen")
        self.set_state("last_import_ts", None)
        return self.ingest(export, full=True)
