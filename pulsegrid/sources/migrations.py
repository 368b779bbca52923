"""Steps that bring a store of an older schema up to date, each once and recorded in the store's ledger.

A table is rewritten beside itself and then changes names with the old one, so an interrupted step can be run again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.schemas import STATE_TABLES, TABLES
from pulsegrid.sources import files

#: Stands for the table of keys that an older store kept without it.
OLD = "any"


def _stored(store, name: str) -> DataFrame:
    return store.spark.read.option("mergeSchema", "true").parquet(f"{store.path}/{name}")


def _has_data(store, name: str) -> bool:
    path = f"{store.path}/{name}"
    return files.exists(store.spark, path) and any(n.endswith(".parquet") or "=" in n for n in files.names(store.spark, path))


def replaced(store, name: str, new: DataFrame, *partitions: str) -> None:
    """Write ``new`` in place of a table that it may read."""
    here, fresh, old = (f"{store.path}/{x}" for x in (name, f"{name}__new", f"{name}__old"))
    files.delete(store.spark, fresh)
    new.write.partitionBy(*partitions).parquet(fresh)
    files.delete(store.spark, old)
    files.rename(store.spark, here, old)
    files.rename(store.spark, fresh, here)
    files.delete(store.spark, old)


def _restored(store, name: str) -> None:
    """Undo a change of names that was interrupted half way."""
    here, old = f"{store.path}/{name}", f"{store.path}/{name}__old"
    if files.exists(store.spark, old) and not files.exists(store.spark, here):
        files.rename(store.spark, old, here)


def create_tables(store) -> None:
    """Every table that is missing, empty."""
    for name, schema in TABLES.items():
        _restored(store, name)
        if not _has_data(store, name):
            store.spark.createDataFrame([], schema).write.mode("append").parquet(f"{store.path}/{name}")


def conform(*tables: str) -> Callable:
    """A step that gives tables the columns they lack, null in old rows."""

    def step(store) -> None:
        for name in tables:
            _restored(store, name)
            old, schema = _stored(store, name), TABLES[name]
            if set(old.columns) >= set(schema.names):
                continue
            replaced(store, name, old.select(*[(F.col(f.name) if f.name in old.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]))

    return step


def seen_by_month(store) -> None:
    """Keys seen so far in folders by table, record type and month of their end."""
    name = "_ingest_seen"
    _restored(store, name)
    path = f"{store.path}/{name}"
    if any(n.startswith("table=") for n in files.names(store.spark, path)):
        return
    old = store.spark.read.schema(STATE_TABLES[name]).parquet(path) if _has_data(store, name) else store.spark.createDataFrame([], STATE_TABLES[name])
    if files.exists(store.spark, path):
        keys = store.by_month(old, "end_ts").withColumn("table", F.lit(OLD))
        replaced(store, name, keys.repartition("record_type", "month"), "table", "record_type", "month")


def versioned_state(store) -> None:
    """State rows of older stores, ``n value`` by key, as the first version of the state."""
    name = "_ingest_state"
    if not _has_data(store, name):
        return
    rows = store.spark.read.schema(STATE_TABLES[name]).parquet(f"{store.path}/{name}").groupBy("key").agg(F.max("value").alias("v")).collect()  # a few keys
    found = {r["key"]: r["v"].split(" ", 1)[1] for r in rows if r["v"] and r["v"].split(" ", 1)[1]}
    store.state_files.update(lambda now: found | now)
    for n in files.names(store.spark, f"{store.path}/{name}"):
        if n.endswith(".parquet") or n == "_SUCCESS":
            files.delete(store.spark, f"{store.path}/{name}/{n}")


STEPS: list[tuple[str, Callable]] = [
    ("001_tables", create_tables),
    ("002_sleep_raw_state", conform("sleep")),
    ("003_performance_and_workout_columns", conform("performance", "workouts", "workout_stats", "workout_events", "workout_metadata", "workout_routes")),
    ("004_seen_by_month", seen_by_month),
    ("005_versioned_state", versioned_state),
]


def applied(store) -> list[str]:
    path = f"{store.path}/_migrations"
    if not _has_data(store, "_migrations"):
        return []
    return sorted(r["id"] for r in store.spark.read.schema(STATE_TABLES["_migrations"]).parquet(path).select("id").distinct().collect())  # one row for each step


def migrate(store) -> list[str]:
    """Run the steps that the ledger lacks, in order; returns their names."""
    done, new = set(applied(store)), []
    for name, step in STEPS:
        if name not in done:
            step(store)
            now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
            store.spark.createDataFrame([(name, now)], STATE_TABLES["_migrations"]).coalesce(1).write.mode("append").parquet(f"{store.path}/_migrations")
            new.append(name)
    return new
