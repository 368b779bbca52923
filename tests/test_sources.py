"""Export files, the store and the stream."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from xml.etree import ElementTree

import pytest

from pulsegrid.operators import daily
from pulsegrid.schemas import STATE_TABLES, TABLES
from pulsegrid.sources import migrations, xml_export
from pulsegrid.sources.state import State
from pulsegrid.sources.store import Store
from pulsegrid.streaming import ingest as stream

HEAD = '<?xml version="1.0"?>\n<HealthData locale="en_GB">\n'
Q = "HKQuantityTypeIdentifier"


def record(kind, value, unit="count/min", start="2024-06-01 08:00:00 +0000", end="2024-06-01 08:00:00 +0000", inner=""):
    return f'<Record type="{kind}" sourceName="w" unit="{unit}" startDate="{start}" endDate="{end}" value="{value}">{inner}</Record>\n'


WORKOUT = """<Workout workoutActivityType="HKWorkoutActivityTypeRunning" duration="30" durationUnit="min" sourceName="w" startDate="2024-06-01 10:00:00 +0200" endDate="2024-06-01 10:30:00 +0200">
<MetadataEntry key="HKIndoorWorkout" value="0"/><WorkoutEvent type="HKWorkoutEventTypePause" date="2024-06-01 10:10:00 +0200"/>
<WorkoutStatistics type="HKQuantityTypeIdentifierHeartRate" startDate="2024-06-01 10:00:00 +0200" endDate="2024-06-01 10:30:00 +0200" average="120" unit="count/min"/>
<WorkoutRoute sourceName="w" startDate="2024-06-01 10:00:00 +0200" endDate="2024-06-01 10:30:00 +0200"><FileReference path="/r.gpx"/></WorkoutRoute></Workout>
"""


@pytest.fixture
def export(tmp_path):
    manual = '<MetadataEntry key="HKWasUserEntered" value="1"/>'
    body = [
        record(Q + "HeartRate", "100"),
        record(Q + "HeartRate", "100"),
        record(Q + "HeartRate", "abc"),
        record(Q + "HeartRate", "90", inner=manual),
        record(Q + "DietaryWater", "1"),
        record(Q + "DistanceWalkingRunning", "2", "km"),
        record(Q + "ActiveEnergyBurned", "418.4", "kJ"),
        record(Q + "RunningSpeed", "36", "km/hr"),
        record(Q + "RunningVerticalOscillation", "90", "mm"),
        record("HKCategoryTypeIdentifierSleepAnalysis", "HKCategoryValueSleepAnalysisAsleepCore"),
        "<Correlation>" + record(Q + "HeartRate", "101", start="2024-06-02 08:00:00 +0200", end="2024-06-02 08:00:00 +0200") + "</Correlation>",
        WORKOUT,
    ]
    path = tmp_path / "in" / "export.xml"
    path.parent.mkdir()
    path.write_text(HEAD + "".join(body) + "</HealthData>")
    return str(path)


def test_ingest_twice(spark, export, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    counts = store.ingest(export)
    assert counts == {
        **dict.fromkeys(("resting_hr", "hrv", "walking_hr", "steps"), 0),
        **{"heart_rate": 2, "distance": 1, "energy": 1, "performance": 2, "sleep": 1, "workouts": 1, "workout_stats": 1, "workout_events": 1, "workout_metadata": 1, "workout_routes": 1},
    }
    t = store.tables()
    assert t.distance.first().meters == 2000.0
    assert t.energy.first().active_kcal == pytest.approx(100.0)
    assert sorted((r.speed, r.vertical_oscillation_cm) for r in t.performance.collect() if r.speed) == [(10.0, None)]
    run = t.workouts.first()
    assert (run.type, run.start_ts, run.duration_sec) == ("Running", dt.datetime(2024, 6, 1, 8), 1800.0)
    assert t.workout_routes.first().path == "/r.gpx"
    assert store.last_import() == dt.datetime(2024, 6, 2, 6)
    assert sum(store.ingest(export).values()) == 0
    assert store.rebuild(export)["heart_rate"] == 2


def test_keys_of_children_use_mapped_values(spark, tmp_path):
    """One minute and 60 seconds are one event; stats that differ in unit only are two."""
    span = 'startDate="2024-06-01 10:00:00 +0200" endDate="2024-06-01 10:30:00 +0200"'
    pause = '<WorkoutEvent type="HKWorkoutEventTypePause" date="2024-06-01 10:10:00 +0200" duration="{}" durationUnit="{}"/>'
    stat = f'<WorkoutStatistics type="{Q}DistanceWalkingRunning" {span} sum="{{}}" unit="{{}}"/>'
    inner = pause.format("1", "min") + pause.format("60", "s") + pause.format("60", "min") + stat.format("5", "km") + stat.format("5.0", "km") + stat.format("5", "mi")
    path = tmp_path / "children.xml"
    path.write_text(HEAD + f'<Workout workoutActivityType="HKWorkoutActivityTypeRunning" sourceName="w" {span}>{inner}</Workout></HealthData>')
    store = Store(spark, str(tmp_path / "store3"))
    counts = store.ingest(str(path))
    assert (counts["workout_events"], counts["workout_stats"]) == (2, 2)
    assert sorted(r.duration_sec for r in store.read("workout_events").collect()) == [60.0, 3600.0]
    assert sorted((r.unit, r["sum"]) for r in store.read("workout_stats").collect()) == [("km", 5.0), ("mi", 5.0)]


def test_crop_counts(spark, export, tmp_path):
    counts = xml_export.crop(spark, export, dt.datetime(2024, 6, 2), str(tmp_path / "out.xml"))
    assert counts == {"seen": 12, "kept": 1, "old": 9, "unsupported": 1, "manual": 1}


def test_cropped_export_ingests_to_the_same_rows(spark, export, tmp_path):
    text = Path(export).read_text().replace("<HealthData locale=\"en_GB\">", '<HealthData locale="de_DE">\n <ExportDate value="2024-06-03 10:00:00 +0200"/>\n <Me HKCharacteristicTypeIdentifierBiologicalSex="x &amp; y"/>')
    source, out = tmp_path / "whole.xml", tmp_path / "cropped.xml"
    source.write_text(text)
    counts = xml_export.crop(spark, str(source), None, str(out))
    assert (counts["seen"], counts["kept"]) == (12, 10)
    root = ElementTree.parse(out).getroot()
    assert (root.tag, root.get("locale")) == ("HealthData", "de_DE")
    assert [c.tag for c in root] == ["ExportDate", "Me"] + ["Record"] * 9 + ["Workout"]
    assert root[1].get("HKCharacteristicTypeIdentifierBiologicalSex") == "x & y"
    rows = lambda path: {n: sorted(map(str, df.drop("place").distinct().collect())) for n, df in xml_export.all_rows(spark, str(path)).items()}
    assert rows(out) == rows(source)
    assert not (tmp_path / "cropped.xml__parts").exists()


def test_crop_of_an_unfinished_node_raises(spark, export, tmp_path):
    path = tmp_path / "cut.xml"
    path.write_text(Path(export).read_text().split("<WorkoutRoute")[0])
    with pytest.raises(Exception, match="never ends|XML|MALFORMED"):
        xml_export.crop(spark, str(path), None, str(tmp_path / "cut_out.xml"))


def test_bad_date_raises(spark, tmp_path):
    path = tmp_path / "bad.xml"
    path.write_text(HEAD + record(Q + "HeartRate", "1", start="yesterday") + "</HealthData>")
    with pytest.raises(Exception, match="not an export date"):
        xml_export.records(spark, str(path)).collect()


def test_stream_into_store(spark, export, tmp_path):
    store = Store(spark, str(tmp_path / "store2"))
    folder = export.rsplit("/", 1)[0]
    for _ in range(2):
        stream.into_store(stream.record_stream(spark, folder), store, str(tmp_path / "ck")).awaitTermination()
    assert store.read("heart_rate").count() == 2


def workout(day, hour, minutes, *events):
    start = dt.datetime.fromisoformat(f"2024-{day}") + dt.timedelta(hours=hour)
    text = lambda t: t.strftime("%Y-%m-%d %H:%M:%S +0000")
    inner = "".join(f'<WorkoutEvent type="{kind}" date="{text(dt.datetime.fromisoformat(when))}"/>' for kind, when in events)
    return f'<Workout workoutActivityType="HKWorkoutActivityTypeRunning" duration="{minutes}" durationUnit="min" sourceName="w" startDate="{text(start)}" endDate="{text(start + dt.timedelta(minutes=minutes))}">{inner}</Workout>\n'


def test_children_of_streamed_workouts_keep_their_own_time(spark, tmp_path):
    """In the second export the workout is in time; its repeated event and its event of three days before are left out."""
    folder, store = tmp_path / "arrivals", Store(spark, str(tmp_path / "store4"))
    folder.mkdir()

    def run():
        for q in stream.workouts_into_store(stream.workout_streams(spark, str(folder)), store, str(tmp_path / "ck4")):
            q.awaitTermination()

    (folder / "a.xml").write_text(HEAD + workout("06-10", 8, 60, ("Pause", "2024-06-10 08:10:00"), ("Pause", "2024-06-10 08:10:00")) + workout("06-10", 8, 60) + "</HealthData>")
    run()
    assert (store.read("workouts").count(), store.read("workout_events").count()) == (1, 1)
    late = ("Pause", "2024-06-07 08:00:00")
    (folder / "b.xml").write_text(HEAD + workout("06-10", 9, 30, ("Pause", "2024-06-10 08:10:00"), late, ("Resume", "2024-06-10 09:05:00")) + workout("06-01", 9, 30) + "</HealthData>")
    run()
    assert sorted(r.start_ts.hour for r in store.read("workouts").collect()) == [8, 9]  # the workout of 1 June is late itself
    assert sorted(r.type for r in store.read("workout_events").collect()) == ["Pause", "Resume"]


def test_streamed_weeks_equal_weekly_activity(spark, tmp_path):
    """Weeks begin on Monday and come out when the watermark has passed them."""
    folder, out, ck = tmp_path / "weeks", str(tmp_path / "weeks_out"), str(tmp_path / "ck5")
    folder.mkdir()
    body = workout("06-01", 8, 60) + workout("06-02", 23, 30) + workout("06-03", 0, 20) + workout("06-08", 8, 45) + workout("06-08", 8, 45) + workout("06-09", 23, 10)
    (folder / "a.xml").write_text(HEAD + body + "</HealthData>")

    def run():
        weeks = stream.weekly_activity(stream.workouts_in_time(spark, str(folder)))
        weeks.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()

    run()
    store = Store(spark, str(tmp_path / "store5"))
    store.ingest(str(folder / "a.xml"))
    want = [tuple(r) for r in daily.weekly_activity(store.tables()).collect()]
    (folder / "b.xml").write_text(HEAD + workout("06-20", 8, 60) + "</HealthData>")
    run()
    run()  # what the watermark has closed by now
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("week", "workout_count", "total_duration_sec").collect())
    assert got == want and [str(w[0]) for w in want] == ["2024-05-27", "2024-06-03"]


def test_daily_stream_closes_days(spark, tmp_path):
    folder, out = tmp_path / "days", str(tmp_path / "days_out")
    folder.mkdir()
    (folder / "a.xml").write_text(HEAD + record(Q + "HeartRate", "100") + record(Q + "HeartRate", "120", start="2024-06-01 09:00:00 +0000", end="2024-06-01 09:00:00 +0000") + record(Q + "HeartRate", "70", start="2024-06-05 09:00:00 +0000", end="2024-06-05 09:00:00 +0000") + "</HealthData>")
    for _ in range(2):
        days = stream.daily_heart_rate(stream.record_stream(spark, str(folder)))
        days.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "ck6")).trigger(availableNow=True).start().awaitTermination()
    assert [(str(r.day), r.avg_bpm, r.n) for r in spark.read.parquet(out).collect()] == [("2024-06-01", 110.0, 2)]


def test_seen_keys_are_read_by_month(spark, export, tmp_path):
    store = Store(spark, str(tmp_path / "store6"))
    store.ingest(export)
    rows = xml_export.all_rows(spark, export)["heart_rate"]
    june = store.seen("heart_rate", rows.filter("end_ts_key >= '2024-06-02'"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = june._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-06" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert june.select("record_type").distinct().count() == 1 < store.seen().select("record_type").distinct().count()
    assert store.seen("heart_rate", rows.filter("false")).count() == 0
    assert store.seen().filter("month <> '2024-06'").count() == 0


def test_of_two_writers_one_wins_and_none_is_lost(spark, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    version, values = state.latest()
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: state.swap(version, values | {"k": str(i)}), range(8)))
    assert won.count(True) == 1 and state.get("k") == str(won.index(True))
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: State(spark, str(tmp_path / "state")).set(f"key{i}", str(i)), range(12)))
    assert {k: v for k, v in state.latest()[1].items() if k != "k"} == {f"key{i}": str(i) for i in range(12)}
    state.set("key3", None)
    assert state.get("key3") is None and len(state.versions()) >= 13


def test_older_store_opens_and_is_recorded(spark, tmp_path):
    """Tables with fewer columns, keys in one folder and state as rows, as the first versions wrote them."""
    path = str(tmp_path / "old")
    night = (dt.datetime(2024, 6, 1), dt.datetime(2024, 6, 1, 8), "asleep")
    spark.createDataFrame([night], "start_ts timestamp_ntz, end_ts timestamp_ntz, state string").write.parquet(f"{path}/sleep")
    spark.createDataFrame([(dt.datetime(2024, 6, 1), 40.0)], "ts timestamp_ntz, vo2max double").write.parquet(f"{path}/performance")
    key = ("k1", "HKx", None, dt.datetime(2024, 6, 1), None)
    spark.createDataFrame([key, ("k2", "HKx", None, None, None)], STATE_TABLES["_ingest_seen"]).write.parquet(f"{path}/_ingest_seen")
    spark.createDataFrame([("last_import_ts", "000000000000 2024-05-01T00:00:00"), ("last_import_ts", "000000000001 2024-06-01T00:00:00")], STATE_TABLES["_ingest_state"]).write.parquet(f"{path}/_ingest_state")
    store = Store(spark, path)
    assert store.migrated == [name for name, _ in migrations.STEPS] == migrations.applied(store)
    assert store.last_import() == dt.datetime(2024, 6, 1)
    assert [tuple(r) for r in store.read("sleep").collect()] == [(*night, None)]
    assert spark.read.parquet(f"{path}/performance").columns == TABLES["performance"].names
    assert sorted((r.dedup_key, r.month) for r in store.seen().collect()) == [("k1", "2024-06"), ("k2", "none")]
    again = Store(spark, path)
    assert again.migrated == [] and spark.read.parquet(f"{path}/_migrations").count() == len(migrations.STEPS)


def test_interrupted_step_is_run_again(spark, tmp_path):
    path = str(tmp_path / "broken")
    spark.createDataFrame([(dt.datetime(2024, 6, 1), dt.datetime(2024, 6, 1, 8), "asleep")], "start_ts timestamp_ntz, end_ts timestamp_ntz, state string").write.parquet(f"{path}/sleep__old")
    spark.createDataFrame([], TABLES["sleep"]).write.parquet(f"{path}/sleep__new")
    store = Store(spark, path)
    assert store.read("sleep").count() == 1 and not (tmp_path / "broken" / "sleep__new").exists()
