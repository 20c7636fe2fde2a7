"""Stream and batch agree; replays, restarts, late rows and repeats behave."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from sunloom.functions.quality import clean
from sunloom.operators import gold, timeseries
from sunloom.plans.medallion import HOURLY, Warehouse, backlog, open_plants, rebuild, refresh_open_plants
from sunloom.sources import messages, tables
from sunloom.streaming import jobs

PLANT = "550e8400-e29b-41d4-a716-446655440000"
START = datetime(2026, 1, 15, 8, tzinfo=timezone.utc)


def message(kind, minute, rng):
    at = (START + timedelta(minutes=minute)).isoformat()
    if kind == "inverter":
        return {
            "guid": PLANT, "inverter_id": rng.choice(["A0", "B1"]), "timestamp": at, "state": rng.choice([0, 1]), "inverter_temp_C": rng.choice([20.5, None, 120]),
            "ac_power_kW": rng.choice([10.25, -1, 60.5]), "ac_freq_Hz": 50.0, "dc_power_kW": 65.0, "dc_voltage_V": 800, "dc_current_A": 80.0,
            "healthy_strings": 12, "failed_strings": 0, "active_failures": rng.choice([0, 1]), "failure_types": rng.choice([[], ["grid"], ["a", "b"]]),
        }
    if kind == "meteo":
        return {"guid": PLANT, "timestamp": at, "amb_temp_C": 8.5, "module_temp_C": 19.5, "wind_speed_ms": 3.0, "wind_dir_deg": 200.0, "humidity_percent": 55.0, "poa_irradiance_wm2": rng.choice([0.0, 612.5])}
    if kind == "poi_meter":
        return {
            "guid": PLANT, "timestamp": at, "export_active_power_kW": rng.choice([0.0, 700.0]), "import_active_power_kW": rng.choice([0.0, 5.0]), "reactive_power_kVAr": 30.0,
            "grid_voltage_l1_V": 400.0, "grid_voltage_l2_V": 399.5, "grid_voltage_l3_V": 401.0, "grid_frequency_Hz": 50.0, "power_factor": 0.98,
            "active_failures": 0, "connection_issues": rng.choice([True, False]),
        }
    return {
        "guid": PLANT, "timestamp": at, "system_impact": {"total_failures": 2, "stress_level": 0.4, "affected_components": ["x", "y"], "critical_failures": 0},
        "component_status": {"total": 16, "healthy": 14, "failed": 2},
    }


def write(folder, number, lines):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"{number:03d}.json"
    path.write_text("\n".join(lines) + "\n")
    # the file source reads in order of modification time
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


@pytest.fixture()
def feed(tmp_path):
    rng = random.Random(5)
    lines = [json.dumps(message(k, m, rng)) for m in range(0, 180, 9) for k in ("inverter", "inverter", "meteo", "poi_meter", "system_status")]
    lines += ['{"inverter_id":null,"timestamp":"2026-01-15T09:00:00Z"}', '{"foo":1}', "not json"]
    rng.shuffle(lines)
    for i in range(3):
        write(tmp_path / "in", i, lines[i::3])
    return tmp_path, lines


def run_all(house, tmp):
    stream = messages.file_messages(house.spark, str(tmp / "in"), max_files=1)
    jobs.ingest(house, stream, str(tmp / "ck" / "ingest")).awaitTermination()
    for kind in ("inverter", "meteo", "poi_meter", "system_status"):
        jobs.bronze_to_gold(house, kind, str(tmp / "ck" / kind)).awaitTermination()
    jobs.plants_to_gold(house, str(tmp / "ck" / "plants")).awaitTermination()


GOLD = {
    "inverter_hourly": ["plant_id", "inverter_id", "timestamp_hour", "energy_kwh", "failure_types", "record_count"],
    "inverter_daily": ["plant_id", "inverter_id", "date", "total_energy_kwh", "total_failures"],
    "meteo_hourly": ["plant_id", "timestamp_hour", "irradiation_wh_m2"],
    "poi_hourly": ["plant_id", "timestamp_hour", "import_energy_kwh", "availability_percent"],
    "status_daily": ["plant_id", "date", "total_failures_sum"],
    "plant_hourly_summary": ["plant_id", "timestamp_hour", "net_energy_kwh", "instantaneous_pr"],
    "plant_daily_summary": ["plant_id", "date", "total_generation_kwh", "performance_ratio", "total_failures"],
}


def test_stream_equals_batch_and_restart(spark, feed):
    tmp, lines = feed
    house = Warehouse(spark, str(tmp / "house"))
    run_all(house, tmp)

    text = spark.createDataFrame([(x,) for x in lines], "value string")
    routed = messages.route(text)
    silver = {}
    for kind, table in (("inverter", "silver_inverter"), ("meteo", "silver_meteo"), ("poi_meter", "silver_poi_meter"), ("system_status", "silver_system_status")):
        good, _ = messages.split_valid(messages.bronze(routed.filter(F.col("message_type") == kind), kind), kind)
        keys = ["plant_id", "inverter_id", "ts"] if kind == "inverter" else ["plant_id", "ts"]
        silver[kind] = clean(good, kind)
        stored = house.read(table)
        assert stored.groupBy(*keys).count().filter("count > 1").isEmpty()
        assert stored.count() == silver[kind].select(*keys).distinct().count()
    # rebuild the gold tables from what was stored, and compare with the incremental ones
    make = {
        "inverter_hourly": gold.inverter_hourly(house.read("silver_inverter")), "meteo_hourly": gold.meteo_hourly(house.read("silver_meteo")),
        "poi_hourly": gold.poi_hourly(house.read("silver_poi_meter")), "status_hourly": gold.status_hourly(house.read("silver_system_status")),
    }
    make["inverter_daily"] = gold.inverter_daily(make["inverter_hourly"])
    daily = [make["inverter_daily"], gold.meteo_daily(make["meteo_hourly"]), gold.poi_daily(make["poi_hourly"]), gold.status_daily(make["status_hourly"])]
    make["status_daily"] = daily[3]
    make["plant_hourly_summary"] = gold.plant_hourly_summary(make["inverter_hourly"], make["meteo_hourly"], make["poi_hourly"], house.read("silver_system_status"))
    make["plant_daily_summary"] = gold.plant_daily_summary(*daily)
    for table, columns in GOLD.items():
        assert rows_of(house.read(table), *columns) == rows_of(make[table], *columns), table
    # energy of the day is the energy of its readings
    direct = house.read("silver_inverter").agg(F.sum("ac_power_kw") / 60).first()[0]
    assert abs(house.read("inverter_daily").agg(F.sum("total_energy_kwh")).first()[0] - direct) < 1e-9

    letters = rows_of(house.read("dead_letters"), "message_type", "error_message")
    assert letters == [("inverter", "plant_id missing"), ("unknown", "unknown kind of message"), ("unreadable", "not a JSON object")]
    assert {r["data_type"] for r in house.read("inference_trigger").collect()} == {"inverter", "meteo"}
    assert backlog(house, "inverter").isEmpty()

    before = {t: rows_of(house.read(t), *c) for t, c in GOLD.items()}
    run_all(house, tmp)
    assert {t: rows_of(house.read(t), *c) for t, c in GOLD.items()} == before
    rebuild(house, "inverter")
    assert {t: rows_of(house.read(t), *c) for t, c in GOLD.items()} == before

    # a late reading is counted in its hour, and the day and plant rows follow
    late = message("inverter", 1, random.Random(1)) | {"inverter_id": "A0", "ac_power_kW": 600.0, "timestamp": "2026-01-15T08:01:30Z"}
    write(tmp / "in", 9, [json.dumps(late)])
    run_all(house, tmp)
    gained = house.read("plant_daily_summary").agg(F.sum("total_generation_kwh")).first()[0] - (direct)
    assert abs(gained - 10.0) < 1e-9


def test_feeds_at_once_lose_no_plant_row(spark, feed):
    tmp, _ = feed
    house, apart = Warehouse(spark, str(tmp / "house")), Warehouse(spark, str(tmp / "apart"))
    jobs.ingest(house, messages.file_messages(spark, str(tmp / "in")), str(tmp / "ck" / "ingest")).awaitTermination()
    running = [jobs.bronze_to_gold(house, kind, str(tmp / "ck" / kind)) for kind in ("inverter", "poi_meter", "system_status")]
    for stream in running:
        stream.awaitTermination()
    assert not house.exists("plant_hourly_summary")
    jobs.plants_to_gold(house, str(tmp / "ck" / "plants")).awaitTermination()
    assert house.read("plant_hourly_summary").agg(F.sum("irradiation_wh_m2")).first()[0] == 0
    # a feed that starts late touches the hours that are already written
    jobs.bronze_to_gold(house, "meteo", str(tmp / "ck" / "meteo")).awaitTermination()
    jobs.plants_to_gold(house, str(tmp / "ck" / "plants")).awaitTermination()
    jobs.ingest(apart, messages.file_messages(spark, str(tmp / "in")), str(tmp / "ck2" / "ingest")).awaitTermination()
    for kind in ("inverter", "meteo", "poi_meter", "system_status"):
        jobs.bronze_to_gold(apart, kind, str(tmp / "ck2" / kind), plants=True).awaitTermination()
    for table in ("plant_hourly_summary", "plant_daily_summary"):
        assert rows_of(house.read(table), *GOLD[table]) == rows_of(apart.read(table), *GOLD[table])
    assert house.read("plant_hourly_summary").agg(F.sum("irradiation_wh_m2")).first()[0] > 0
    # a replay of the work writes the same rows, and rows lost from a plant table are taken up again
    before = {t: rows_of(house.read(t), *GOLD[t]) for t in ("plant_hourly_summary", "plant_daily_summary")}
    jobs.plants_to_gold(house, str(tmp / "ck3" / "plants")).awaitTermination()
    assert {t: rows_of(house.read(t), *GOLD[t]) for t in before} == before
    house.read("plant_hourly_summary").limit(1).write.mode("overwrite").partitionBy("event_date").parquet(str(tmp / "cut" / "plant_hourly_summary"))
    house.read("inverter_hourly").write.partitionBy("event_date").parquet(str(tmp / "cut" / "inverter_hourly"))
    house.read("inverter_daily").write.partitionBy("event_date").parquet(str(tmp / "cut" / "inverter_daily"))
    cut = Warehouse(spark, str(tmp / "cut"))
    refresh_open_plants(cut)
    assert all(keys.isEmpty() for keys in open_plants(cut))
    assert cut.read("plant_hourly_summary").count() == len(before["plant_hourly_summary"])


def test_counts_of_each_batch_are_stored(spark, feed):
    tmp, lines = feed
    house = Warehouse(spark, str(tmp / "house"))
    batch = spark.createDataFrame([(x,) for x in lines], "value string")
    for _ in range(2):
        jobs.store_bronze(house, batch, 3)
    got = {r["message_type"]: (r["processed"], r["failed"]) for r in house.read("run_metrics").collect()}
    assert got == {"inverter": (40, 1), "meteo": (20, 0), "poi_meter": (20, 0), "system_status": (20, 0), "unknown": (0, 1), "unreadable": (0, 1)}
    jobs.store_silver(house, "meteo", house.read("bronze_meteo"), batch_id=3)
    assert [(r["processed"], r["failed"]) for r in house.read("run_metrics").filter("feed = 'silver_meteo'").collect()] == [(20, 0)]


def test_forecasts_are_stored_once(spark, tmp_path):
    house, rng = Warehouse(spark, str(tmp_path / "house")), random.Random(4)
    text = messages.route(spark.createDataFrame([(json.dumps(message("inverter", m, rng)),) for m in range(0, 90, 3)], "value string"))
    jobs.store_silver(house, "inverter", messages.split_valid(messages.bronze(text, "inverter"), "inverter")[0])

    def predict(grid):
        return grid.withColumn("predicted_ac_power_kw", F.when(F.minute("ts") != 30, F.hour("ts").cast("double")))

    assert jobs.store_forecasts(house, predict, "r1", 6)
    first = house.read("forecast_predictions")
    newest = {r[0]: r[1] for r in house.read("silver_inverter").groupBy("inverter_id").agg(F.max("ts")).collect()}
    got = {r[0]: r[1:] for r in first.groupBy("inverter_id").agg(F.min("ts"), F.max("ts"), F.count("*")).collect()}
    for inverter, last in newest.items():
        times = [last + timedelta(minutes=15 * i) for i in range(1, 25)]
        times = [t for t in times if t.minute != 30]
        assert got[inverter] == (times[0], times[-1], len(times))
    assert first.filter("predicted_ac_power_kw <> hour(ts)").isEmpty()
    rows = first.count()
    jobs.store_forecasts(house, predict, "r1", 6)
    assert house.read("forecast_predictions").count() == rows
    assert jobs.store_forecasts(house, predict, "r2", 6, since="2026-01-15") and not jobs.store_forecasts(house, predict, "r3", 6, since="2026-01-16")
    assert house.read("forecast_predictions").count() == 2 * rows


def test_replayed_batch_is_stored_once(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "house"))
    rng = random.Random(2)
    batch = spark.createDataFrame([(json.dumps(message("inverter", m, rng)),) for m in range(20)], "value string")
    jobs.store_bronze(house, batch, 4)
    jobs.store_bronze(house, batch, 4)
    assert house.read("bronze_inverter").count() == 20
    jobs.store_bronze(house, batch, 5)
    assert house.read("bronze_inverter").count() == 40


def test_insert_only_leaves_hours_alone(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "house"))
    rows = spark.range(2).selectExpr("'P' as plant_id", "timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,cast(id as int)) as ts", "1D as amb_temp_c", "2D as module_temp_c", "3D as wind_speed_ms", "4D as wind_dir_deg", "5D as humidity_percent", "60D as poa_irradiance_wm2", "timestamp'2024-01-01' as ingested_at", "cast(id as string) as raw_json")
    jobs.store_silver(house, "meteo", rows.filter("raw_json = '0'"), mode="insert_only")
    jobs.store_silver(house, "meteo", rows.filter("raw_json = '1'"), mode="insert_only")
    assert [r["record_count"] for r in house.read(HOURLY["meteo"]).collect()] == [1]
    jobs.store_silver(house, "meteo", rows)
    assert [r["record_count"] for r in house.read(HOURLY["meteo"]).collect()] == [2]
    assert [r["irradiation_wh_m2"] for r in house.read(HOURLY["meteo"]).collect()] == [2.0]


SCHEMA = "plant_id string, inverter_id string, ts timestamp, ac_power_kw double"


def reading(at, power=60.0):
    return json.dumps({"plant_id": "P", "inverter_id": "A0", "ts": at, "ac_power_kw": power})


def test_windowed_stream_drops_what_is_behind_the_watermark(spark, tmp_path):
    files = [
        [reading("2024-01-01T10:05:00Z"), reading("2024-01-01T10:20:00Z")],
        [reading("2024-01-01T12:30:00Z")],
        [reading("2024-01-01T12:40:00Z")],
        [reading("2024-01-01T10:50:00Z", 999.0)],
        [reading("2024-01-01T15:00:00Z")],
    ]
    for i, lines in enumerate(files):
        write(tmp_path / "in", i, lines)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    writer = jobs.hourly_energy(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    jobs.started(writer, str(tmp_path / "ck"), None).awaitTermination()
    got = {r["timestamp_hour"].hour: (r["record_count"], r["energy_kwh"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[10] == (2, 2.0) and got[12] == (2, 2.0)


def test_repeats_within_the_delay(spark, tmp_path):
    write(tmp_path / "in", 0, [reading("2024-01-01T10:05:00Z"), reading("2024-01-01T10:05:00Z")])
    write(tmp_path / "in", 1, [reading("2024-01-01T10:05:00Z"), reading("2024-01-01T10:06:00Z")])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    once = jobs.deduplicated(stream, ["plant_id", "inverter_id", "ts"])
    jobs.started(once.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "ck"), None).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_archive_by_topic(spark, tmp_path):
    df = spark.createDataFrame(
        [('{"a":1}', "inverter", 0, 7), ('{"b":[1,2]}', "poi_meter", 1, 8)], "value string, topic string, partition int, offset long"
    ).withColumn("received_at", F.lit("2024-01-01").cast("timestamp"))
    tables.archive(messages.archive_envelope(df), str(tmp_path / "a"))
    lines = {r["topic"]: json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "a")).collect()}
    assert lines["inverter"]["data"] == {"a": 1} and lines["poi_meter"]["data"] == {"b": [1, 2]} and lines["poi_meter"]["offset"] == 8


def test_scoring_moves_the_watermark(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "house"))
    rng = random.Random(4)
    for n, minutes in enumerate((range(0, 30, 3), range(30, 60, 3))):
        batch = spark.createDataFrame([(json.dumps(message(k, m, rng)),) for m in minutes for k in ("inverter", "meteo")], "value string")
        jobs.store_bronze(house, batch, n)
        for kind in ("inverter", "meteo"):
            jobs.store_silver(house, kind, house.read(f"bronze_{kind}").filter(F.col("batch_id") == n))

        def score(df):
            return df.select("plant_id", "inverter_id", "ts", F.lit("r").alias("model_run_id"), F.col("amb_temp_c").alias("reconstruction_error"), F.lit(1.0).alias("threshold"), F.lit(1).alias("is_anomaly"))

        assert jobs.score_new_rows(house, score)
        assert not jobs.score_new_rows(house, score)
        assert house.read("anomaly_predictions").count() == 10 * (n + 1)
    assert jobs.score_new_rows(house, score, reprocess_from="2026-01-15")
    assert house.read("anomaly_predictions").count() == 20
    marks = {r["inverter_id"]: r["last_processed_ts"] for r in house.read("inference_watermark").collect()}
    newest = {r["inverter_id"]: r["t"] for r in house.read("silver_inverter").groupBy("inverter_id").agg(F.max("ts").alias("t")).collect()}
    assert marks == newest
    assert house.read("anomaly_predictions").filter("reconstruction_error is null").isEmpty()
    # a late plant with an inverter id that is known elsewhere is scored from its first row on
    late = [message(k, m, rng) | {"guid": PLANT[:-1] + "9"} for m in range(0, 30, 3) for k in ("inverter", "meteo")]
    jobs.store_bronze(house, spark.createDataFrame([(json.dumps(x),) for x in late], "value string"), 2)
    for kind in ("inverter", "meteo"):
        jobs.store_silver(house, kind, house.read(f"bronze_{kind}").filter(F.col("batch_id") == 2))
    assert jobs.score_new_rows(house, score) and not jobs.score_new_rows(house, score)
    assert house.read("anomaly_predictions").count() == 30
    assert house.read("inference_watermark").select("plant_id").distinct().count() == 2


def test_plants_have_rows_before_all_feeds_do(spark, tmp_path):
    house, rng = Warehouse(spark, str(tmp_path / "house")), random.Random(3)

    def arrives(kind, hours, batch_id):
        lines = [json.dumps(message(kind, 60 * h + 5, rng)) for h in hours]
        text = messages.route(spark.createDataFrame([(x,) for x in lines], "value string"))
        jobs.store_silver(house, kind, messages.split_valid(messages.bronze(text, kind), kind)[0], batch_id=batch_id)

    def plants():
        columns = ["timestamp_hour", "irradiation_wh_m2", "total_consumption_kwh", "system_stress_avg"]
        return {r[0]: r[1:] for r in (tuple(x) for x in house.read("plant_hourly_summary").select(*columns).collect())}

    arrives("inverter", range(3), 0)
    first = plants()
    assert len(first) == 3 and set(first.values()) == {(0.0, 0.0, 0.0)}
    assert house.read("plant_daily_summary").count() == 1
    for kind in ("meteo", "poi_meter", "system_status"):
        arrives(kind, range(24, 26), 0)
    arrives("inverter", range(24, 26), 1)
    assert len(plants()) == 5 and house.read("plant_daily_summary").count() == 2
    arrives("system_status", [1], 1)
    late = plants()
    assert len(late) == 5 and [v[2] for _, v in sorted(late.items())] == [0.0, 0.4, 0.0, 0.4, 0.4]
    assert all(keys.isEmpty() for keys in open_plants(house))
    counts = house.read("inference_trigger").count()
    arrives("system_status", [1], 1)
    assert house.read("inference_trigger").count() == counts and plants() == late


def rows_stream(spark, folder, parts, schema):
    """A stream of one file a batch, in order."""
    for i, part in enumerate(parts):
        target = folder / f"{i}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(target))
        for f in target.glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def ended(spark, stream, folder):
    jobs.started(stream.writeStream.format("parquet").option("path", str(folder / "out")), str(folder / "ck"), None).awaitTermination()
    return spark.read.parquet(str(folder / "out"))


def test_a_late_reading_joins_two_outages(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    row = lambda m, severity="LOW", part="A0": (PLANT, part, at(m), severity, f"kind{m}")
    parts = [[row(0), row(15), row(0, "HIGH", "B1")], [row(8)], [row(400)], [row(800)]]
    stream = rows_stream(spark, tmp_path / "in", parts, "plant_id string, component_id string, ts timestamp, severity string, failure_type string")
    got = {(r["component_id"], r["start_ts"].replace(tzinfo=timezone.utc)): r for r in ended(spark, jobs.outage_sessions(stream), tmp_path).collect()}
    one, other = got["A0", at(0)], got["B1", at(0)]
    assert one["readings"] == 3 and one["end_ts"].replace(tzinfo=timezone.utc) == at(25) and one["failure_types"] == ["kind0", "kind15", "kind8"]
    assert other["readings"] == 1 and other["end_ts"].replace(tzinfo=timezone.utc) == at(30) and other["severity"] == "HIGH"
    assert ("A0", at(15)) not in got


def test_nearest_rows_of_two_streams(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    lefts = [[(1, "P", at(0)), (2, "P", at(30)), (3, "Q", at(30))], [(4, "P", at(100))], [(9, "P", at(900))], [(10, "P", at(1_000))]]
    rights = [[("P", at(10), 7)], [("P", at(20), 5), ("P", at(40), 6), ("P", at(20), 8)], [("P", at(900), 9)], [("P", at(1_000), 10)]]
    left = rows_stream(spark, tmp_path / "l", lefts, "id long, plant_id string, ts timestamp")
    right = rows_stream(spark, tmp_path / "r", rights, "plant_id string, ts timestamp, meteo_id long")
    got = {r["id"]: r["meteo_id"] for r in ended(spark, jobs.nearest_joined(left, right, "20 minutes", "1 hour"), tmp_path).collect()}
    # 2 lies between two at the same distance: the earlier side wins, and of its equals the last
    assert {k: got[k] for k in (1, 2, 3, 4)} == {1: 7, 2: 8, 3: None, 4: None}


def test_nearest_rows_of_streams_hold_no_pairs(spark, tmp_path):
    """Many rows within one tolerance, in two batches: answers as of the batch operator, cell by cell, and no join."""
    rng = random.Random(4)
    step = lambda n: [rng.randrange(n * 7_200_000_000, (n + 1) * 7_200_000_000) for _ in range(600)]
    at = lambda us: START + timedelta(microseconds=us)
    schema = "id long, plant_id string, ts timestamp, seen timestamp"
    lefts = [[((1 << 60) + n * 600 + i, rng.choice(["P", "Q", None]), at(us), at(us + 1)) for i, us in enumerate(step(n))] for n in range(2)]
    rights = [[((1 << 61) + n * 600 + i, rng.choice(["P", "Q", None]), at(us // 60_000_000 * 60_000_000), at(us)) for i, us in enumerate(step(n))] for n in range(2)]
    named = lambda df: df.withColumnsRenamed({"id": "rid", "seen": "read"})
    stream = jobs.nearest_joined(rows_stream(spark, tmp_path / "l", lefts, schema), named(rows_stream(spark, tmp_path / "r", rights, schema)), right_order=["rid"])
    got = ended(spark, stream, tmp_path)
    batch = lambda parts: spark.createDataFrame([r for p in parts for r in p], schema)
    l, r = batch(lefts), batch(rights)
    done = min(df.agg({"ts": "max"}).first()[0] for df in (l, r)) - timedelta(minutes=90)
    want = timeseries.asof_nearest(l, named(r), 1800, right_order=["rid"]).withColumn("no_plant", F.col("plant_id").isNull())
    want = want.filter(F.col("ts") <= F.lit(done)).withColumns({c: F.when(~F.col("no_plant"), F.col(c)) for c in ("rid", "read")}).drop("no_plant")
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns) and got.count() > 500
    plan = stream._jdf.queryExecution().logical().toString()
    assert "Join" not in plan
