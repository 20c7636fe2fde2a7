"""Writes, file sources and dimension documents."""

import json

from conftest import rows_of
from pyspark.sql import functions as F

from sunloom.plans.medallion import Warehouse
from sunloom.schemas import storage_cast
from sunloom.sources import delimited, messages, plant_config, tables
from sunloom.streaming import jobs

ROWS = "k string, ts timestamp, v int, seq int"


def frame(spark, data):
    return spark.createDataFrame(data, "k string, t string, v int, seq int").selectExpr("k", "cast(t as timestamp) as ts", "v", "seq")


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    first = frame(spark, [("a", "2024-01-01 10:00:00", 1, 1), ("b", "2024-01-02 10:00:00", 1, 1), ("c", "2024-01-03 10:00:00", 1, 1)])
    second = frame(spark, [("a", "2024-01-01 10:00:00", 2, 1), ("a", "2024-01-01 10:00:00", 3, 2), ("d", "2024-01-01 11:00:00", 9, 1)])
    tables.upsert(first, path, ["k", "ts"], ["seq"], "ts")
    for _ in range(2):
        tables.upsert(second, path, ["k", "ts"], ["seq"], "ts")
        assert rows_of(spark.read.parquet(path), "k", "v") == [("a", 3), ("b", 1), ("c", 1), ("d", 9)]
    # an older sequence number in a newer batch still replaces the stored row
    tables.upsert(frame(spark, [("a", "2024-01-01 10:00:00", 7, 0)]), path, ["k", "ts"], ["seq"], "ts")
    assert rows_of(spark.read.parquet(path), "k", "v")[0] == ("a", 7)


def test_insert_ignore(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.insert_ignore(frame(spark, [("a", "2024-01-01", 1, 1), ("a", "2024-01-01", 2, 2)]), path, ["k", "ts"], ["seq"])
    tables.insert_ignore(frame(spark, [("a", "2024-01-01", 5, 0), ("b", "2024-01-01", 6, 0)]), path, ["k", "ts"], ["seq"])
    assert rows_of(spark.read.parquet(path), "k", "v") == [("a", 1), ("b", 6)]


def test_partial_upsert(spark):
    old = spark.sql("select * from values ('x', 'n1', 1, timestamp'2024-01-01'), ('y', 'n2', 2, timestamp'2024-01-01') t(k, name, cap, updated_at)")
    new = spark.sql("select * from values ('x', 'new', 9), ('z', 'n3', 3) t(k, name, cap)")
    got = tables.partial_upsert(old, new, ["k"], ["name"], F.lit("2024-02-01").cast("timestamp"))
    shown = [(r.k, r.name, r.cap, str(r.updated_at)[:10]) for r in got.orderBy("k").collect()]
    assert shown == [("x", "new", 1, "2024-02-01"), ("y", "n2", 2, "2024-01-01"), ("z", "n3", 3, "2024-02-01")]


def test_daily_files_and_pruned_read(spark, tmp_path):
    path = str(tmp_path / "d")
    tables.daily_files(frame(spark, [("a", "2024-01-01 10:00:00", 1, 1), ("b", "2024-01-02 10:00:00", 1, 1)]), path)
    got = tables.read_table(spark, path, F.col("event_date") == "2024-01-02", ["k"])
    assert rows_of(got, "k") == [("b",)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "ReadSchema: struct<k:string>" in plan


def test_storage_cast(spark):
    df = spark.sql("select 12.34567D as instant_efficiency, 2.3456D as ac_power_kw")
    row = storage_cast(df, "silver_inverter").first()
    assert row["instant_efficiency"] is None and str(row["ac_power_kw"]) == "2.346"
    energy = spark.sql("select 1.23456D as net_energy_kwh")
    assert str(storage_cast(energy, "plant_hourly_summary").first()[0]) == "1.2346"
    assert str(storage_cast(energy, "plant_daily_summary").first()[0]) == "1.235"


def test_levels_compute_from_stored_precision(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "house"), stored_precision=True)
    rows = spark.range(6).selectExpr(
        "'P' as plant_id", "timestamp'2024-01-01' + make_interval(0,0,0,0,cast(id as int)) as ts", "20.004D as amb_temp_c", "2D as module_temp_c", "3D as wind_speed_ms",
        "4D as wind_dir_deg", "5D as humidity_percent", "1.234D as poa_irradiance_wm2", "timestamp'2024-01-01' as ingested_at", "cast(id as string) as raw_json",
    )
    sent = []
    jobs.store_silver(house, "meteo", rows, notify=lambda df: sent.extend(df.collect()))
    assert [(r["event"], r["data_type"], r["count"]) for r in sent] == [("silver_batch_processed", "meteo", 6)]
    assert dict(spark.read.parquet(house.path("silver_meteo")).dtypes)["amb_temp_c"] == "decimal(6,2)"
    # 1.234 is stored as 1.23, an hour of it as 0.021 (1.23 / 60), and the day adds the stored hours
    assert house.read("meteo_hourly").select("irradiation_wh_m2").distinct().first()[0] == 0.021
    assert house.read("meteo_daily").first()["total_irradiation_kwh_m2"] == 0.0001
    # a notification starts a scoring run, an empty feed does not
    jobs.store_silver(house, "inverter", rows.limit(0))
    calls = []
    monitor = jobs.score_new_rows
    try:
        jobs.score_new_rows = lambda *a: calls.append(a)
        for _ in range(2):
            jobs.score_on_trigger(house, lambda df: df, str(tmp_path / "ck2"), None).awaitTermination()
    finally:
        jobs.score_new_rows = monitor
    assert len(calls) == 1


def test_export_file(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(
        "id,timestamp,failure_types,raw_json,ingestion_timestamp,source,processing_status,error_message\n"
        '1,2026-01-15T10:00:00+01:00,[],"{""a"": 1, ""b"": [1,2]}",2026-01-15,kafka,new,\n'
        "2,2026-01-15T10:01:00+01:00,[],{},2026-01-15,kafka,new,\n"
        "\n"
        '3,2026-01-15T10:02:00+01:00,["a","b"],{},2026-01-15,kafka,new,\n'
        "broken\n"
    )
    df = delimited.read_export(spark, str(path))
    assert "error_message" not in df.columns
    good, bad = delimited.usable_rows(df)
    assert good.count() == 3 and bad.count() == 1
    first = good.filter("id = 1").first()
    assert json.loads(first["raw_json"].replace('""', '"')) == {"a": 1, "b": [1, 2]}
    target = str(tmp_path / "set")
    delimited.write_dataset(spark.sql("select 'A0' as inverter_id, '2024-01-01T00:00:00+01:00' as timestamp, 1.5D as p"), target)
    back = delimited.read_dataset(spark, target, "inverter_id string, timestamp string, p double").first()
    assert back["p"] == 1.5 and str(back["timestamp"]) == "2023-12-31 23:00:00"


def test_messages(spark):
    lines = [
        '{"guid":"g","inverter_id":"A0","timestamp":"2026-01-15T10:00:00+01:00","state":1.0,"ac_power_kW":"63.5","healthy_strings":"x","failure_types":["a"],"active_failures":null}',
        '{"inverter_id":null}', '{"amb_temp_C":null}', '{"import_active_power_kW":1,"connection_issues":"false"}', '{"import_active_power_kW":1,"connection_issues":1}',
        '{"component_status":{}}', "{}", '"text"', "{broken", "",
    ]
    routed = messages.route(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, value string"))
    kinds = [r[0] for r in routed.orderBy("n").select("message_type").collect()]
    assert kinds == ["inverter", "inverter", "meteo", "poi_meter", "poi_meter", "system_status", "unknown", None, None, None]
    row = messages.bronze(routed.filter("n = 0"), "inverter").first()
    assert (row.state, row.ac_power_kw, row.healthy_strings, row.active_failures, row.failure_types) == (1, 63.5, None, None, ["a"])
    assert str(row.ts) == "2026-01-15 09:00:00" and row.raw_json == lines[0]
    poi = messages.bronze(routed.filter("message_type = 'poi_meter'"), "poi_meter").orderBy("n").collect()
    assert [p.connection_issues for p in poi] == [False, True]
    good, bad = messages.split_valid(messages.bronze(routed.filter("n = 0"), "inverter"), "inverter")
    assert good.isEmpty() and bad.first()["error_message"] == "plant_id is not a UUID"


def test_plant_document(spark, tmp_path):
    doc = {
        "version": "1.0.0",
        "plant": {"plant_id": "p1", "plant_name": "Demo", "location": {"latitude": 40.4, "longitude": -3.7, "timezone": "Europe/Madrid"}, "total_capacity_kwp": 1260.0, "commissioning_date": "2024-01-01"},
        "inverter_groups": [{"group_id": "A", "inverter_count": 2, "inverter_ids": ["A0", "A1"]}, {"group_id": "B", "inverter_count": 1, "inverter_ids": ["B0"]}],
        "inverter_specs": {"nominal_capacity_kw": 90.0, "dc_side": {"current_max_a": 150, "strings_count": 12, "panels_per_string": 20, "panel_wp": 400}},
        "poi_meter_specs": {"meter_id": "M1", "meter_type": "bidirectional"},
        "thresholds": {"inverter": {"temp_warning_c": 55.0, "own": 1.0}},
    }
    (tmp_path / "plant.json").write_text(json.dumps(doc, indent=1))
    cfg = plant_config.read_configs(spark, str(tmp_path / "plant.json"))
    assert plant_config.dim_plant_config(cfg).first()["total_inverters"] == 3
    assets = plant_config.string_specs(plant_config.dim_asset(cfg)).orderBy("asset_id").collect()
    assert [(a.asset_id, a.asset_type, a.asset_group) for a in assets] == [
        ("A0", "inverter", "A"), ("A1", "inverter", "A"), ("B0", "inverter", "B"), ("M1", "poi_meter", None), ("METEO_01", "meteo_station", None)
    ]
    assert (assets[0].current_per_string_a, assets[0].power_per_string_kw, assets[0].efficiency_system_min) == (12.5, 8.0, 0.88)
    got = {(t.threshold_name, t.severity, t.threshold_unit) for t in plant_config.dim_thresholds(cfg).collect()}
    assert got == {("temp_warning_c", "warning", "°C"), ("own", "info", None)}
    assert plant_config.capacity_of(plant_config.dim_plant_config(cfg)).first()["capacity_kwp"] == 1260.0
