"""Options that the oracle queries leave at their defaults, and plan shapes."""

import math

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sunloom.functions import quality as q
from sunloom.operators import dashboard, gold, metrics, profile, reads, splits
from sunloom.plans import skew
from sunloom.workload import QUERIES
from sunloom.workload.relations import INVERTER_KEY, Relations


@pytest.fixture(scope="module")
def rel(spark):
    return Relations(spark, SMALL)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_circular_wind(spark):
    df = spark.sql(
        "select 'P' as plant_id, timestamp'2024-01-01' as ts, d as wind_dir_deg, 1D as amb_temp_c, 1D as module_temp_c, 1D as humidity_percent, 1D as wind_speed_ms,"
        " 1D as poa_irradiance_wm2, 'valid' as data_quality_flag from values (350D), (20D) t(d)"
    )
    row = gold.meteo_hourly(df, circular_wind=True).first()
    assert row.wind_dir_avg_deg == 185.0 and abs(row.wind_dir_circular_deg - 5.0) < 1e-9


def test_phase_imbalance(rel):
    row = gold.poi_hourly(rel.poi_s, phase_imbalance=True).agg(F.min("phase_imbalance_pct"), F.max("phase_imbalance_pct")).first()
    assert 0 <= row[0] <= row[1] < 100


def test_capacity_comes_from_the_plant(rel, spark):
    cap = spark.createDataFrame([("P0", 630.0)], "plant_id string, capacity_kwp double")
    args = (rel.inverter_d, rel.meteo_d, rel.poi_d, rel.status_d)
    base = {(r.plant_id, r.date): r.specific_yield_kwh_kwp for r in gold.plant_daily_summary(*args).collect()}
    for r in gold.plant_daily_summary(*args, cap).collect():
        factor = 2 if r.plant_id == "P0" else 1
        assert math.isclose(r.specific_yield_kwh_kwp, factor * base[(r.plant_id, r.date)])


def test_hourly_pairs_are_one_per_hour(rel):
    pairs = dashboard.forecast_vs_actual(rel.plant_h, rel.forecasts, hourly=True)
    assert pairs.groupBy("plant_id", "timestamp_hour").count().filter("count > 1").isEmpty()


def test_approximate_bounds_are_near(rel):
    exact = profile.iqr_bounds(rel.inverter, ["dc_voltage_v"]).first()
    near = profile.iqr_bounds(rel.inverter, ["dc_voltage_v"], approximate=True).first()
    assert abs(exact.dc_voltage_v_q1 - near.dc_voltage_v_q1) <= 20


def test_lookback_of_an_empty_warehouse(rel):
    none = rel.plant_h.filter("plant_id = 'nowhere'")
    out = reads.lookback({"plants": (none, "timestamp_hour"), "hours": (rel.inverter_h, "timestamp_hour")}, "plants", 24)
    assert all(df.isEmpty() for df in out.values())


def test_rankings(spark):
    runs = spark.createDataFrame([("A", "r1", "FINISHED", 0.9), ("A", "r2", "RUNNING", 0.99), ("A", "r3", "FINISHED", 0.9), ("B", "r4", "FAILED", 1.0)], "inverter_id string, run_id string, status string, f1 double")
    assert [tuple(r) for r in metrics.best_run(runs, "f1", False).collect()] == [("A", "r1", "FINISHED", 0.9)]
    feats = spark.createDataFrame([("a", 0.1), ("b", 0.5), ("c", 0.5)], "feature string, importance double")
    assert [r.feature for r in metrics.top_features(feats, 2).collect()] == ["b", "c"]
    best = metrics.ranked(runs, ["inverter_id"], [F.desc("f1"), F.col("run_id")], 1)
    assert {(r.inverter_id, r.run_id) for r in best.collect()} == {("A", "r2"), ("B", "r4")}


def test_column_helpers(spark):
    df = spark.sql("select 1 as id, 2D as x, cast(null as double) as y, 'a' as s, cast(1 as decimal(5,2)) as d")
    assert q.numeric_columns(df, ["id"]) == ["x", "y", "d"]
    assert q.existing_columns(df, ["x", "missing", "id"]).columns == ["x", "id"]
    assert q.drop_incomplete(df, ["x", "missing"]).count() == 1 and q.drop_incomplete(df).count() == 0
    with pytest.raises(ValueError, match="missing required columns: ts, v"):
        q.require_columns(df, ["id", "v", "ts"])


def test_folds_never_train_on_the_future(rel):
    folds = splits.time_series_folds(rel.inverter.select("id", *INVERTER_KEY, "ts"), INVERTER_KEY, 3)
    for f in (1, 2, 3):
        train, test = splits.fold_sets(folds, f)
        edge = train.groupBy(*INVERTER_KEY).agg(F.max("ts").alias("last"))
        assert test.join(edge, INVERTER_KEY).filter("ts <= last").isEmpty()


def test_hot_share_and_lookup(rel, spark):
    from sunloom.plans.medallion import hot_share

    assert 0.4 < hot_share(rel.inverter, ["plant_id"]) < 0.6
    small = skew.lookup(rel.inverter.groupBy("plant_id").count())
    assert "BroadcastHashJoin" in plan_of(rel.inverter.join(small, "plant_id"))


def test_plans(spark):
    """One exchange for the as-of join itself, and no pairing joins anywhere."""
    for name, query in QUERIES.items():
        if query.sql is None or name.startswith("stream_"):
            continue
        plan = plan_of(query.run(spark, SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan, name
    asof = plan_of(QUERIES["asof_nearest"].run(spark, SMALL))
    assert "Join" not in asof and asof.count("Exchange hashpartitioning") == 2
    scan = plan_of(QUERIES["rows_per_key"].run(spark, SMALL))
    assert "ReadSchema: struct<user_id:bigint>" in scan
