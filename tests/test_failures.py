"""Daily failures of an outage over several days."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sunloom.operators.failures import failure_daily_summary

START = datetime(2024, 6, 3, 18)


@pytest.fixture(scope="module")
def readings(spark):
    rows = []
    for plant in ("P0", "P1"):
        for h in range(0, 84):
            failing = h < 76 and h not in (30, 31)  # no reading on these two hours
            if h not in (30, 31):
                rows.append((plant, "A0", START + timedelta(hours=h), 0 if failing else 1, 1 if failing else 0, 10.0, ["grid"] if failing else []))
    df = spark.createDataFrame(rows, "plant_id string, inverter_id string, ts timestamp, state int, active_failures int, ac_power_kw double, failure_types array<string>")
    return df


def test_downtime_is_cut_at_midnight(readings):
    got = failure_daily_summary(readings).filter("plant_id = 'P0'").orderBy("date").collect()
    assert [r["total_downtime_minutes"] for r in got] == [6 * 60, 1440, 1440, 1440 - 2 * 60]
    assert [r["failure_count"] for r in got] == [1, 0, 0, 0]
    assert sum(r["total_downtime_minutes"] for r in got) == 76 * 60 == got[0]["mean_time_to_repair_minutes"]


def test_sites_place_the_plants(spark, readings):
    sites = spark.createDataFrame([("P1", 40.4168, -3.7038, 900.0)], "plant_id string, latitude double, longitude double, capacity_kw double")
    lost = {r[0]: r[1] for r in failure_daily_summary(readings, sites=sites).groupBy("plant_id").agg(F.sum("estimated_energy_loss_kwh")).collect()}
    plain = {r[0]: r[1] for r in failure_daily_summary(readings).groupBy("plant_id").agg(F.sum("estimated_energy_loss_kwh")).collect()}
    assert lost["P0"] == plain["P0"] == plain["P1"] and lost["P1"] > 9 * lost["P0"]
