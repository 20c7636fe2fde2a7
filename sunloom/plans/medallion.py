"""Levels of the warehouse and how a change moves through them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.operators import gold
from sunloom.plans.skew import largest_group
from sunloom.schemas import KEYS, computing, storage_cast
from sunloom.session import ensure_checkpoint_dir
from sunloom.sources import tables

SILVER = {"inverter": "silver_inverter", "meteo": "silver_meteo", "poi_meter": "silver_poi_meter", "system_status": "silver_system_status"}
HOURLY = {"inverter": "inverter_hourly", "meteo": "meteo_hourly", "poi_meter": "poi_hourly", "system_status": "status_hourly"}
DAILY = {"inverter": "inverter_daily", "meteo": "meteo_daily", "poi_meter": "poi_daily", "system_status": "status_daily"}
TO_HOURLY = {
    "inverter": gold.inverter_hourly, "meteo": gold.meteo_hourly, "poi_meter": gold.poi_hourly, "system_status": gold.status_hourly,
}
TO_DAILY = {"inverter": gold.inverter_daily, "meteo": gold.meteo_daily, "poi_meter": gold.poi_daily, "system_status": gold.status_daily}


@dataclass(frozen=True)
class Warehouse:
    """Folder of the stored tables, all partitioned by ``event_date``.

    With ``stored_precision`` the measures of silver and gold tables are rounded to
    fixed decimals when they are written, and each level computes from what the
    level below stored.
    """

    spark: SparkSession
    root: str
    stored_precision: bool = False

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        return tables.table_exists(self.spark, self.path(table))

    def read(self, table: str) -> DataFrame:
        return computing(self.spark.read.parquet(self.path(table)))

    def stored(self, df: DataFrame, table: str) -> DataFrame:
        return storage_cast(df, table) if self.stored_precision else df

    def upsert(self, df: DataFrame, table: str, recency: list[str], ts: str, days: list | None = None) -> None:
        tables.upsert(self.stored(df, table), self.path(table), KEYS[table], recency, ts, days)

    def insert_only(self, df: DataFrame, table: str, ts: str) -> None:
        """Add rows with new keys; rows already stored stay as they are."""
        tables.insert_ignore(self.stored(df, table), self.path(table), KEYS[table], KEYS[table], ts)


def on_days(df: DataFrame, days: list) -> DataFrame:
    return df.filter(F.col("event_date").isin(days))


def refresh(
    house: Warehouse, kind: str, changed: DataFrame, samples_per_hour: float = 60.0, capacity: DataFrame | None = None, mode: str = "refresh",
    plants: bool = True, batch_id: int | None = None,
) -> None:
    """Recompute the hours and days that changed silver rows belong to.

    ``changed`` holds the key columns of the batch. Touched hours are aggregated
    again from silver, their days from the hourly table, and the plant tables from
    those. ``mode="insert_only"`` leaves rows alone once they are written.

    The plant tables read all feeds. Where several feeds run at once, pass
    ``plants=False``: the touched plant hours are then listed in ``plant_work``, for the
    one job that writes the plant tables (:func:`sunloom.streaming.jobs.plants_to_gold`).
    """
    ensure_checkpoint_dir(house.spark)
    key = ["plant_id", "inverter_id"] if kind == "inverter" else ["plant_id"]
    hours = changed.select(*key, F.date_trunc("hour", "ts").alias("timestamp_hour")).distinct().checkpoint()
    # one value per calendar day of the batch
    days = [r[0] for r in hours.select(F.to_date("timestamp_hour")).distinct().collect()]
    if not days:
        return

    store = storing(house, days, mode)
    silver = on_days(house.read(SILVER[kind]), days).withColumn("timestamp_hour", F.date_trunc("hour", "ts"))
    rows = silver.join(hours, [*key, "timestamp_hour"], "left_semi").drop("timestamp_hour", "event_date")
    make = TO_HOURLY[kind]
    hourly = make(rows) if kind == "system_status" else make(rows, samples_per_hour)
    store(hourly, HOURLY[kind], "timestamp_hour")

    dates = hours.select(*key, F.to_date("timestamp_hour").alias("date")).distinct()
    today = on_days(house.read(HOURLY[kind]), days).join(dates.withColumnRenamed("date", "event_date"), [*key, "event_date"], "left_semi")
    store(TO_DAILY[kind](today.drop("event_date")), DAILY[kind], "date")

    touched = hours.select("plant_id", "timestamp_hour").distinct()
    if plants:
        refresh_plants(house, touched, days, capacity, store)
    else:
        tables.replace_batch(touched, house.path("plant_work"), kind, batch_id)


def storing(house: Warehouse, days: list, mode: str):
    """Function that stores rows of these days in a gold table."""
    def store(df: DataFrame, table: str, ts: str) -> None:
        if mode == "insert_only":
            house.insert_only(df, table, ts)
        else:
            house.upsert(df, table, [], ts, days)

    return store


def refresh_plant_hours(house: Warehouse, hours: DataFrame, capacity: DataFrame | None = None, mode: str = "refresh") -> None:
    """Plant rows of these hours (plant_id, timestamp_hour) and of their days, from what all feeds have stored."""
    ensure_checkpoint_dir(house.spark)
    hours = hours.select("plant_id", "timestamp_hour").distinct().checkpoint()
    # one value per calendar day of the work
    days = [r[0] for r in hours.select(F.to_date("timestamp_hour")).distinct().collect()]
    if days:
        refresh_plants(house, hours, days, capacity, storing(house, days, mode))


def refresh_open_plants(house: Warehouse, **options) -> None:
    """Plant rows that the inverter tables call for and that are not written yet."""
    hours, days = open_plants(house)
    whole = house.read(HOURLY["inverter"]).select("plant_id", "timestamp_hour", F.to_date("timestamp_hour").alias("date"))
    whole = whole.join(days, ["plant_id", "date"], "left_semi").drop("date")
    refresh_plant_hours(house, hours.select("plant_id", "timestamp_hour").unionByName(whole), **options)


#: what the plant tables read of the feeds beside the inverters
PLANT_SIDES = {
    "meteo_hourly": "timestamp_hour timestamp, irradiation_wh_m2 double, avg_irradiance_wm2 double, temp_avg_c double, module_temp_avg_c double",
    "poi_hourly": "timestamp_hour timestamp, import_energy_kwh double, export_energy_kwh double, avg_import_kw double",
    "silver_system_status": "ts timestamp, stress_level double",
    "meteo_daily": "date date, total_irradiation_kwh_m2 double, sunshine_hours bigint, temp_avg_c double, module_temp_avg_c double",
    "poi_daily": "date date, total_import_kwh double, total_export_kwh double, availability_percent double",
    "status_daily": "date date, total_failures_sum bigint, total_critical_failures bigint, stress_level_avg double",
}


def read_side(house: Warehouse, table: str) -> DataFrame:
    """A table of a feed that may not have begun; then it has no rows."""
    if house.exists(table):
        return house.read(table)
    return house.spark.createDataFrame([], f"plant_id string, {PLANT_SIDES[table]}, event_date date")


def refresh_plants(house: Warehouse, hours: DataFrame, days: list, capacity: DataFrame | None, store) -> None:
    """Plant tables of the touched hours and days.

    Every hour with inverter rows has a plant row; what other feeds lack is filled with
    the defaults of the summaries, until they arrive and touch the hour again.
    """
    if not house.exists(HOURLY["inverter"]):
        return
    hour = ["plant_id", "timestamp_hour"]

    def at_hours(table: str) -> DataFrame:
        rows = house.read(table) if table == HOURLY["inverter"] else read_side(house, table)
        return on_days(rows, days).drop("event_date").join(hours, hour, "left_semi")

    status = on_days(read_side(house, SILVER["system_status"]), days).withColumn("timestamp_hour", F.date_trunc("hour", "ts"))
    status = status.join(hours, hour, "left_semi").drop("timestamp_hour", "event_date")
    summary = gold.plant_hourly_summary(*[at_hours(HOURLY[k]) for k in ("inverter", "meteo", "poi_meter")], status, capacity)
    store(summary, "plant_hourly_summary", "timestamp_hour")

    dates = hours.select("plant_id", F.to_date("timestamp_hour").alias("date")).distinct()
    read = {k: house.read if k == "inverter" else lambda t: read_side(house, t) for k in DAILY}
    daily = [on_days(read[k](DAILY[k]), days).drop("event_date").join(dates, ["plant_id", "date"], "left_semi") for k in DAILY]
    store(gold.plant_daily_summary(*daily, capacity), "plant_daily_summary", "date")


def open_plants(house: Warehouse) -> tuple[DataFrame, DataFrame]:
    """Plant hours and plant days that the inverter tables have and the plant tables do not."""
    def done(table: str) -> DataFrame | None:
        return house.read(table) if house.exists(table) else None

    hours = gold.missing_keys(house.read(HOURLY["inverter"]), done("plant_hourly_summary"), {c: F.col(c) for c in KEYS["plant_hourly_summary"]})
    days = gold.missing_keys(house.read(DAILY["inverter"]), done("plant_daily_summary"), {c: F.col(c) for c in KEYS["plant_daily_summary"]})
    return hours, days


def rebuild(house: Warehouse, kind: str, **options) -> None:
    """Refresh every hour of a silver table, for a first load or after a rule change."""
    refresh(house, kind, house.read(SILVER[kind]), **options)


def backlog(house: Warehouse, kind: str) -> DataFrame:
    """Hours that silver has and the hourly table does not."""
    key = ["plant_id", "inverter_id"] if kind == "inverter" else ["plant_id"]
    keys = {**{k: F.col(k) for k in key}, "timestamp_hour": F.date_trunc("hour", "ts")}
    done = house.read(HOURLY[kind]) if house.exists(HOURLY[kind]) else None
    return gold.missing_keys(house.read(SILVER[kind]), done, keys)


def hot_share(df: DataFrame, by: list[str]) -> float:
    """Share of all rows that the largest group holds, to judge the skew of a feed."""
    total = df.count()
    return largest_group(df, by) / total if total else 0.0
