"""Nested plant configuration documents to dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG_SCHEMA = """
version string,
plant struct<plant_id string, plant_name string,
  location struct<latitude double, longitude double, timezone string, altitude_m double>,
  commissioning_date string, total_capacity_kwp double, total_surface_m2 double,
  grid_connection struct<voltage_nominal_v double, frequency_nominal_hz double, phases int>>,
inverter_groups array<struct<group_id string, inverter_count int, inverter_ids array<string>>>,
inverter_specs struct<nominal_capacity_kw double, panel_surface_m2 double,
  dc_side struct<voltage_mpp_min_v double, voltage_mpp_max_v double, voltage_nominal_v double, current_max_a double,
    strings_count int, panels_per_string int, panel_wp double>,
  ac_side struct<voltage_nominal_v double, frequency_nominal_hz double, power_factor_nominal double>,
  efficiency struct<dc_ac_nominal double, dc_ac_min_acceptable double, system_efficiency_range array<double>>,
  thermal struct<temp_coefficient_power_pct_per_c double, stc_temperature_c double, max_operating_temp_c double>>,
poi_meter_specs struct<meter_id string, meter_type string, grid_voltage struct<nominal_v double>,
  power_capacity struct<max_export_kw double, max_import_kw double>>,
meteo_station_specs struct<station_id string>,
thresholds map<string, map<string, double>>
"""

# Unit, severity and text of the known thresholds.
THRESHOLD_NOTES = [
    ("inverter", "efficiency_alert_min", "ratio", "alert", "Minimum DC-AC efficiency before alert"),
    ("inverter", "efficiency_warning_min", "ratio", "warning", "Minimum DC-AC efficiency before warning"),
    ("inverter", "temp_warning_c", "°C", "warning", "Inverter temperature warning threshold"),
    ("inverter", "temp_critical_c", "°C", "critical", "Inverter temperature critical threshold"),
    ("inverter", "freq_deviation_warning_hz", "Hz", "warning", "Grid frequency deviation warning"),
    ("inverter", "freq_deviation_critical_hz", "Hz", "critical", "Grid frequency deviation critical"),
    ("dc_diagnostics", "string_current_imbalance_pct", "%", "warning", "Maximum acceptable current imbalance between strings"),
    ("dc_diagnostics", "voltage_deviation_pct", "%", "warning", "Maximum acceptable DC voltage deviation from nominal"),
    ("dc_diagnostics", "min_power_for_efficiency_calc_kw", "kW", "info", "Minimum DC power to calculate meaningful efficiency"),
    ("poi_meter", "voltage_deviation_warning_pct", "%", "warning", "Grid voltage deviation warning threshold"),
    ("poi_meter", "voltage_deviation_critical_pct", "%", "critical", "Grid voltage deviation critical threshold"),
    ("poi_meter", "power_factor_warning_min", "ratio", "warning", "Minimum power factor before warning"),
    ("poi_meter", "power_factor_critical_min", "ratio", "critical", "Minimum power factor before critical alert"),
]


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Configuration files, one document each."""
    return spark.read.option("multiLine", True).schema(CONFIG_SCHEMA).json(path)


def parse_configs(df: DataFrame, payload: str = "value") -> DataFrame:
    """Configuration documents held as text."""
    return df.select(F.from_json(payload, CONFIG_SCHEMA).alias("c")).select("c.*")


def dim_plant_config(configs: DataFrame) -> DataFrame:
    total = F.aggregate("inverter_groups", F.lit(0), lambda a, g: a + F.coalesce(g["inverter_count"], F.lit(0)))
    return configs.select(
        "plant.plant_id", "plant.plant_name",
        "plant.location.latitude", "plant.location.longitude", "plant.location.timezone", "plant.location.altitude_m",
        "plant.total_capacity_kwp", "plant.total_surface_m2",
        F.coalesce(total, F.lit(0)).alias("total_inverters"),
        F.col("plant.grid_connection.voltage_nominal_v").alias("grid_voltage_nominal_v"),
        F.col("plant.grid_connection.frequency_nominal_hz").alias("grid_frequency_nominal_hz"),
        F.col("plant.grid_connection.phases").alias("grid_phases"),
        F.col("plant.commissioning_date").try_cast("date").alias("commissioning_date"),
        F.col("version").alias("config_version"),
    )


def inverter_assets(configs: DataFrame) -> DataFrame:
    """One row per inverter id of every group, with the plant's inverter data."""
    groups = configs.select("*", F.explode("inverter_groups").alias("g"))
    ids = groups.select("*", F.explode("g.inverter_ids").alias("asset_id"))
    spec = F.col("inverter_specs")
    dc, ac, eff, heat = spec["dc_side"], spec["ac_side"], spec["efficiency"], spec["thermal"]
    span = eff["system_efficiency_range"]
    return ids.select(
        F.col("plant.plant_id").alias("plant_id"), "asset_id", F.lit("inverter").alias("asset_type"),
        F.col("g.group_id").alias("asset_group"),
        spec["nominal_capacity_kw"].alias("nominal_capacity_kw"), spec["panel_surface_m2"].alias("panel_surface_m2"),
        dc["voltage_mpp_min_v"].alias("dc_voltage_mpp_min_v"), dc["voltage_mpp_max_v"].alias("dc_voltage_mpp_max_v"),
        dc["voltage_nominal_v"].alias("dc_voltage_nominal_v"), dc["current_max_a"].alias("dc_current_max_a"),
        dc["strings_count"].alias("strings_count"), dc["panels_per_string"].alias("panels_per_string"),
        dc["panel_wp"].alias("panel_wp"),
        ac["voltage_nominal_v"].alias("ac_voltage_nominal_v"), ac["frequency_nominal_hz"].alias("ac_frequency_nominal_hz"),
        ac["power_factor_nominal"].alias("power_factor_nominal"),
        eff["dc_ac_nominal"].alias("efficiency_dc_ac_nominal"),
        eff["dc_ac_min_acceptable"].alias("efficiency_dc_ac_min_acceptable"),
        F.coalesce(F.get(span, F.lit(0)), F.lit(0.88)).alias("efficiency_system_min"),
        F.coalesce(F.get(span, F.lit(1)), F.lit(0.92)).alias("efficiency_system_max"),
        heat["temp_coefficient_power_pct_per_c"].alias("temp_coefficient_pct_per_c"),
        heat["stc_temperature_c"].alias("stc_temperature_c"), heat["max_operating_temp_c"].alias("max_operating_temp_c"),
        F.lit(True).alias("is_active"), F.col("plant.commissioning_date").try_cast("date").alias("commissioned_date"),
    )


def station_assets(configs: DataFrame) -> DataFrame:
    """The grid meter and the weather station of every plant."""
    meter, power = F.col("poi_meter_specs"), F.col("poi_meter_specs.power_capacity")
    started = F.col("plant.commissioning_date").try_cast("date").alias("commissioned_date")
    plant = F.col("plant.plant_id").alias("plant_id")
    meters = configs.select(
        plant, F.coalesce(meter["meter_id"], F.lit("POI_METER_01")).alias("asset_id"), F.lit("poi_meter").alias("asset_type"),
        power["max_export_kw"].alias("nominal_capacity_kw"), meter["grid_voltage"]["nominal_v"].alias("ac_voltage_nominal_v"),
        F.lit(50.0).alias("ac_frequency_nominal_hz"),
        power["max_export_kw"].alias("max_export_kw"), power["max_import_kw"].alias("max_import_kw"),
        meter["meter_type"].alias("meter_type"), F.lit(True).alias("is_active"), started,
    )
    stations = configs.select(
        plant, F.coalesce(F.col("meteo_station_specs.station_id"), F.lit("METEO_01")).alias("asset_id"),
        F.lit("meteo_station").alias("asset_type"), F.lit(True).alias("is_active"), started,
    )
    return meters.unionByName(stations, allowMissingColumns=True)


def dim_asset(configs: DataFrame) -> DataFrame:
    return inverter_assets(configs).unionByName(station_assets(configs), allowMissingColumns=True)


def dim_thresholds(configs: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """One row per threshold; one without a note has severity ``info``."""
    if notes is None:
        # a fixed table of a dozen rows, so broadcasting it is bounded
        notes = F.broadcast(configs.sparkSession.createDataFrame(
            THRESHOLD_NOTES,
            "threshold_category string, threshold_name string, threshold_unit string, severity string, description string",
        ))
    rows = (
        configs.select(F.col("plant.plant_id").alias("plant_id"), F.explode("thresholds").alias("threshold_category", "items"))
        .select("plant_id", "threshold_category", F.explode("items").alias("threshold_name", "threshold_value"))
    )
    return rows.join(notes, ["threshold_category", "threshold_name"], "left").select(
        "plant_id", "threshold_category", "threshold_name", "threshold_value", "threshold_unit",
        F.coalesce("severity", F.lit("info")).alias("severity"), "description",
    )


def string_specs(assets: DataFrame) -> DataFrame:
    """Current and power of one string of an inverter."""
    return assets.withColumns(
        {
            "current_per_string_a": F.try_divide("dc_current_max_a", "strings_count"),
            "power_per_string_kw": F.col("panels_per_string") * F.col("panel_wp") / 1000,
        }
    )


def capacity_of(dim: DataFrame) -> DataFrame:
    """Plant and installed peak power, for the plant indicators."""
    return dim.select("plant_id", F.col("total_capacity_kwp").alias("capacity_kwp"))


def group_of(inverter_id: Column, groups: Column) -> Column:
    """Group of an inverter id inside an ``inverter_groups`` array; NULL when unknown."""
    hit = F.filter(groups, lambda g: F.array_contains(g["inverter_ids"], inverter_id))
    return F.get(hit, F.lit(0))["group_id"]
