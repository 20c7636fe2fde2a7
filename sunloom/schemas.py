"""Message schemas, table keys and stored column types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("inverter", "meteo", "poi_meter", "system_status")

#: topic names of the four feeds
TOPICS = {
    "inverter": "inverter",
    "meteo": "on_site_meteo_station",
    "poi_meter": "poi_meter",
    "system_status": "system_status",
}

#: measures of each feed in their JSON spelling; every leaf is read as text first,
#: so one odd value costs that value and not the row
MEASURES = {
    "inverter": {
        "state": "int", "inverter_temp_C": "double", "ac_power_kW": "double", "ac_freq_Hz": "double",
        "dc_power_kW": "double", "dc_voltage_V": "double", "dc_current_A": "double",
        "healthy_strings": "int", "failed_strings": "int", "active_failures": "int",
    },
    "meteo": {
        "amb_temp_C": "double", "module_temp_C": "double", "wind_speed_ms": "double",
        "wind_dir_deg": "double", "humidity_percent": "double", "poa_irradiance_wm2": "double",
    },
    "poi_meter": {
        "export_active_power_kW": "double", "import_active_power_kW": "double", "reactive_power_kVAr": "double",
        "grid_voltage_l1_V": "double", "grid_voltage_l2_V": "double", "grid_voltage_l3_V": "double",
        "grid_frequency_Hz": "double", "power_factor": "double", "active_failures": "int",
    },
}


def _text_struct(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def message_schema(kind: str) -> T.StructType:
    """The JSON layout of one feed, with text leaves."""
    if kind == "system_status":
        return T.StructType(
            [
                *_text_struct(["guid", "timestamp"]).fields,
                T.StructField("system_impact", _text_struct(["total_failures", "stress_level", "affected_components", "critical_failures"])),
                T.StructField("component_status", _text_struct(["total", "healthy", "failed"])),
            ]
        )
    head = ["guid", "inverter_id", "timestamp"] if kind == "inverter" else ["guid", "timestamp"]
    extra = {"inverter": ["failure_types"], "poi_meter": ["connection_issues"]}.get(kind, [])
    return _text_struct([*head, *MEASURES[kind], *extra])


#: natural key of each silver and gold table
KEYS = {
    "silver_inverter": ["plant_id", "inverter_id", "ts"],
    "silver_meteo": ["plant_id", "ts"],
    "silver_poi_meter": ["plant_id", "ts"],
    "silver_system_status": ["plant_id", "ts"],
    "inverter_hourly": ["plant_id", "inverter_id", "timestamp_hour"],
    "inverter_daily": ["plant_id", "inverter_id", "date"],
    "meteo_hourly": ["plant_id", "timestamp_hour"],
    "meteo_daily": ["plant_id", "date"],
    "poi_hourly": ["plant_id", "timestamp_hour"],
    "poi_daily": ["plant_id", "date"],
    "status_hourly": ["plant_id", "timestamp_hour"],
    "status_daily": ["plant_id", "date"],
    "plant_hourly_summary": ["plant_id", "timestamp_hour"],
    "plant_daily_summary": ["plant_id", "date"],
    "failure_daily_summary": ["plant_id", "date", "component_type", "component_id"],
    "anomaly_predictions": ["plant_id", "inverter_id", "ts", "model_run_id"],
    "forecast_predictions": ["plant_id", "inverter_id", "ts", "model_run_id"],
    "inference_watermark": ["plant_id", "inverter_id", "inference_mode"],
    "dim_plant_config": ["plant_id"],
    "dim_asset": ["plant_id", "asset_id"],
    "dim_thresholds": ["plant_id", "threshold_category", "threshold_name"],
}

# Stored precision by column name.
STORED_PRECISION = {
    "decimal(10,3)": "ac_power_kw dc_power_kw avg_power_kw max_power_kw min_power_kw peak_power_kw predicted_ac_power_kw irradiation_wh_m2",
    "decimal(10,2)": "inverter_temp_c ac_freq_hz freq_avg_hz freq_min_hz freq_max_hz poa_irradiance_wm2 avg_irradiance_wm2 peak_irradiance_wm2 "
    "total_downtime_minutes mean_time_between_failures_hours mean_time_to_repair_minutes",
    "decimal(8,2)": "dc_voltage_v dc_current_a avg_dc_voltage_v avg_dc_current_a grid_voltage_l1_v grid_voltage_l2_v grid_voltage_l3_v "
    "wind_speed_ms wind_speed_avg_ms wind_speed_max_ms voltage_l1_avg_v voltage_l2_avg_v voltage_l3_avg_v "
    "avg_failures avg_healthy_components avg_failed_components",
    "decimal(6,2)": "amb_temp_c module_temp_c wind_dir_deg wind_dir_avg_deg predominant_wind_dir_deg temp_avg_c temp_min_c temp_max_c "
    "module_temp_avg_c module_temp_min_c module_temp_max_c avg_ambient_temp_c avg_module_temp_c",
    "decimal(5,2)": "humidity_percent humidity_avg_percent humidity_min_percent humidity_max_percent availability_percent operating_hours "
    "connection_issue_hours voltage_imbalance_pct sunshine_hours plant_availability_percent inverter_availability_avg data_completeness_percent",
    "decimal(6,3)": "grid_frequency_hz frequency_avg_hz frequency_min_hz frequency_max_hz",
    "decimal(5,3)": "power_factor power_factor_avg power_factor_min power_factor_max stress_level stress_level_avg stress_level_max "
    "stress_level_min system_stress_avg",
    "decimal(5,4)": "instant_efficiency avg_efficiency min_efficiency self_consumption_ratio performance_ratio instantaneous_pr capacity_factor temp_loss_factor",
    "decimal(12,2)": "export_active_power_kw import_active_power_kw reactive_power_kvar avg_export_kw max_export_kw avg_import_kw max_import_kw "
    "peak_export_kw peak_import_kw avg_reactive_kvar total_surface_m2",
    "decimal(12,3)": "total_energy_kwh dc_energy_kwh estimated_energy_loss_kwh total_power_kw import_kw total_capacity_kwp",
    "decimal(12,4)": "export_energy_kwh import_energy_kwh reactive_kvarh threshold_value",
    "decimal(14,3)": "total_export_kwh total_import_kwh total_reactive_kvarh",
    "decimal(10,4)": "energy_kwh total_irradiation_kwh_m2",
    "decimal(8,4)": "specific_yield_kwh_kwp",
    "decimal(10,6)": "latitude longitude",
    "decimal(12,6)": "reconstruction_error threshold",
}
PLANT_ENERGY = "total_generation_kwh total_consumption_kwh net_energy_kwh self_consumption_kwh grid_export_kwh grid_import_kwh"
TABLE_PRECISION = {"plant_hourly_summary": {"decimal(12,4)": PLANT_ENERGY}, "plant_daily_summary": {"decimal(14,3)": PLANT_ENERGY}}


def stored_types(table: str) -> dict[str, str]:
    """Stored type of every measure a table may have."""
    groups = [*STORED_PRECISION.items(), *TABLE_PRECISION.get(table, {}).items()]
    return {c: t for t, names in groups for c in names.split()}


def storage_cast(df: DataFrame, table: str) -> DataFrame:
    """Round measures to the stored precision; a value that does not fit becomes NULL."""
    casts = {c: F.col(c).try_cast(t) for c, t in stored_types(table).items() if c in df.columns}
    return df.withColumns(casts) if casts else df


def computing(df: DataFrame) -> DataFrame:
    """Stored decimals as doubles, the type all measures are computed in."""
    casts = {c: F.col(c).cast("double") for c, t in df.dtypes if t.startswith("decimal")}
    return df.withColumns(casts) if casts else df
