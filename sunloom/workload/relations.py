"""Telemetry derived from the ``events`` table, as Spark frames and as SQL.

The test data holds no photovoltaic readings. Inverter, weather, grid, status,
failure and prediction rows are computed from every event by arithmetic both
engines share.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.functions.quality import clean, healthy_only
from sunloom.operators import failures as fl
from sunloom.operators import gold, profile, timeseries

EVENTS = [
    "event_id", "ts", "user_id", "event_type", "value", "cast(regexp_extract(props, '[0-9]+', 0) as int) as k",
]
PLACE = [
    "concat('P', cast(event_id % 2 as string)) as plant_id",
    "substr('A0A1A2A3B0B1B2B3C0C1C2C3C4C5', cast(1 + 2 * (user_id % 14) as int), 2) as inverter_id",
]
PLANT = PLACE[:1]
FAILURE_TYPE = """case when event_type <> 'error' then '' when k % 3 = 0 then 'grid_disturbance'
 when k % 3 = 1 then 'inverter_overheating' else 'string_failure' end as failure_type"""

INVERTER = [
    "event_id as id", *PLACE, "ts",
    "case when event_type = 'error' then 0 else 1 end as state",
    "case when k = 37 then null else k * 1.1e0 end as inverter_temp_c",
    "case when k = 7 then null when k = 13 then -value when k = 17 then value * 10 else value end as ac_power_kw",
    "case when k = 41 then null when k = 43 then 40e0 when k = 47 then 70e0 else 49.5e0 + (k % 10) / 1e1 end as ac_freq_hz",
    "case when k = 23 then null when k = 29 then -value else value / (0.905e0 + (k % 10) / 1e2) end as dc_power_kw",
    "600e0 + k * 10 as dc_voltage_v",
    "case when k = 31 then -1e0 else value end as dc_current_a",
    "12 - (case when event_type = 'error' and k % 2 = 0 then 1 + k % 3 else 0 end) as healthy_strings",
    "case when event_type = 'error' and k % 2 = 0 then 1 + k % 3 else 0 end as failed_strings",
    "case when k = 53 then null when event_type = 'error' then 1 + k % 2 else 0 end as active_failures",
    FAILURE_TYPE,
]
METEO = [
    "event_id as id", *PLANT, "ts",
    "case when k = 3 then -60e0 else k - 20e0 end as amb_temp_c",
    "k * 1.2e0 - 10e0 as module_temp_c",
    "case when k = 5 then -1e0 else k * 1.05e0 end as wind_speed_ms",
    "(k * 37) % 360 + 0e0 as wind_dir_deg",
    "case when k = 9 then -1e0 else k * 1.05e0 end as humidity_percent",
    "case when k = 15 then -1e0 when k = 21 then null else value * 5 end as poa_irradiance_wm2",
]
POI = [
    "event_id as id", *PLANT, "ts",
    "case when k % 5 = 0 then 0e0 when k = 11 then -1e0 else value end as export_active_power_kw",
    "case when k % 5 = 0 or k = 19 then value when k = 12 then -1e0 else 0e0 end as import_active_power_kw",
    "value * 0.1e0 as reactive_power_kvar",
    "case when k = 22 then 290e0 else 355e0 + k % 40 end as grid_voltage_l1_v",
    "case when k = 24 then 510e0 else 380e0 + k % 37 end as grid_voltage_l2_v",
    "case when k = 26 then 299e0 else 380e0 + k % 31 end as grid_voltage_l3_v",
    "case when k = 28 then 48.5e0 else 49.45e0 + (k % 12) / 1e1 end as grid_frequency_hz",
    "case when k = 33 then 1.2e0 else 0.85e0 + (k % 15) / 1e2 end as power_factor",
    "case when k % 9 = 0 then 1 else 0 end as active_failures",
    "(k % 11 = 0) as connection_issues",
]
STATUS = [
    "event_id as id", *PLANT, "ts",
    "k % 4 as total_failures",
    "case when k = 1 then -0.1e0 else k * 0.0111e0 end as stress_level",
    "k % 3 as affected_components",
    "case when k % 10 = 0 then 1 else 0 end as critical_failures",
    "16 as total_components", "16 - k % 4 as healthy_components", "k % 4 as failed_components",
]
FAILURES = [
    "event_id as failure_id", *PLACE, "ts as start_ts", "ts + interval '1' minute * (5 + k) as end_ts",
    "case k % 4 when 0 then 'LOW' when 1 then 'MEDIUM' when 2 then 'HIGH' else 'CRITICAL' end as severity",
    FAILURE_TYPE,
]
PREDICTIONS = [
    "event_id as id", *PLACE, "ts", "value as actual", "value * (0.9e0 + (k % 20) / 1e2) as predicted",
    "k % 2 as y_true", "case when k % 3 = 0 then 1 else 0 end as y_pred",
    "value * (k % 20) / 1e2 as reconstruction_error",
    "concat('run-', cast(k % 3 as string)) as model_run_id",
    "case when user_id % 3 = 2 then 'RUNNING' else 'FINISHED' end as status",
]


def chosen(columns: list[str], source: str = "e", where: str = "") -> str:
    return "select " + ",\n ".join(columns) + f" from {source}" + (f" where {where}" if where else "")


def flagged(source: str, issues: list[tuple[str, str]], anomaly: str, extra: str = "") -> str:
    text = ", ".join(f"case when {test} then '{name}' end" for name, test in issues)
    return f"""select *, case when q_ = '' then 'valid' else q_ end as data_quality_flag,
 coalesce({anomaly}, false) as anomaly_flag{extra} from (select *, concat_ws(',', {text}) as q_ from {source})"""


def any_of(*tests: str) -> str:
    return "(" + " or ".join(f"coalesce({t}, false)" for t in tests) + ")"


_inv = [
    ("negative_power", "ac_power_kw < 0"), ("excessive_power", "ac_power_kw > 1000"), ("negative_dc_power", "dc_power_kw < 0"),
    ("dc_voltage_out_of_range", "dc_voltage_v < 0 or dc_voltage_v > 1500"), ("negative_dc_current", "dc_current_a < 0"),
    ("temp_out_of_range", "inverter_temp_c < -40 or inverter_temp_c > 100"),
    ("freq_out_of_range", "(ac_freq_hz < 45 or ac_freq_hz > 65) and ac_power_kw > 0"),
]
_poi = [
    ("negative_export", "export_active_power_kw < 0"), ("negative_import", "import_active_power_kw < 0"),
    ("simultaneous_export_import", "export_active_power_kw > 0 and import_active_power_kw > 0"),
    *[(f"l{i}_voltage_out_of_range", f"grid_voltage_l{i}_v < 300 or grid_voltage_l{i}_v > 500") for i in (1, 2, 3)],
    ("frequency_deviation", "grid_frequency_hz < 49 or grid_frequency_hz > 51"),
    ("pf_out_of_range", "power_factor < 0 or power_factor > 1"),
]
_met = [
    ("amb_temp_out_of_range", "amb_temp_c < -50 or amb_temp_c > 60"), ("module_temp_out_of_range", "module_temp_c < -50 or module_temp_c > 100"),
    ("humidity_out_of_range", "humidity_percent < 0 or humidity_percent > 100"),
    ("irradiance_out_of_range", "poa_irradiance_wm2 < 0 or poa_irradiance_wm2 > 1500"), ("wind_out_of_range", "wind_speed_ms < 0 or wind_speed_ms > 100"),
]
_sta = [
    ("stress_out_of_range", "stress_level < 0 or stress_level > 1"), ("high_stress", "stress_level > 0.7"),
    ("failures_present", "total_failures > 0"), ("critical_failures_present", "critical_failures > 0"),
]

HOURLY = "date_trunc('hour', ts) as timestamp_hour"
COUNTED = "count(*) as record_count, count(*) filter (where data_quality_flag = 'valid') as valid_record_count"

CLEAR_SKY = """case when cz > 0 then 1000 * exp(-0.1 * (1 / cz - 1)) else 0.0 end"""


def cos_zenith(ts: str, lat: float, lon: float) -> str:
    b = f"radians(360.0 * (dayofyear({ts}) - 81) / 365)"
    eot = f"(9.87 * sin(2 * {b}) - 7.53 * cos({b}) - 1.5 * sin({b}))"
    minutes = f"(hour({ts}) * 60 + minute({ts}) + floor(second({ts})) / 60.0)"
    dec = f"radians(23.45e0 * sin(radians(360.0 / 365 * (284 + dayofyear({ts})))))"
    angle = f"radians(15 * (({minutes} + {eot} + {4 * lon}) / 60 - 12))"
    return f"(sin(radians({lat}e0)) * sin({dec}) + cos(radians({lat}e0)) * cos({dec}) * cos({angle}))"


SQL: dict[str, str] = {
    "e": chosen(EVENTS, "events"),
    "inverter": chosen(INVERTER),
    "meteo": chosen(METEO, where="event_type = 'view'"),
    "poi": chosen(POI, where="event_type = 'purchase'"),
    "status": chosen(STATUS, where="event_type = 'signup'"),
    "failures": chosen([*FAILURES, "substr('A0A1A2A3B0B1B2B3C0C1C2C3C4C5', cast(1 + 2 * (user_id % 14) as int), 2) as component_id"], where="event_type = 'error'"),
    "pred": chosen(PREDICTIONS),
    "inverter_s": flagged(
        "inverter",
        [("missing_power", "ac_power_kw is null"), ("missing_temp", "inverter_temp_c is null"), ("missing_timestamp", "ts is null"), *_inv],
        any_of(*[t for _, t in _inv], "failed_strings > 0", "active_failures > 0"),
        """, case when dc_power_kw > 0 and ac_power_kw <> 0 then ac_power_kw / dc_power_kw end as instant_efficiency,
 case when dc_power_kw > 0 and ac_power_kw <> 0 and ac_power_kw / dc_power_kw < 0.93e0 then 'alert'
  when dc_power_kw > 0 and ac_power_kw <> 0 and ac_power_kw / dc_power_kw < 0.95e0 then 'warning' else 'normal' end as efficiency_flag""",
    ),
    "meteo_s": flagged("meteo", _met, any_of(*[t for _, t in _met])),
    "poi_s": flagged("poi", _poi, any_of(*[t for _, t in _poi], "connection_issues", "active_failures > 0")),
    "status_s": flagged("status", _sta, any_of(*[t for _, t in _sta[1:]])),
    "inverter_h": f"""select plant_id, inverter_id, {HOURLY}, sum(coalesce(ac_power_kw, 0)) / 60.0 as energy_kwh,
 avg(ac_power_kw) as avg_power_kw, min(ac_power_kw) as min_power_kw, max(ac_power_kw) as max_power_kw,
 avg(inverter_temp_c) as temp_avg_c, min(inverter_temp_c) as temp_min_c, max(inverter_temp_c) as temp_max_c,
 avg(ac_freq_hz) as freq_avg_hz, count(*) filter (where state = 1) / count(*) * 100 as availability_percent,
 count(*) filter (where state = 1) as operating_minutes, sum(coalesce(active_failures, 0)) as failure_count,
 coalesce(array_to_string(list_sort(list(distinct failure_type) filter (where failure_type <> '')), '|'), '') as failure_types,
 sum(coalesce(dc_power_kw, 0)) / 60.0 as dc_energy_kwh, avg(dc_voltage_v) as avg_dc_voltage_v, avg(dc_current_a) as avg_dc_current_a,
 avg(instant_efficiency) as avg_efficiency, min(instant_efficiency) as min_efficiency,
 count(*) filter (where efficiency_flag <> 'normal') as efficiency_below_threshold_minutes,
 count(*) filter (where failed_strings > 0) as string_failure_events, {COUNTED}
 from inverter_s group by plant_id, inverter_id, date_trunc('hour', ts)""",
    "inverter_d": """select plant_id, inverter_id, cast(timestamp_hour as date) as date, sum(energy_kwh) as total_energy_kwh,
 max(max_power_kw) as peak_power_kw, avg(avg_power_kw) as avg_power_kw, min(min_power_kw) as min_power_kw,
 avg(temp_avg_c) as temp_avg_c, min(temp_min_c) as temp_min_c, max(temp_max_c) as temp_max_c,
 avg(freq_avg_hz) as freq_avg_hz, min(freq_avg_hz) as freq_min_hz, max(freq_avg_hz) as freq_max_hz,
 avg(availability_percent) as availability_percent, sum(operating_minutes) / 60.0 as operating_hours,
 sum(record_count) as total_records, sum(valid_record_count) as valid_records, sum(failure_count) as total_failures,
 coalesce(string_agg(failure_types, ';' order by timestamp_hour) filter (where failure_types <> ''), '') as failure_types_summary,
 sum(dc_energy_kwh) as dc_energy_kwh, avg(avg_dc_voltage_v) as avg_dc_voltage_v, avg(avg_dc_current_a) as avg_dc_current_a,
 avg(avg_efficiency) as avg_efficiency, min(min_efficiency) as min_efficiency,
 sum(efficiency_below_threshold_minutes) as efficiency_below_threshold_minutes, sum(string_failure_events) as string_failure_events
 from inverter_h group by plant_id, inverter_id, cast(timestamp_hour as date)""",
    "meteo_h": f"""select plant_id, {HOURLY}, avg(amb_temp_c) as temp_avg_c, min(amb_temp_c) as temp_min_c, max(amb_temp_c) as temp_max_c,
 avg(module_temp_c) as module_temp_avg_c, min(module_temp_c) as module_temp_min_c, max(module_temp_c) as module_temp_max_c,
 avg(humidity_percent) as humidity_avg_percent, min(humidity_percent) as humidity_min_percent, max(humidity_percent) as humidity_max_percent,
 avg(wind_speed_ms) as wind_speed_avg_ms, max(wind_speed_ms) as wind_speed_max_ms, avg(wind_dir_deg) as wind_dir_avg_deg,
 sum(coalesce(poa_irradiance_wm2, 0)) / 60.0 as irradiation_wh_m2, avg(poa_irradiance_wm2) as avg_irradiance_wm2,
 max(poa_irradiance_wm2) as peak_irradiance_wm2, {COUNTED}
 from meteo_s group by plant_id, date_trunc('hour', ts)""",
    "meteo_d": """select plant_id, cast(timestamp_hour as date) as date, avg(temp_avg_c) as temp_avg_c, min(temp_min_c) as temp_min_c,
 max(temp_max_c) as temp_max_c, avg(module_temp_avg_c) as module_temp_avg_c, min(module_temp_min_c) as module_temp_min_c,
 max(module_temp_max_c) as module_temp_max_c, avg(humidity_avg_percent) as humidity_avg_percent,
 min(humidity_min_percent) as humidity_min_percent, max(humidity_max_percent) as humidity_max_percent,
 avg(wind_speed_avg_ms) as wind_speed_avg_ms, max(wind_speed_max_ms) as wind_speed_max_ms, avg(wind_dir_avg_deg) as predominant_wind_dir_deg,
 sum(irradiation_wh_m2) / 1000.0 as total_irradiation_kwh_m2, max(peak_irradiance_wm2) as peak_irradiance_wm2,
 avg(avg_irradiance_wm2) as avg_irradiance_wm2, count(*) filter (where avg_irradiance_wm2 > 120) as sunshine_hours,
 sum(record_count) as total_records, sum(valid_record_count) as valid_records
 from meteo_h group by plant_id, cast(timestamp_hour as date)""",
    "poi_h": f"""select plant_id, {HOURLY}, sum(coalesce(export_active_power_kw, 0)) / 60.0 as export_energy_kwh,
 sum(coalesce(import_active_power_kw, 0)) / 60.0 as import_energy_kwh, sum(coalesce(reactive_power_kvar, 0)) / 60.0 as reactive_kvarh,
 avg(nullif(export_active_power_kw, 0)) as avg_export_kw, max(export_active_power_kw) as max_export_kw,
 avg(nullif(import_active_power_kw, 0)) as avg_import_kw, max(import_active_power_kw) as max_import_kw,
 avg(reactive_power_kvar) as avg_reactive_kvar, avg(grid_voltage_l1_v) as voltage_l1_avg_v, avg(grid_voltage_l2_v) as voltage_l2_avg_v,
 avg(grid_voltage_l3_v) as voltage_l3_avg_v,
 stddev_samp(grid_voltage_l1_v + grid_voltage_l2_v + grid_voltage_l3_v)
  / nullif(avg(grid_voltage_l1_v + grid_voltage_l2_v + grid_voltage_l3_v), 0) * 100 as voltage_imbalance_pct,
 avg(grid_frequency_hz) as frequency_avg_hz, min(grid_frequency_hz) as frequency_min_hz, max(grid_frequency_hz) as frequency_max_hz,
 count(*) filter (where grid_frequency_hz < 49.5e0 or grid_frequency_hz > 50.5e0) as frequency_deviation_count,
 avg(power_factor) as power_factor_avg, min(power_factor) as power_factor_min,
 count(*) filter (where not connection_issues) / count(*) * 100 as availability_percent,
 count(*) filter (where connection_issues) as connection_issue_minutes, sum(coalesce(active_failures, 0)) as failure_count, {COUNTED}
 from poi_s group by plant_id, date_trunc('hour', ts)""",
    "poi_d": """select plant_id, cast(timestamp_hour as date) as date, sum(export_energy_kwh) as total_export_kwh,
 sum(import_energy_kwh) as total_import_kwh, max(max_export_kw) as peak_export_kw, max(max_import_kw) as peak_import_kw,
 avg(avg_export_kw) as avg_export_kw, avg(avg_import_kw) as avg_import_kw, sum(reactive_kvarh) as total_reactive_kvarh,
 avg(avg_reactive_kvar) as avg_reactive_kvar, avg(voltage_l1_avg_v) as voltage_l1_avg_v, avg(voltage_l2_avg_v) as voltage_l2_avg_v,
 avg(voltage_l3_avg_v) as voltage_l3_avg_v, avg(voltage_imbalance_pct) as voltage_imbalance_pct,
 count(*) filter (where voltage_l1_avg_v < 360 or voltage_l1_avg_v > 440) as voltage_deviation_minutes,
 avg(frequency_avg_hz) as frequency_avg_hz, min(frequency_min_hz) as frequency_min_hz, max(frequency_max_hz) as frequency_max_hz,
 sum(frequency_deviation_count) as frequency_deviation_minutes, avg(power_factor_avg) as power_factor_avg,
 min(power_factor_min) as power_factor_min, max(power_factor_avg) as power_factor_max, avg(availability_percent) as availability_percent,
 sum(connection_issue_minutes) / 60.0 as connection_issue_hours, sum(failure_count) as total_failures,
 sum(record_count) as total_records, sum(valid_record_count) as valid_records
 from poi_h group by plant_id, cast(timestamp_hour as date)""",
    "status_h": f"""select plant_id, {HOURLY}, sum(total_failures) as total_failures, max(total_failures) as max_concurrent_failures,
 avg(total_failures) as avg_failures, avg(stress_level) as stress_level_avg, min(stress_level) as stress_level_min,
 max(stress_level) as stress_level_max, avg(healthy_components) as avg_healthy_components, min(healthy_components) as min_healthy_components,
 avg(failed_components) as avg_failed_components, max(failed_components) as max_failed_components,
 sum(critical_failures) as critical_failure_count, max(critical_failures) as max_concurrent_critical, {COUNTED}
 from status_s group by plant_id, date_trunc('hour', ts)""",
    "status_d": """select plant_id, cast(timestamp_hour as date) as date, sum(total_failures) as total_failures_sum,
 max(max_concurrent_failures) as max_concurrent_failures, avg(avg_failures) as avg_failures, avg(stress_level_avg) as stress_level_avg,
 max(stress_level_max) as stress_level_max, min(stress_level_min) as stress_level_min, avg(avg_healthy_components) as avg_healthy_components,
 min(min_healthy_components) as min_healthy_components, avg(avg_failed_components) as avg_failed_components,
 max(max_failed_components) as max_failed_components, sum(critical_failure_count) as total_critical_failures,
 max(max_concurrent_critical) as max_concurrent_critical, sum(record_count) as total_records, sum(valid_record_count) as valid_records
 from status_h group by plant_id, cast(timestamp_hour as date)""",
    "plant_h": """select inv.plant_id, inv.timestamp_hour, gen as total_generation_kwh, coalesce(import_energy_kwh, 0) as total_consumption_kwh,
 gen - coalesce(import_energy_kwh, 0) as net_energy_kwh, least(gen, coalesce(import_energy_kwh, 0)) as self_consumption_kwh,
 coalesce(export_energy_kwh, 0) as grid_export_kwh, coalesce(import_energy_kwh, 0) as grid_import_kwh, power as total_power_kw,
 coalesce(avg_import_kw, 0) as import_kw, coalesce(irradiation_wh_m2, 0) as irradiation_wh_m2,
 coalesce(avg_irradiance_wm2, 0) as avg_irradiance_wm2,
 case when irradiation_wh_m2 > 0 then least(1.0e0, gen / (irradiation_wh_m2 / 1000.0 * 1260)) end as instantaneous_pr,
 temp_avg_c as avg_ambient_temp_c, module_temp_avg_c as avg_module_temp_c, active as active_inverters, total as total_inverters,
 failures as failure_count, coalesce(stress, 0) as system_stress_avg, active / total * 100 as data_completeness_percent
 from (select plant_id, timestamp_hour, sum(energy_kwh) as gen, sum(avg_power_kw) as power,
   count(*) filter (where energy_kwh > 0) as active, count(*) as total, sum(failure_count) as failures
   from inverter_h group by plant_id, timestamp_hour) inv
 left join meteo_h m on m.plant_id = inv.plant_id and m.timestamp_hour = inv.timestamp_hour
 left join poi_h p on p.plant_id = inv.plant_id and p.timestamp_hour = inv.timestamp_hour
 left join (select plant_id, date_trunc('hour', ts) as timestamp_hour, avg(stress_level) as stress from status_s group by all) s
  on s.plant_id = inv.plant_id and s.timestamp_hour = inv.timestamp_hour""",
    "plant_d": """select inv.plant_id, inv.date, gen as total_generation_kwh, coalesce(total_import_kwh, 0) as total_consumption_kwh,
 gen - coalesce(total_import_kwh, 0) as net_energy_kwh, least(gen, coalesce(total_import_kwh, 0)) as self_consumption_kwh,
 case when gen > 0 then least(gen, coalesce(total_import_kwh, 0)) / gen else 0 end as self_consumption_ratio,
 coalesce(total_export_kwh, 0) as grid_export_kwh, coalesce(total_import_kwh, 0) as grid_import_kwh,
 coalesce(total_irradiation_kwh_m2, 0) as total_irradiation_kwh_m2, coalesce(sunshine_hours, 0) as sunshine_hours,
 gen / 1260 as specific_yield_kwh_kwp,
 case when total_irradiation_kwh_m2 > 0 then least(1.0e0, gen / (total_irradiation_kwh_m2 * 1260)) end as performance_ratio,
 gen / (1260 * 24.0) as capacity_factor, m.temp_avg_c as avg_ambient_temp_c, m.module_temp_avg_c as avg_module_temp_c,
 1 + (m.module_temp_avg_c - 25) * (-0.004e0) as temp_loss_factor, coalesce(p.availability_percent, 100) as plant_availability_percent,
 avail as inverter_availability_avg, coalesce(total_failures_sum, 0) + failures as total_failures,
 coalesce(total_critical_failures, 0) as critical_failures, failures as inverter_failures,
 coalesce(s.stress_level_avg, 0) as system_stress_avg, active as active_inverters, total as total_inverters,
 active / total * 100 as data_completeness_percent
 from (select plant_id, date, sum(total_energy_kwh) as gen, avg(availability_percent) as avail,
   count(*) filter (where total_energy_kwh > 0) as active, count(*) as total, sum(total_failures) as failures
   from inverter_d group by plant_id, date) inv
 left join meteo_d m on m.plant_id = inv.plant_id and m.date = inv.date
 left join poi_d p on p.plant_id = inv.plant_id and p.date = inv.date
 left join status_d s on s.plant_id = inv.plant_id and s.date = inv.date""",
    "anomalies": """select id, plant_id, inverter_id, ts, model_run_id, reconstruction_error, 5e0 as threshold,
 case when reconstruction_error > 5 then 1 else 0 end as is_anomaly from pred""",
    "forecasts": "select id, plant_id, inverter_id, ts, model_run_id, predicted as predicted_ac_power_kw from pred",
    "series_h": """select k.plant_id, k.inverter_id, k.ts, last_value(m.v ignore nulls) over (partition by k.plant_id, k.inverter_id order by k.ts
   rows between unbounded preceding and current row) as power
 from (select plant_id, inverter_id, unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), interval 1 hour)) as ts
   from inverter where active_failures = 0 group by plant_id, inverter_id) k
 left join (select plant_id, inverter_id, date_trunc('hour', ts) as ts, avg(ac_power_kw) as v from inverter where active_failures = 0 group by all) m
  on m.plant_id = k.plant_id and m.inverter_id = k.inverter_id and m.ts = k.ts""",
    "episodes": """select plant_id, inverter_id, min(ts) as start_ts, max(coalesce(next_ts, ts)) as end_ts from (
   select *, sum(case when bad and not coalesce(prev_bad, false) then 1 else 0 end) over (partition by plant_id, inverter_id order by ts) as run
   from (select plant_id, inverter_id, ts, coalesce(active_failures, 0) > 0 as bad,
     lag(coalesce(active_failures, 0) > 0) over w as prev_bad, lead(ts) over w as next_ts
     from inverter_s window w as (partition by plant_id, inverter_id order by ts)))
 where bad group by plant_id, inverter_id, run""",
    "thresholds": """select plant_id, max(inverter_temp_c) * 0.5e0 as temp_warning_c, max(inverter_temp_c) * 0.9e0 as temp_critical_c,
 0.93e0 as efficiency_alert_min, 0.95e0 as efficiency_warning_min, 0.25e0 as freq_deviation_warning_hz, 9.5e0 as freq_deviation_critical_hz
 from inverter_s group by plant_id""",
    "gaps": """select gap_seconds, count(*) as occurrences from (select round_even((epoch_us(ts) - lag(epoch_us(ts))
   over (partition by plant_id, inverter_id order by ts)) / 1e6, 0) as gap_seconds from inverter)
 where gap_seconds is not null group by gap_seconds""",
}
SQL["failure_d"] = f"""select d.plant_id, cast(d.date as varchar) as date, 'inverter' as component_type, d.inverter_id as component_id,
 coalesce(t.n, 0) as failure_count, coalesce(r.critical, 0) as critical_failure_count, coalesce(r.kinds, '') as failure_types,
 d.down as total_downtime_minutes, coalesce(r.lost, 0) as estimated_energy_loss_kwh,
 t.mtbf as mean_time_between_failures_hours, t.mttr as mean_time_to_repair_minutes
from (select plant_id, inverter_id, date, sum((epoch_us(least(end_ts, date + interval 1 day)) - epoch_us(greatest(start_ts, date + interval 0 day))) / 6e7) as down
   from (select *, cast(unnest(generate_series(date_trunc('day', start_ts), date_trunc('day', end_ts), interval 1 day)) as date) as date from episodes) group by all) d
 left join (select plant_id, inverter_id, cast(ts as date) as date, count(*) filter (where state <> 1) as critical,
   sum(greatest(({CLEAR_SKY}) / 1000 * 90 - coalesce(ac_power_kw, 0), 0)) / 60 as lost,
   coalesce(array_to_string(list_sort(list(distinct failure_type) filter (where failure_type <> '')), '|'), '') as kinds
   from (select *, {cos_zenith('ts', 40.4168, -3.7038)} as cz from inverter_s where active_failures > 0)
   group by plant_id, inverter_id, cast(ts as date)) r
  on r.plant_id = d.plant_id and r.inverter_id = d.inverter_id and r.date = d.date
 left join (select plant_id, inverter_id, cast(start_ts as date) as date, count(*) as n,
   avg((epoch_us(end_ts) - epoch_us(start_ts)) / 6e7) as mttr, avg(between_h) as mtbf
   from (select *, (epoch_us(start_ts) - lag(epoch_us(start_ts)) over (partition by plant_id, inverter_id order by start_ts)) / 3.6e9 as between_h
     from episodes) group by plant_id, inverter_id, cast(start_ts as date)) t
  on t.plant_id = d.plant_id and t.inverter_id = d.inverter_id and t.date = d.date"""

INVERTER_KEY = ["plant_id", "inverter_id"]


class Relations:
    """Frames over one data folder, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        # times are UTC instants in every table
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def e(self) -> DataFrame:
        return self.table("events").selectExpr(*EVENTS)

    def _of(self, columns: list[str], kind: str | None = None) -> DataFrame:
        df = self.e if kind is None else self.e.filter(F.col("event_type") == kind)
        out = df.selectExpr(*columns)
        return out.withColumns({c: F.col(c).cast("timestamp") for c, t in out.dtypes if t == "timestamp_ntz"})

    @cached_property
    def inverter(self) -> DataFrame:
        listed = F.when(F.col("failure_type") == "", F.array().cast("array<string>")).otherwise(F.array("failure_type"))
        return self._of(INVERTER).withColumn("failure_types", listed)

    @cached_property
    def meteo(self) -> DataFrame:
        return self._of(METEO, "view")

    @cached_property
    def poi(self) -> DataFrame:
        return self._of(POI, "purchase")

    @cached_property
    def status(self) -> DataFrame:
        return self._of(STATUS, "signup")

    @cached_property
    def failures(self) -> DataFrame:
        return self._of(FAILURES, "error").withColumnRenamed("inverter_id", "component_id")

    @cached_property
    def pred(self) -> DataFrame:
        return self._of(PREDICTIONS)

    @cached_property
    def inverter_s(self) -> DataFrame:
        return clean(self.inverter, "inverter")

    @cached_property
    def meteo_s(self) -> DataFrame:
        return clean(self.meteo, "meteo")

    @cached_property
    def poi_s(self) -> DataFrame:
        return clean(self.poi, "poi_meter")

    @cached_property
    def status_s(self) -> DataFrame:
        return clean(self.status, "system_status")

    @cached_property
    def inverter_h(self) -> DataFrame:
        return gold.inverter_hourly(self.inverter_s, extended=True)

    @cached_property
    def inverter_d(self) -> DataFrame:
        return gold.inverter_daily(self.inverter_h, extended=True)

    @cached_property
    def meteo_h(self) -> DataFrame:
        return gold.meteo_hourly(self.meteo_s)

    @cached_property
    def meteo_d(self) -> DataFrame:
        return gold.meteo_daily(self.meteo_h)

    @cached_property
    def poi_h(self) -> DataFrame:
        return gold.poi_hourly(self.poi_s)

    @cached_property
    def poi_d(self) -> DataFrame:
        return gold.poi_daily(self.poi_h)

    @cached_property
    def status_h(self) -> DataFrame:
        return gold.status_hourly(self.status_s)

    @cached_property
    def status_d(self) -> DataFrame:
        return gold.status_daily(self.status_h)

    @cached_property
    def plant_h(self) -> DataFrame:
        return gold.plant_hourly_summary(self.inverter_h, self.meteo_h, self.poi_h, self.status_s)

    @cached_property
    def plant_d(self) -> DataFrame:
        return gold.plant_daily_summary(self.inverter_d, self.meteo_d, self.poi_d, self.status_d)

    @cached_property
    def anomalies(self) -> DataFrame:
        return self.pred.select(
            "id", *INVERTER_KEY, "ts", "model_run_id", "reconstruction_error", F.lit(5.0).alias("threshold"),
            (F.col("reconstruction_error") > 5).cast("int").alias("is_anomaly"),
        )

    @cached_property
    def forecasts(self) -> DataFrame:
        return self.pred.select("id", *INVERTER_KEY, "ts", "model_run_id", F.col("predicted").alias("predicted_ac_power_kw"))

    @cached_property
    def series_h(self) -> DataFrame:
        filled = timeseries.resample_fill(healthy_only(self.inverter), INVERTER_KEY, "ac_power_kw")
        return filled.withColumnRenamed("ac_power_kw", "power")

    @cached_property
    def failure_d(self) -> DataFrame:
        return fl.failure_daily_summary(self.inverter_s)

    @cached_property
    def gaps(self) -> DataFrame:
        return profile.gap_counts(self.inverter, INVERTER_KEY)

    @cached_property
    def thresholds(self) -> DataFrame:
        top = F.max("inverter_temp_c")
        limits = {
            "temp_warning_c": top * 0.5, "temp_critical_c": top * 0.9, "efficiency_alert_min": F.lit(0.93),
            "efficiency_warning_min": F.lit(0.95), "freq_deviation_warning_hz": F.lit(0.25), "freq_deviation_critical_hz": F.lit(9.5),
        }
        rows = F.array(*[
            F.struct(F.lit(n).alias("threshold_name"), c.alias("threshold_value"), F.lit(n.rsplit("_", 2)[1]).alias("severity"))
            for n, c in limits.items()
        ])
        listed = self.inverter_s.groupBy("plant_id").agg(rows.alias("t"))
        return listed.select("plant_id", F.lit("inverter").alias("threshold_category"), F.explode("t").alias("t")).select("plant_id", "threshold_category", "t.*")
