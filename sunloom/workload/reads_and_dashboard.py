"""Queries: range reads, latest values, dashboard data, alerts, set operations."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import functions as F

from sunloom.functions.quality import availability_tier
from sunloom.functions.temporal import format_kpi
from sunloom.operators import dashboard as d
from sunloom.operators import reads, splits
from sunloom.workload.quality_and_gold import FLOATS, INTS, NAMES, columns_of, dates_of, shown
from sunloom.workload.registry import query

FROM, TO = "2024-01-08", "2024-01-21"

# ---- range reads ------------------------------------------------------------------

_RANGES = {
    "inverter_hourly_range": ("inverter_h", {"plant_id": "P1", "inverter_id": "B1"}),
    "meteo_hourly_range": ("meteo_h", {"plant_id": "P0"}),
    "poi_hourly_range": ("poi_h", {}),
    "status_hourly_range": ("status_h", {"plant_id": "P1"}),
    "plant_hourly_range": ("plant_h", {"plant_id": "P0"}),
    "inverter_daily_range": ("inverter_d", {"plant_id": "P0"}),
    "meteo_daily_range": ("meteo_d", {}),
    "poi_daily_range": ("poi_d", {"plant_id": "P1"}),
    "status_daily_range": ("status_d", {}),
    "plant_daily_range": ("plant_d", {"plant_id": "P1"}),
}

for _name, (_rel, _match) in _RANGES.items():
    _time = "timestamp_hour" if _rel.endswith("_h") else "date"
    _where = f"{_time} between {'timestamp' if _rel.endswith('_h') else 'date'} '{FROM}' and {'timestamp' if _rel.endswith('_h') else 'date'} '{TO}'"
    _where += "".join(f" and {k} = '{v}'" for k, v in _match.items())

    @query(_name, f"select {', '.join(columns_of(_rel))} from {_rel} where {_where}", _rel, FLOATS[_rel], INTS[_rel], dates_of(_rel))
    def _(r, rel=_rel, time=_time, match=_match):
        return reads.newest_first(reads.in_range(shown(r, rel), time, FROM, TO, **match), time, *columns_of(rel)[:1])


@query(
    "failure_daily_range",
    f"select * from failure_d where date between '{FROM}' and '{TO}' and plant_id = 'P0' and component_type = 'inverter'", "failure_d",
    "total_downtime_minutes estimated_energy_loss_kwh mean_time_between_failures_hours mean_time_to_repair_minutes", "failure_count critical_failure_count",
)
def _(r):
    rows = r.failure_d.withColumn("failure_types", F.array_join("failure_types", "|"))
    return reads.in_range(rows, "date", FROM, TO, "P0", component_type="inverter")


@query(
    "anomaly_range",
    f"""select plant_id, inverter_id, ts, model_run_id, reconstruction_error, threshold, is_anomaly from anomalies
 where ts between timestamp '{FROM}' and timestamp '{TO}' and plant_id = 'P1'""", "anomalies", "reconstruction_error threshold", "is_anomaly",
)
def _(r):
    return reads.in_range(r.anomalies, "ts", FROM, TO, "P1").drop("id")


@query(
    "forecast_range",
    f"""select plant_id, inverter_id, ts, model_run_id, predicted_ac_power_kw from forecasts
 where ts between timestamp '{FROM}' and timestamp '{TO}' and plant_id = 'P0' and inverter_id = 'A2'""", "forecasts", "predicted_ac_power_kw",
)
def _(r):
    return reads.in_range(r.forecasts, "ts", FROM, TO, "P0", "A2").drop("id")


@query(
    "incremental_rows",
    """select i.id, i.plant_id, i.inverter_id, i.ts from inverter_s i left join (select plant_id, inverter_id, max(ts) as last_ts from anomalies
  where model_run_id <> 'run-0' and ts < timestamp '2024-01-15' and inverter_id <> 'C5' group by plant_id, inverter_id) w
 on w.plant_id = i.plant_id and w.inverter_id = i.inverter_id where w.last_ts is null or i.ts > w.last_ts""",
    "inverter_s anomalies",
)
def _(r):
    scored = r.anomalies.filter(
        (F.col("model_run_id") != "run-0") & (F.col("ts") < F.lit("2024-01-15").cast("timestamp")) & (F.col("inverter_id") != "C5")
    )
    marks = reads.advanced_watermark(scored)
    return reads.since_watermark(r.inverter_s.select("id", "plant_id", "inverter_id", "ts"), marks, ["plant_id", "inverter_id"])


@query("last_two_days", "select id, ts, ac_power_kw from inverter where ts >= (select max(ts) from inverter) - interval 2 days", "inverter", "ac_power_kw")
def _(r):
    return reads.latest_span(r.inverter.select("id", "ts", "ac_power_kw"), "ts", "2 days")


@query("latest_timestamp", "select max(ts) as latest_ts from meteo_s where plant_id = 'P1'", "meteo_s")
def _(r):
    return reads.latest_timestamp(r.meteo_s, "ts", "P1")


@query("distinct_plants", "select distinct plant_id from plant_h", "plant_h")
def _(r):
    return reads.distinct_values(r.plant_h, "plant_id")


@query("distinct_inverters", "select distinct inverter_id from inverter_s where plant_id = 'P1'", "inverter_s")
def _(r):
    return reads.distinct_values(r.inverter_s, "inverter_id", "P1")


@query(
    "hours_with_data",
    "select distinct date_trunc('hour', ts) as hour from inverter_s where plant_id = 'P0' and ts >= timestamp '2024-01-12' and ts < timestamp '2024-01-13'",
    "inverter_s",
)
def _(r):
    return reads.hours_with_data(r.inverter_s, "P0", "2024-01-12")


@query(
    "distinct_plants_union", "select plant_id from inverter_s union select plant_id from meteo_s union select plant_id from poi_s", "inverter_s meteo_s poi_s",
)
def _(r):
    return reads.distinct_plants(r.inverter_s, r.meteo_s, r.poi_s)


@query(
    "rows_by_id",
    """select id, ts, data_quality_flag from inverter_s where id in (select failure_id from failures where severity = 'CRITICAL')""", "inverter_s failures",
)
def _(r):
    ids = r.failures.filter("severity = 'CRITICAL'").select(F.col("failure_id").alias("id"))
    return reads.rows_by_id(r.inverter_s.select("id", "ts", "data_quality_flag"), ids)


@query(
    "telemetry_weather_exact",
    """select i.id, i.plant_id, i.inverter_id, i.ts, i.ac_power_kw, m.amb_temp_c, m.poa_irradiance_wm2 from inverter_s i
 left join meteo_s m on m.plant_id = i.plant_id and m.ts = i.ts""", "inverter_s meteo_s", "ac_power_kw amb_temp_c poa_irradiance_wm2",
)
def _(r):
    telemetry = r.inverter_s.select("id", "plant_id", "inverter_id", "ts", "ac_power_kw")
    return reads.with_weather(telemetry, r.meteo_s.select("plant_id", "ts", "amb_temp_c", "poa_irradiance_wm2"))


_BUNDLE = [
    ("plant_summary", "plant_h", "timestamp_hour"), ("inverters", "inverter_h", "timestamp_hour"), ("meteo", "meteo_h", "timestamp_hour"),
    ("poi", "poi_h", "timestamp_hour"), ("status", "status_h", "timestamp_hour"), ("anomaly_predictions", "anomalies", "ts"),
]
_edge = "(select max(timestamp_hour) from plant_h where plant_id = 'P0')"
_parts = [
    f"select '{n}' as source, count(*) as rows, min({t}) as first_ts, max({t}) as last_ts from {rel} where plant_id = 'P0' and {t} between {_edge} - interval 48 hours and {_edge}"
    for n, rel, t in _BUNDLE
]
_parts.append(
    f"select 'forecast_predictions', count(*), min(ts), max(ts) from forecasts where plant_id = 'P0' and ts between {_edge} - interval 48 hours and {_edge} + interval 72 hours"
)


@query("lookback_bundle", " union all ".join(_parts), " ".join(rel for _, rel, _t in _BUNDLE) + " forecasts")
def _(r):
    frames = reads.lookback(
        {n: (getattr(r, rel), t) for n, rel, t in _BUNDLE}, "plant_summary", 48, "P0", {"forecast_predictions": (r.forecasts, "ts", 72)}
    )
    times = {**{n: t for n, _, t in _BUNDLE}, "forecast_predictions": "ts"}
    parts = [
        df.agg(F.lit(n).alias("source"), F.count(F.lit(1)).alias("rows"), F.min(times[n]).alias("first_ts"), F.max(times[n]).alias("last_ts"))
        for n, df in frames.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "latest_anomalies",
    "select plant_id, inverter_id, ts, reconstruction_error from anomalies where is_anomaly = 1 and plant_id = 'P0' order by ts desc, plant_id, inverter_id limit 20",
    "anomalies", "reconstruction_error",
)
def _(r):
    return reads.latest_anomalies(r.anomalies, "P0").select("plant_id", "inverter_id", "ts", "reconstruction_error")


@query(
    "oldest_new_records",
    "select id, plant_id, ts from poi where active_failures = 0 order by ts, id limit 100", "poi",
)
def _(r):
    return r.poi.filter("active_failures = 0").orderBy("ts", "id").limit(100).select("id", "plant_id", "ts")


# ---- dashboard --------------------------------------------------------------------

QUARTER = "time_bucket(interval 15 minutes, ts)"


@query(
    "forecast_15min",
    f"select {QUARTER} as ts, plant_id, inverter_id, avg(predicted_ac_power_kw) as predicted_ac_power_kw from forecasts group by all", "forecasts", "predicted_ac_power_kw",
)
def _(r):
    return d.forecast_15min(r.forecasts)


@query("forecast_plant_sum", "select plant_id, ts, sum(predicted_ac_power_kw) as forecast_kw from forecasts group by all", "forecasts", "forecast_kw")
def _(r):
    return d.forecast_plant_sum(r.forecasts)


PAIRS = """select p.plant_id, p.timestamp_hour, p.total_power_kw as actual_kw, f.forecast_kw, f.forecast_kw - p.total_power_kw as error_kw from plant_h p
 join (select plant_id, ts, sum(predicted_ac_power_kw) as forecast_kw from forecasts group by all) f
 on f.plant_id = p.plant_id and date_trunc('hour', f.ts) = p.timestamp_hour"""


@query("forecast_vs_actual", PAIRS, "plant_h forecasts", "actual_kw forecast_kw error_kw")
def _(r):
    return d.forecast_vs_actual(r.plant_h, r.forecasts)


@query(
    "dashboard_mape",
    f"""select plant_id, case when sum(actual_kw) > 0 then avg(abs(error_kw) / case when actual_kw = 0 then 1 else actual_kw end) * 100 end as mape, count(*) as pairs
 from ({PAIRS}) group by plant_id""", "plant_h forecasts", "mape",
)
def _(r):
    return d.dashboard_mape(d.forecast_vs_actual(r.plant_h, r.forecasts))


_days = [f"2024-01-{i:02d}" for i in range(1, 31)]
_pivot = ", ".join(f"avg(reconstruction_error) filter (where cast(ts as date) = date '{x}') as d_{x.replace('-', '_')}" for x in _days)


@query("anomaly_pivot", f"select plant_id, inverter_id, {_pivot} from anomalies group by plant_id, inverter_id", "anomalies", " ".join(f"d_{x.replace('-', '_')}" for x in _days))
def _(r):
    return d.anomaly_heatmap(r.anomalies, datetime(2024, 1, 1), 30)


@query(
    "kpi_delta",
    """select plant_id, timestamp_hour, total_power_kw as current_kw, prev as previous_kw, (total_power_kw - prev) / nullif(prev, 0) * 100 as delta_percent from
 (select *, lag(total_power_kw) over (partition by plant_id order by timestamp_hour) as prev,
   row_number() over (partition by plant_id order by timestamp_hour desc) as n from plant_h) where n = 1""",
    "plant_h", "current_kw previous_kw delta_percent",
)
def _(r):
    return d.kpi_delta(r.plant_h)


@query(
    "kpi_row",
    """select e.plant_id, e.total_energy_kwh, l.instantaneous_pr, l.active_inverters, l.total_inverters, coalesce(a.alerts, 0) as alerts from
 (select plant_id, sum(total_generation_kwh) as total_energy_kwh, max(timestamp_hour) as t from plant_h group by plant_id) e
 join plant_h l on l.plant_id = e.plant_id and l.timestamp_hour = e.t
 left join (select plant_id, count(*) as alerts from anomalies where is_anomaly = 1 group by plant_id) a on a.plant_id = e.plant_id""",
    "plant_h anomalies", "total_energy_kwh instantaneous_pr", decimals=4,
)
def _(r):
    return d.kpi_row(r.plant_h, r.anomalies)


@query(
    "format_kpi",
    """select id, case when x is null then 'N/A' when abs(x) >= 1e6 then concat(printf('%.1f', x / 1000), 'M kWh') else concat(printf('%.1f', x), ' kWh') end as label
 from (select id, ac_power_kw * 5e3 as x from inverter)""", "inverter",
)
def _(r):
    return r.inverter.select("id", format_kpi(F.col("ac_power_kw") * 5e3, " kWh").alias("label"))


_last = "arg_max({c}, timestamp_hour) filter (where {c} is not null) as {c}"
_cols = ["energy_kwh", "avg_power_kw", "temp_avg_c", "freq_avg_hz", "availability_percent"]
_latest = f"select plant_id, inverter_id, max(timestamp_hour) as timestamp_hour, {', '.join(_last.format(c=c) for c in _cols)} from inverter_h group by plant_id, inverter_id"


@query("latest_per_inverter", _latest, "inverter_h", " ".join(_cols))
def _(r):
    return d.latest_per_inverter(r.inverter_h.select("plant_id", "inverter_id", "timestamp_hour", *_cols))


@query(
    "availability_tier",
    f"""select plant_id, inverter_id, timestamp_hour, availability_percent, case when availability_percent >= 90 then 'good' when availability_percent >= 70 then 'medium'
 else 'low' end as tier from ({_latest})""", "inverter_h", "availability_percent",
)
def _(r):
    return d.availability_by_tier(r.inverter_h)


@query(
    "availability_tier_by_day",
    "select plant_id, date, case when v >= 90 then 'good' when v >= 70 then 'medium' else 'low' end as tier from (select plant_id, date, avg(availability_percent) as v from inverter_d group by all)",
    "inverter_d", dates="date",
)
def _(r):
    days = r.inverter_d.groupBy("plant_id", "date").agg(F.avg("availability_percent").alias("v"))
    return days.select("plant_id", "date", availability_tier("v").alias("tier"))


ALERTS = f"""select plant_id, ts, inverter_id as source, 'Anomaly' as type, concat('Reconstruction error: ', printf('%.4f', reconstruction_error)) as message
  from anomalies where is_anomaly = 1
 union all select plant_id, timestamp_hour, inverter_id, 'Availability', concat('Low availability: ', printf('%.1f', availability_percent), '%')
  from ({_latest}) where availability_percent < 80"""


def all_alerts(r):
    return d.alerts(r.anomalies.filter("is_anomaly = 1"), r.inverter_h)


@query("alerts_union", ALERTS, "anomalies inverter_h")
def _(r):
    return all_alerts(r)


@query("alerts_top10", f"select *, strftime(ts, '%H:%M') as clock from ({ALERTS}) order by ts desc, source, type, message limit 10", "anomalies inverter_h")
def _(r):
    return d.newest_alerts(all_alerts(r))


_hits = [
    ("temp_warning_c", "inverter_temp_c", ">"), ("temp_critical_c", "inverter_temp_c", ">"), ("efficiency_alert_min", "instant_efficiency", "<"),
    ("efficiency_warning_min", "instant_efficiency", "<"), ("freq_deviation_warning_hz", "abs(ac_freq_hz - 50)", ">"),
    ("freq_deviation_critical_hz", "abs(ac_freq_hz - 50)", ">"),
]


@query(
    "threshold_alerts",
    " union all ".join(
        f"select i.plant_id, inverter_id, ts, '{n}' as alert, {v} as value, {n} as \"limit\", '{n.rsplit('_', 2)[1]}' as severity from inverter_s i join thresholds t on t.plant_id = i.plant_id where {v} {op} {n}"
        for n, v, op in _hits
    ),
    "inverter_s thresholds", 'value "limit"',
)
def _(r):
    return d.threshold_alerts(r.inverter_s, r.thresholds)


_feeds = {
    "inverter_s": (
        "inverter_id",
        [(n, "inverter", {"inverter_temp_c": "temperature", "instant_efficiency": "efficiency"}.get(v, "frequency_deviation"), v, op, n) for n, v, op in _hits if "efficiency" not in n]
        + [(n, "inverter", "efficiency", "case when ac_power_kw >= 50 then instant_efficiency end", "<", n) for n in ("efficiency_alert_min", "efficiency_warning_min")]
        + [
            ("string_current_imbalance_pct", "dc_diagnostics", "string_loss_pct", "failed_strings * 100e0 / nullif(healthy_strings + failed_strings, 0)", ">", "10e0"),
            ("voltage_deviation_pct", "dc_diagnostics", "dc_voltage_deviation_pct", "abs(dc_voltage_v - 1100e0) / 1100e0 * 100", ">", "5e0"),
        ],
    ),
    "poi_s": (
        "'poi_meter'",
        [(f"voltage_deviation_{n}_pct", "poi_meter", "grid_voltage_deviation_pct", "greatest(" + ", ".join(f"abs(grid_voltage_l{i}_v - 400e0) / 400e0 * 100" for i in (1, 2, 3)) + ")", ">", limit) for n, limit in (("warning", "5e0"), ("critical", "10e0"))]
        + [(f"power_factor_{n}_min", "poi_meter", "power_factor", "power_factor", "<", limit) for n, limit in (("warning", "0.9e0"), ("critical", "0.87e0"))],
    ),
}
# values of the limits that the derived thresholds do not hold
_more = [
    ("dc_diagnostics", "string_current_imbalance_pct", 10.0, "warning"), ("dc_diagnostics", "voltage_deviation_pct", 5.0, "warning"),
    ("dc_diagnostics", "min_power_for_efficiency_calc_kw", 50.0, "info"), ("poi_meter", "voltage_deviation_warning_pct", 5.0, "warning"),
    ("poi_meter", "voltage_deviation_critical_pct", 10.0, "critical"), ("poi_meter", "power_factor_warning_min", 0.9, "warning"),
    ("poi_meter", "power_factor_critical_min", 0.87, "critical"),
]


@query(
    "limit_alerts",
    " union all ".join(
        f"""select r.plant_id, {source} as source, ts, '{category}' as category, '{name}' as alert, '{measure}' as measure, {value} as value, {limit} as "limit",
 '{ {n: s for _, n, _, s in _more}.get(name) or name.rsplit('_', 2)[1] }' as severity from {table} r join thresholds t on t.plant_id = r.plant_id where {value} {op} {limit}"""
        for table, (source, rules) in _feeds.items() for name, category, measure, value, op, limit in rules
    ),
    "inverter_s poi_s thresholds", 'value "limit"',
)
def _(r):
    more = F.inline(F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(row, ("threshold_category", "threshold_name", "threshold_value", "severity"), strict=True))) for row in _more)))
    limits = r.thresholds.unionByName(r.thresholds.select("plant_id").distinct().select("plant_id", more))
    return d.limit_alerts({"inverter": r.inverter_s, "poi_meter": r.poi_s}, limits, 1100.0, 400.0)


@query(
    "tagged_union",
    """select id, ts, 'train' as split from inverter where ts < timestamp '2024-01-25' union all select id, ts, 'test' from inverter where ts >= timestamp '2024-01-25'""",
    "inverter",
)
def _(r):
    rows, cut = r.inverter.select("id", "ts"), F.lit("2024-01-25").cast("timestamp")
    return splits.tagged_union(rows.filter(F.col("ts") < cut), rows.filter(F.col("ts") >= cut))
