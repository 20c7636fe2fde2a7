"""Queries: messages to bronze, validation, clean-up, gold tables, key discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.functions import quality as q
from sunloom.operators import gold
from sunloom.sources import messages, tables
from sunloom.workload.registry import query
from sunloom.workload.relations import Relations

# ---- messages -------------------------------------------------------------

MESSAGE = """
case when event_type = 'click' then to_json(named_struct('guid', concat('P', event_id % 2), 'inverter_id', concat('I', user_id % 14),
   'timestamp', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), 'state', if(k < 50, '1.0', '0'), 'ac_power_kW', value,
   'inverter_temp_C', if(k = 37, 'hot', cast(k * 1.1D as string)), 'healthy_strings', k % 13, 'failure_types', if(k % 2 = 0, array('a', 'b'), array())))
 when event_type = 'view' then to_json(named_struct('guid', concat('P', event_id % 2), 'timestamp', if(k = 3, 'yesterday', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+01:00'")),
   'amb_temp_C', k - 20D, 'poa_irradiance_wm2', value * 5))
 when event_type = 'purchase' then to_json(named_struct('guid', if(k = 9, null, concat('P', event_id % 2)), 'timestamp', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
   'export_active_power_kW', value, 'connection_issues', case when k % 4 = 0 then 'true' when k % 4 = 1 then 'false' when k % 4 = 2 then '0' end))
 when event_type = 'signup' then concat('{"guid":"P', event_id % 2, '","timestamp":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
   '","system_impact":{"total_failures":', k % 4, ',"stress_level":', k * 0.0111D, ',"affected_components":',
   case k % 4 when 0 then '[]' when 1 then '["inverter_A0"]' when 2 then '["inverter_A0","poi"]' else '"none"' end,
   ',"critical_failures":null},"component_status":{"total":16,"healthy":', 16 - k % 4, ',"failed":', k % 4, '}}')
 when k < 30 then concat('not json ', k) when k < 60 then '{"foo":1}'
 when k < 80 then '{"inverter_id":null,"amb_temp_C":1}' else '[1,2]' end"""


def routed(r: Relations) -> DataFrame:
    e = r.e.withColumn("ts", F.col("ts").cast("timestamp"))
    return messages.route(e.select("event_id", F.expr(MESSAGE).alias("value")))


KIND = """case when event_type = 'click' then 'inverter' when event_type = 'view' then 'meteo' when event_type = 'purchase' then 'poi_meter'
 when event_type = 'signup' then 'system_status' when k < 30 then null when k < 60 then 'unknown' when k < 80 then 'inverter' end"""


@query("route_message_type", f"select event_id, {KIND} as message_type from e", "e")
def _(r):
    return routed(r).select("event_id", "message_type")


def bronze(r: Relations, kind: str) -> DataFrame:
    return messages.bronze(routed(r).filter(F.col("message_type") == kind), kind)


@query(
    "bronze_projection",
    """select event_id, concat('P', event_id % 2) as plant_id, concat('I', user_id % 14) as inverter_id, date_trunc('second', ts) as ts,
 case when k < 50 then 1 else 0 end as state, case when k <> 37 then k * 1.1e0 end as inverter_temp_c, value as ac_power_kw,
 k % 13 as healthy_strings, case when k % 2 = 0 then 'a+b' else '' end as failure_types from e where event_type = 'click'
 union all select event_id, null, null, null, null, null, null, null, '' from e where event_type = 'error' and k between 60 and 79""",
    "e", "inverter_temp_c ac_power_kw", "state healthy_strings",
)
def _(r):
    cols = ["event_id", "plant_id", "inverter_id", "ts", "state", "inverter_temp_c", "ac_power_kw", "healthy_strings"]
    return bronze(r, "inverter").select(*cols, F.array_join("failure_types", "+").alias("failure_types"))


@query(
    "status_flatten",
    """select event_id, concat('P', event_id % 2) as plant_id, date_trunc('second', ts) as ts, k % 4 as total_failures, k * 0.0111e0 as stress_level,
 case k % 4 when 1 then 1 when 2 then 2 else 0 end as affected_components, cast(null as bigint) as critical_failures,
 16 as total_components, 16 - k % 4 as healthy_components, k % 4 as failed_components from e where event_type = 'signup'""",
    "e", "stress_level", "total_failures affected_components critical_failures total_components healthy_components failed_components",
)
def _(r):
    return bronze(r, "system_status").drop("raw_json")


@query(
    "poi_truth",
    """select event_id, value as export_active_power_kw, k % 4 = 0 as connection_issues from e where event_type = 'purchase'""",
    "e", "export_active_power_kw",
)
def _(r):
    return bronze(r, "poi_meter").select("event_id", "export_active_power_kw", "connection_issues")


def checked(r: Relations) -> DataFrame:
    """Bronze rows of all kinds with the reason for a rejection."""
    parts = []
    for kind in ("inverter", "meteo", "poi_meter", "system_status"):
        reason = messages.rejection(kind, uuid_plants=False).alias("error_message")
        parts.append(bronze(r, kind).select("event_id", F.lit(kind).alias("message_type"), reason))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


REASONS = """select event_id, 'inverter' as message_type, case when event_type = 'error' then 'plant_id missing' end as error_message from e
  where event_type = 'click' or (event_type = 'error' and k between 60 and 79)
 union all select event_id, 'meteo', case when k = 3 then 'timestamp missing or unreadable' end from e where event_type = 'view'
 union all select event_id, 'poi_meter', case when k = 9 then 'plant_id missing' end from e where event_type = 'purchase'
 union all select event_id, 'system_status', null from e where event_type = 'signup'"""


@query("bronze_required", REASONS, "e")
def _(r):
    return checked(r)


@query(
    "batch_outcome",
    f"""select message_type, count(*) filter (where error_message is null) as processed, count(*) filter (where error_message is not null) as failed
 from ({REASONS}) group by message_type""",
    "e",
)
def _(r):
    return tables.batch_outcome(checked(r))


@query(
    "trigger_counts",
    f"""select 'silver_batch_processed' as event, kind as data_type, count(*) as count from (select {KIND} as kind from e)
 where kind in ('inverter', 'meteo') group by kind""",
    "e",
)
def _(r):
    return tables.trigger_counts(routed(r))


# ---- validation -------------------------------------------------------------

for _name, _rel in (("inverter", "inverter_s"), ("poi", "poi_s"), ("meteo", "meteo_s"), ("status", "status_s")):

    @query(f"validate_{_name}", f"select id, plant_id, ts, data_quality_flag, anomaly_flag from {_rel}", _rel)
    def _(r, rel=_rel):
        return getattr(r, rel).select("id", "plant_id", "ts", "data_quality_flag", "anomaly_flag")


@query("efficiency_flag", "select id, instant_efficiency, efficiency_flag from inverter_s", "inverter_s", "instant_efficiency")
def _(r):
    return r.inverter_s.select("id", "instant_efficiency", "efficiency_flag")


@query("healthy_only", "select id, inverter_id, ts, ac_power_kw from inverter where active_failures = 0", "inverter", "ac_power_kw")
def _(r):
    return q.healthy_only(r.inverter.select("id", "inverter_id", "ts", "ac_power_kw", "active_failures"))


_REQUIRED = ["ac_power_kw", "dc_power_kw", "inverter_temp_c"]


@query(
    "required_not_null",
    """select inverter_id, count(*) as rows, count(*) filter (where bad) as removed, count(*) filter (where not bad) as kept from
 (select inverter_id, ac_power_kw is null or dc_power_kw is null or inverter_temp_c is null as bad from inverter) group by inverter_id""",
    "inverter",
)
def _(r):
    return q.null_row_counts(r.inverter, _REQUIRED, ["inverter_id"])


_COMMA = """case when k = 3 then ' ' when k = 5 then 'n/a' when k = 8 then concat(' ', replace(cast(value as {t}), '.', ','), ' ')
 else replace(cast(value as {t}), '.', ',') end"""


@query("decimal_comma", "select event_id, case when k not in (3, 5) then value end as number from e", "e", "number")
def _(r):
    return r.e.select("event_id", q.decimal_comma(F.expr(_COMMA.format(t="string"))).alias("number"))


@query("blank_to_null", "select event_id, case when k >= 10 then event_type end as label from e", "e")
def _(r):
    text = F.expr("case when k < 5 then '' when k < 10 then ' \t ' else event_type end")
    return r.e.select("event_id", q.blank_to_null(text).alias("label"))


@query("finite_or_null", "select event_id, case when k >= 15 then value end as x, case when k >= 15 then value else 0 end as filled from e", "e", "x filled")
def _(r):
    raw = F.expr("case when k < 5 then double('NaN') when k < 10 then double('Infinity') when k < 15 then double('-Infinity') else value end")
    x = q.finite_or_null(raw)
    return r.e.select("event_id", x.alias("x"), F.coalesce(x, F.lit(0.0)).alias("filled"))


@query("clip_nonneg", "select id, case when ac_power_kw < 0 then 0 else ac_power_kw end as power from inverter", "inverter", "power")
def _(r):
    return r.inverter.select("id", q.clip_nonneg("ac_power_kw").alias("power"))


@query("anomaly_label", "select id, case when coalesce(active_failures, 0) > 0 then 1 else 0 end as is_anomaly from inverter", "inverter", ints="is_anomaly")
def _(r):
    return r.inverter.select("id", q.anomaly_label().alias("is_anomaly"))


# ---- gold ---------------------------------------------------------------------

INVERTER_H = "energy_kwh avg_power_kw max_power_kw min_power_kw temp_avg_c temp_min_c temp_max_c freq_avg_hz availability_percent"
INVERTER_D = (
    "total_energy_kwh peak_power_kw avg_power_kw min_power_kw temp_avg_c temp_min_c temp_max_c freq_avg_hz freq_min_hz freq_max_hz "
    "availability_percent operating_hours"
)
METEO_H = (
    "temp_avg_c temp_min_c temp_max_c module_temp_avg_c module_temp_min_c module_temp_max_c humidity_avg_percent humidity_min_percent "
    "humidity_max_percent wind_speed_avg_ms wind_speed_max_ms wind_dir_avg_deg irradiation_wh_m2 avg_irradiance_wm2 peak_irradiance_wm2"
)
METEO_D = (
    "temp_avg_c temp_min_c temp_max_c module_temp_avg_c module_temp_min_c module_temp_max_c humidity_avg_percent humidity_min_percent "
    "humidity_max_percent wind_speed_avg_ms wind_speed_max_ms predominant_wind_dir_deg total_irradiation_kwh_m2 peak_irradiance_wm2 avg_irradiance_wm2"
)
POI_H = (
    "export_energy_kwh import_energy_kwh reactive_kvarh avg_export_kw max_export_kw avg_import_kw max_import_kw avg_reactive_kvar "
    "voltage_l1_avg_v voltage_l2_avg_v voltage_l3_avg_v voltage_imbalance_pct frequency_avg_hz frequency_min_hz frequency_max_hz "
    "power_factor_avg power_factor_min availability_percent"
)
POI_D = (
    "total_export_kwh total_import_kwh peak_export_kw peak_import_kw avg_export_kw avg_import_kw total_reactive_kvarh avg_reactive_kvar "
    "voltage_l1_avg_v voltage_l2_avg_v voltage_l3_avg_v voltage_imbalance_pct frequency_avg_hz frequency_min_hz frequency_max_hz "
    "power_factor_avg power_factor_min power_factor_max availability_percent connection_issue_hours"
)
STATUS_H = "avg_failures stress_level_avg stress_level_min stress_level_max avg_healthy_components avg_failed_components"
STATUS_D = STATUS_H
PLANT_H = (
    "total_generation_kwh total_consumption_kwh net_energy_kwh self_consumption_kwh grid_export_kwh grid_import_kwh total_power_kw import_kw "
    "irradiation_wh_m2 avg_irradiance_wm2 instantaneous_pr avg_ambient_temp_c avg_module_temp_c system_stress_avg data_completeness_percent"
)
PLANT_D = (
    "total_generation_kwh total_consumption_kwh net_energy_kwh self_consumption_kwh self_consumption_ratio grid_export_kwh grid_import_kwh "
    "total_irradiation_kwh_m2 specific_yield_kwh_kwp performance_ratio capacity_factor avg_ambient_temp_c avg_module_temp_c temp_loss_factor "
    "plant_availability_percent inverter_availability_avg system_stress_avg data_completeness_percent"
)
COUNTS_H, COUNTS_D = "record_count valid_record_count", "total_records valid_records"
INTS = {
    "inverter_h": f"operating_minutes failure_count {COUNTS_H}",
    "inverter_d": f"{COUNTS_D} total_failures",
    "meteo_h": COUNTS_H, "meteo_d": f"sunshine_hours {COUNTS_D}",
    "poi_h": f"frequency_deviation_count connection_issue_minutes failure_count {COUNTS_H}",
    "poi_d": f"voltage_deviation_minutes frequency_deviation_minutes total_failures {COUNTS_D}",
    "status_h": f"total_failures max_concurrent_failures min_healthy_components max_failed_components critical_failure_count max_concurrent_critical {COUNTS_H}",
    "status_d": f"total_failures_sum max_concurrent_failures min_healthy_components max_failed_components total_critical_failures max_concurrent_critical {COUNTS_D}",
    "plant_h": "active_inverters total_inverters failure_count",
    "plant_d": "sunshine_hours total_failures critical_failures inverter_failures active_inverters total_inverters",
}
FLOATS = {
    "inverter_h": INVERTER_H, "inverter_d": INVERTER_D, "meteo_h": METEO_H, "meteo_d": METEO_D, "poi_h": POI_H, "poi_d": POI_D,
    "status_h": STATUS_H, "status_d": STATUS_D, "plant_h": PLANT_H, "plant_d": PLANT_D,
}
TEXTS = {"inverter_h": "failure_types", "inverter_d": "failure_types_summary"}
NAMES = {
    "inverter_h": "inverter_hourly", "inverter_d": "inverter_daily", "meteo_h": "meteo_hourly", "meteo_d": "meteo_daily",
    "poi_h": "poi_hourly", "poi_d": "poi_daily", "status_h": "status_hourly", "status_d": "status_daily",
    "plant_h": "plant_hourly_summary", "plant_d": "plant_daily_summary",
}


def keys_of(rel: str) -> list[str]:
    time = "timestamp_hour" if rel.endswith("_h") else "date"
    return (["plant_id", "inverter_id"] if rel.startswith("inverter") else ["plant_id"]) + [time]


def columns_of(rel: str) -> list[str]:
    return keys_of(rel) + FLOATS[rel].split() + INTS[rel].split() + TEXTS.get(rel, "").split()


def nested(c: str, depth: int) -> Column:
    """Nested lists of texts as one text, ``+`` inside, ``|`` and ``;`` outside."""
    inner = F.transform(F.col(c), lambda x: F.array_join(x, "+"))
    if depth == 3:
        return F.array_join(F.transform(F.col(c), lambda h: F.array_join(F.transform(h, lambda x: F.array_join(x, "+")), "|")), ";")
    return F.array_join(inner, "|")


def shown(r: Relations, rel: str) -> DataFrame:
    df = getattr(r, rel)
    if rel == "inverter_h":
        df = df.withColumn("failure_types", nested("failure_types", 2))
    if rel == "inverter_d":
        df = df.withColumn("failure_types_summary", nested("failure_types_summary", 3))
    return df.select(*columns_of(rel))


def dates_of(rel: str) -> str:
    return "date" if rel.endswith("_d") else ""


for _rel, _name in NAMES.items():

    @query(_name, f"select {', '.join(columns_of(_rel))} from {_rel}", _rel, FLOATS[_rel], INTS[_rel], dates_of(_rel))
    def _(r, rel=_rel):
        return shown(r, rel)


_EXTRA_F = "dc_energy_kwh avg_dc_voltage_v avg_dc_current_a avg_efficiency min_efficiency"
_EXTRA_I = "efficiency_below_threshold_minutes string_failure_events"
_extra = ["plant_id", "inverter_id", "date", *_EXTRA_F.split(), *_EXTRA_I.split()]


@query("inverter_daily_extended", f"select {', '.join(_extra)} from inverter_d", "inverter_d", _EXTRA_F, _EXTRA_I, "date")
def _(r):
    return r.inverter_d.select(*_extra)


@query(
    "failure_daily_summary", "select * from failure_d", "failure_d",
    "total_downtime_minutes estimated_energy_loss_kwh mean_time_between_failures_hours mean_time_to_repair_minutes",
    "failure_count critical_failure_count",
)
def _(r):
    return r.failure_d.withColumn("failure_types", F.array_join("failure_types", "|"))


# ---- discovery of keys that are not aggregated yet ------------------------------

CUT = "2024-01-21"  # the coarser table was filled from data before this day


def discovery(name: str, source: str, keys: str, time: str, level: str, fine: str) -> None:
    """Keys of ``source`` that the gold table, built before the cut, lacks."""
    columns = [*keys.split(), level]
    cut_sql = f"date_trunc('{'hour' if level == 'hour' else 'day'}', {time})"
    if level == "day":
        cut_sql = f"cast({time} as date)"
    pick = ", ".join(keys.split() + [f"{cut_sql} as {level}"])
    sql = f"""select distinct {pick} from {source} except select distinct {pick} from {source} where {time} < timestamp '{CUT}'"""

    @query(name, sql, source, dates="day" if level == "day" else "")
    def _(r, source=source, columns=columns, time=time, level=level):
        df = getattr(r, source)
        value = F.date_trunc("hour", time) if level == "hour" else F.to_date(time)
        made = {**{k: F.col(k) for k in columns[:-1]}, level: value}
        done = df.filter(F.col(time) < F.lit(CUT).cast("timestamp")).select(*[c.alias(k) for k, c in made.items()]).distinct()
        return gold.missing_keys(df, done, made)


for _n, _src, _keys in (("inverter", "inverter", "plant_id inverter_id"), ("meteo", "meteo", "plant_id"), ("poi", "poi", "plant_id"), ("status", "status", "plant_id")):
    discovery(f"unaggregated_{_n}_hours", f"{_src}_s", _keys, "ts", "hour", "s")
    discovery(f"unaggregated_{_n}_dates", f"{_src}_h", _keys, "timestamp_hour", "day", "h")
discovery("unaggregated_plant_hours", "inverter_h", "plant_id", "timestamp_hour", "hour", "h")
discovery("unaggregated_plant_dates", "plant_h", "plant_id", "timestamp_hour", "day", "h")


@query(
    "oldest_hours",
    "select distinct plant_id, inverter_id, date_trunc('hour', ts) as hour from inverter_s order by hour, plant_id, inverter_id limit 200",
    "inverter_s",
)
def _(r):
    keys = {"plant_id": F.col("plant_id"), "inverter_id": F.col("inverter_id"), "hour": F.date_trunc("hour", "ts")}
    return gold.oldest_keys(gold.missing_keys(r.inverter_s, None, keys), "hour", 200)


# ---- keyed writes -----------------------------------------------------------------

HOUR_KEY = ["plant_id", "inverter_id", "hour"]


def hour_rows(df: DataFrame) -> DataFrame:
    return df.select("plant_id", "inverter_id", F.date_trunc("hour", "ts").alias("hour"), "id", "ac_power_kw", "data_quality_flag")


@query(
    "upsert_keep_latest",
    """select plant_id, inverter_id, hour, id, ac_power_kw, data_quality_flag from (select *, row_number() over (partition by plant_id, inverter_id, hour
   order by gen desc, id desc) as n from (select *, date_trunc('hour', ts) as hour, case when state = 0 then 1 else 0 end as gen from inverter_s)) where n = 1""",
    "inverter_s", "ac_power_kw",
)
def _(r):
    stored = hour_rows(r.inverter_s.filter("state = 1"))
    batch = hour_rows(r.inverter_s.filter("state = 0"))
    return tables.merged(tables.keep_latest(stored, HOUR_KEY, ["id"]), batch, HOUR_KEY, ["id"])


@query(
    "insert_ignore",
    """select plant_id, inverter_id, hour, id, ac_power_kw from (select *, row_number() over (partition by plant_id, inverter_id, hour order by id) as n
   from (select *, date_trunc('hour', ts) as hour from inverter_s where state = 0)) x where n = 1
 and not exists (select 1 from inverter_s s where s.state = 1 and s.plant_id = x.plant_id and s.inverter_id = x.inverter_id
   and date_trunc('hour', s.ts) = x.hour)""",
    "inverter_s", "ac_power_kw",
)
def _(r):
    stored, batch = hour_rows(r.inverter_s.filter("state = 1")), hour_rows(r.inverter_s.filter("state = 0"))
    return tables.absent_rows(batch.drop("data_quality_flag"), stored, HOUR_KEY, ["id"])
