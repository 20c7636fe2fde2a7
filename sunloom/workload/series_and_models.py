"""Queries: time series, features, splits, profiling, metrics, failures, dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunloom.functions import temporal as t
from sunloom.functions.quality import anomaly_label, healthy_only
from sunloom.operators import failures as fl
from sunloom.operators import metrics as m
from sunloom.operators import profile as p
from sunloom.operators import splits, timeseries
from sunloom.sources import delimited, plant_config, tables
from sunloom.workload.registry import query
from sunloom.workload.relations import CLEAR_SKY, INVERTER_KEY, cos_zenith

PART = "partition by plant_id, inverter_id order by ts"

# ---- joins in time -----------------------------------------------------------------


@query(
    "asof_nearest",
    """with b as (select i.id, i.plant_id, i.ts, m.id as bid, epoch_us(i.ts) - epoch_us(m.ts) as bd from inverter i asof left join meteo m on m.plant_id = i.plant_id and i.ts >= m.ts),
 f as (select i.id, m.id as fid, epoch_us(m.ts) - epoch_us(i.ts) as fd from inverter i asof left join meteo m on m.plant_id = i.plant_id and i.ts < m.ts),
 c as (select b.id, b.plant_id, b.ts, case when bd <= 1.8e9 and (fd is null or bd <= fd) then bid when fd <= 1.8e9 then fid end as meteo_id from b join f on f.id = b.id)
 select c.id, c.plant_id, c.ts, c.meteo_id, m.amb_temp_c, m.poa_irradiance_wm2 from c left join meteo m on m.id = c.meteo_id""",
    "inverter meteo", "amb_temp_c poa_irradiance_wm2",
)
def _(r):
    weather = r.meteo.select("plant_id", "ts", F.col("id").alias("meteo_id"), "amb_temp_c", "poa_irradiance_wm2")
    return timeseries.asof_nearest(r.inverter.select("id", "plant_id", "ts"), weather, 1800, right_order=["meteo_id"])


ACTIVE = """select s.id, s.plant_id, s.ts, f.failure_id, f.component_id, f.severity from status s
 join failures f on f.plant_id = s.plant_id and f.start_ts <= s.ts and s.ts < f.end_ts"""


@query("failures_active_at", ACTIVE, "status failures")
def _(r):
    # the time as it is returned, since a conversion after the join would be done for every pair
    points = r.status.select("id", "plant_id", F.col("ts").cast("timestamp_ntz"))
    return timeseries.interval_join(points, r.failures, max_pairs=timeseries.MAX_PAIRS).select("id", "plant_id", "ts", "failure_id", "component_id", "severity")


@query(
    "system_impact",
    f"""select s.id, s.plant_id, s.ts, count(a.failure_id) as active_failures, count(distinct a.component_id) as components_affected,
  count(*) filter (where a.severity = 'CRITICAL') as critical_active,
  least(coalesce(sum(case a.severity when 'CRITICAL' then 0.4e0 when 'HIGH' then 0.25e0 when 'MEDIUM' then 0.15e0 when 'LOW' then 0.05e0 end), 0), 1) as stress,
  least(coalesce(sum(case a.severity when 'CRITICAL' then 0.3e0 when 'HIGH' then 0.2e0 when 'MEDIUM' then 0.1e0 when 'LOW' then 0.05e0 end), 0), 0.95e0) as performance_reduction
 from status s left join ({ACTIVE}) a on a.id = s.id group by s.id, s.plant_id, s.ts""",
    "status failures", "stress performance_reduction",
)
def _(r):
    return fl.system_impact(r.status.select("id", "plant_id", "ts"), r.failures)


@query(
    "performance_multiplier",
    f"""select plant_id, id, component_id, product(case severity when 'CRITICAL' then 0.0e0 when 'HIGH' then 0.3e0 when 'MEDIUM' then 0.6e0 else 0.9e0 end) as multiplier
 from ({ACTIVE}) group by plant_id, id, component_id""",
    "status failures", "multiplier",
)
def _(r):
    return fl.performance_multiplier(r.status, r.failures, ["id"])


# ---- series ------------------------------------------------------------------------


@query("time_gaps", f"select id, (epoch_us(ts) - lag(epoch_us(ts)) over ({PART})) / 1e6 as gap_seconds from inverter", "inverter", "gap_seconds")
def _(r):
    return timeseries.time_gaps(r.inverter.select("id", *INVERTER_KEY, "ts"), INVERTER_KEY).select("id", "gap_seconds")


_LAGS = timeseries.rows_for_minutes(timeseries.LAG_MINUTES, 60)
_lagged = [f"{c}_lag_{n}" for n in _LAGS for c in ("ac_power_kw", "inverter_temp_c")]


@query(
    "lag_features",
    "select id, " + ", ".join(f"lag({c.rsplit('_lag_', 1)[0]}, {c.rsplit('_', 1)[1]}) over w as {c}" for c in _lagged) + f" from inverter window w as ({PART})",
    "inverter", " ".join(_lagged),
)
def _(r):
    df = r.inverter.select("id", *INVERTER_KEY, "ts", "ac_power_kw", "inverter_temp_c")
    return timeseries.lag_features(df, INVERTER_KEY, ["ac_power_kw", "inverter_temp_c"], _LAGS).select("id", *_lagged)


_WINDOWS = timeseries.rows_for_minutes(timeseries.ROLLING_MINUTES, 60)
_rolled = [(f"{c}_rolling_{f}_{n}", f, c, n) for n in _WINDOWS for c, f in (("ac_power_kw", "mean"), ("ac_power_kw", "std"), ("inverter_temp_c", "mean"))]


@query(
    "rolling_features",
    "select id, " + ", ".join(
        f"{'avg' if f == 'mean' else 'stddev_samp'}({c}) over ({PART} rows between {n - 1} preceding and current row) as {name}" for name, f, c, n in _rolled
    ) + " from inverter", "inverter", " ".join(x[0] for x in _rolled),
)
def _(r):
    df = r.inverter.select("id", *INVERTER_KEY, "ts", "ac_power_kw", "inverter_temp_c")
    out = timeseries.rolling_features(df, INVERTER_KEY, _WINDOWS, ["ac_power_kw", "inverter_temp_c"], ["ac_power_kw"])
    return out.select("id", *[x[0] for x in _rolled])


_FILL = ["inverter_temp_c", "ac_power_kw", "ac_freq_hz", "dc_power_kw"]


@query(
    "ffill_bfill",
    "select id, " + ", ".join(
        f"coalesce(last_value({c} ignore nulls) over ({PART} rows between unbounded preceding and current row), "
        f"first_value({c} ignore nulls) over ({PART} rows between current row and unbounded following)) as {c}" for c in _FILL
    ) + " from inverter", "inverter", " ".join(_FILL),
)
def _(r):
    return timeseries.fill_gaps(r.inverter.select("id", *INVERTER_KEY, "ts", *_FILL), INVERTER_KEY, _FILL).select("id", *_FILL)


@query(
    "resample_interpolate",
    """with m as (select plant_id, inverter_id, time_bucket(interval 1 minute, ts) as slot, avg(ac_power_kw) as v from inverter where active_failures = 0 group by all),
 g as (select plant_id, inverter_id, unnest(generate_series(min(slot), max(slot), interval 1 minute)) as ts from m group by plant_id, inverter_id),
 j as (select g.*, m.v, case when m.v is not null then m.slot end as slot from g left join m on m.plant_id = g.plant_id and m.inverter_id = g.inverter_id and m.slot = g.ts),
 k as (select *, last_value(v ignore nulls) over p as v0, last_value(slot ignore nulls) over p as t0, first_value(v ignore nulls) over n as v1, first_value(slot ignore nulls) over n as t1
  from j window p as (partition by plant_id, inverter_id order by ts rows between unbounded preceding and current row),
   n as (partition by plant_id, inverter_id order by ts rows between current row and unbounded following))
 select plant_id, inverter_id, ts, case when v0 is null then v1 when v1 is null or t0 = t1 then v0
  else v0 + (v1 - v0) * ((epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))) end as ac_power_kw from k""",
    "inverter", "ac_power_kw",
)
def _(r):
    return timeseries.resample_interpolate(healthy_only(r.inverter), INVERTER_KEY, "ac_power_kw", minutes=1)


@query("resample_hourly", "select * from series_h", "series_h", "power")
def _(r):
    return r.series_h


@query(
    "seasonal_decompose",
    """with a as (select *, row_number() over w - 1 as pos, count(power) over (partition by plant_id, inverter_id order by ts rows between 12 preceding and 12 following) as c,
   (sum(power) over (partition by plant_id, inverter_id order by ts rows between 12 preceding and 12 following) - (lag(power, 12) over w + lead(power, 12) over w) / 2) / 24 as t
   from series_h window w as (partition by plant_id, inverter_id order by ts)),
 b as (select *, case when c = 25 then t end as trend, pos % 24 as phase from a),
 s as (select plant_id, inverter_id, phase, avg(power - trend) as sm from b group by all),
 n as (select *, sm - avg(sm) over (partition by plant_id, inverter_id) as seasonal from s)
 select b.plant_id, b.inverter_id, b.ts, power, trend, seasonal, power - trend - seasonal as residual from b
 join n on n.plant_id = b.plant_id and n.inverter_id = b.inverter_id and n.phase = b.phase""",
    "series_h", "power trend seasonal residual",
)
def _(r):
    return timeseries.seasonal_decompose(r.series_h, INVERTER_KEY, "power")


@query(
    "seasonal_naive",
    """with n as (select *, row_number() over (partition by plant_id, inverter_id order by ts desc) as rn from series_h),
 h as (select plant_id, inverter_id, hour(ts) as h, avg(power) as v from n where rn <= 336 group by all),
 f as (select plant_id, inverter_id, unnest(generate_series(max(ts) + interval 1 hour, max(ts) + interval 168 hours, interval 1 hour)) as ts from series_h group by plant_id, inverter_id)
 select f.plant_id, f.inverter_id, f.ts, greatest(h.v, 0) as forecast from f left join h on h.plant_id = f.plant_id and h.inverter_id = f.inverter_id and h.h = hour(f.ts)""",
    "series_h", "forecast",
)
def _(r):
    return timeseries.seasonal_naive(r.series_h, INVERTER_KEY, "power")


@query(
    "ewma",
    f"""select id, list_reduce(list(dc_current_a) over ({PART} rows between unbounded preceding and current row), lambda a, x: 0.85e0 * a + 0.15e0 * x) as dc_current_a_smooth from inverter""",
    "inverter", "dc_current_a_smooth",
)
def _(r):
    return timeseries.ewma(r.inverter.select("id", *INVERTER_KEY, "ts", "dc_current_a"), INVERTER_KEY, ["dc_current_a"]).select("id", "dc_current_a_smooth")


@query(
    "ewma_angle",
    """select id, case when a < 0 then a + 360 else a end as wind_dir_deg_smooth from (select id, degrees(atan2(y, x)) as a from (select id,
   list_reduce(list(cos(radians(wind_dir_deg))) over w, lambda a, x: 0.85e0 * a + 0.15e0 * x) as x,
   list_reduce(list(sin(radians(wind_dir_deg))) over w, lambda a, x: 0.85e0 * a + 0.15e0 * x) as y
   from meteo window w as (partition by plant_id order by ts rows between unbounded preceding and current row)))""",
    "meteo", "wind_dir_deg_smooth", decimals=4,
)
def _(r):
    return timeseries.ewma_angle(r.meteo.select("id", "plant_id", "ts", "wind_dir_deg"), ["plant_id"], "wind_dir_deg").select("id", "wind_dir_deg_smooth")


@query(
    "forecast_grid",
    """select plant_id, inverter_id, unnest(generate_series(greatest(data, done) + interval 15 minutes, data + interval 48 hours, interval 15 minutes)) as ts from
 (select i.plant_id, i.inverter_id, max(i.ts) as data, max(f.done) as done from inverter_s i
  left join (select plant_id, inverter_id, max(ts) + interval 1 day as done from forecasts group by all) f
  on f.plant_id = i.plant_id and f.inverter_id = i.inverter_id group by i.plant_id, i.inverter_id)""",
    "inverter_s forecasts",
)
def _(r):
    data = r.inverter_s.groupBy(*INVERTER_KEY).agg(F.max("ts").alias("last_ts"))
    done = r.forecasts.groupBy(*INVERTER_KEY).agg((F.max("ts") + F.expr("interval 1 day")).alias("last_ts"))
    return timeseries.forecast_grid(data, done)


# ---- features ------------------------------------------------------------------------

CALENDAR = "select id, hour(ts) as hour, isodow(ts) - 1 as day_of_week, day(ts) as day_of_month, month(ts) as month, quarter(ts) as quarter, case when isodow(ts) >= 6 then 1 else 0 end as is_weekend from inverter"


@query("calendar_features", CALENDAR, "inverter", ints="hour day_of_week day_of_month month quarter is_weekend")
def _(r):
    return t.calendar_features(r.inverter.select("id", "ts")).drop("ts")


_cyc = [f"{n}_{f}" for n in ("hour", "day_of_week", "month") for f in ("sin", "cos")]


@query(
    "cyclic_features",
    "select id, " + ", ".join(f"{f}(2 * pi() * {n} / {k}) as {n}_{f}" for n, k in (("hour", 24), ("day_of_week", 7), ("month", 12)) for f in ("sin", "cos")) + f" from ({CALENDAR})",
    "inverter", " ".join(_cyc),
)
def _(r):
    return t.cyclic_features(t.calendar_features(r.inverter.select("id", "ts"))).select("id", *_cyc)


@query(
    "ratio_features",
    """select i.id, dc_power_kw / nullif(ac_power_kw + 1e-6, 0) as dc_to_ac_ratio, ac_power_kw / (healthy_strings + 1) as power_per_healthy_string,
 module_temp_c - amb_temp_c as temp_diff, poa_irradiance_wm2 * amb_temp_c as irradiance_temp_interaction
 from inverter i left join meteo m on m.plant_id = i.plant_id and m.ts = i.ts""",
    "inverter meteo", "dc_to_ac_ratio power_per_healthy_string temp_diff irradiance_temp_interaction",
)
def _(r):
    weather = r.meteo.select("plant_id", "ts", "module_temp_c", "amb_temp_c", "poa_irradiance_wm2")
    joined = r.inverter.join(weather, ["plant_id", "ts"], "left")
    return t.ratio_features(joined).select("id", "dc_to_ac_ratio", "power_per_healthy_string", "temp_diff", "irradiance_temp_interaction")


_TEXT_TS = "case when k < 10 then 'soon' when k < 20 then {d} when k < 30 then concat({s}, '+01:00') when k < 40 then concat({s}, 'Z') else {s} end"


@query(
    "parse_ts",
    """select event_id, case when k < 10 then null when k < 20 then date_trunc('day', ts) when k < 30 then date_trunc('second', ts) - interval 1 hour
 else date_trunc('second', ts) end as parsed from e""", "e",
)
def _(r):
    text = _TEXT_TS.format(d="date_format(ts, 'yyyy-MM-dd')", s="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")")
    return r.e.select("event_id", t.parse_ts(F.expr(text)).alias("parsed"))


@query("clear_sky_poa", f"select id, {CLEAR_SKY} as poa from (select id, {cos_zenith('ts', 40.4168, -3.7038)} as cz from inverter)", "inverter", "poa")
def _(r):
    return r.inverter.select("id", t.clear_sky_poa("ts", 40.4168, -3.7038).alias("poa"))


# ---- splits --------------------------------------------------------------------------


@query(
    "chrono_split",
    f"""select id, case when row_number() over ({PART}) <= floor(0.8e0 * count(*) over (partition by plant_id, inverter_id)) then 'train' else 'test' end as split from inverter""",
    "inverter",
)
def _(r):
    return splits.chronological_split(r.inverter.select("id", *INVERTER_KEY, "ts"), INVERTER_KEY).select("id", "split")


@query(
    "normal_only_split",
    f"""with l as (select *, case when coalesce(active_failures, 0) > 0 then 1 else 0 end as is_anomaly from inverter)
 select id, case when row_number() over ({PART}) <= floor(0.7e0 * count(*) over (partition by plant_id, inverter_id)) then 'train' else 'test' end as split from l where is_anomaly = 0
 union all select id, 'test' from l where is_anomaly = 1 and exists (select 1 from l n where n.is_anomaly = 0 and n.plant_id = l.plant_id and n.inverter_id = l.inverter_id)""",
    "inverter",
)
def _(r):
    labelled = r.inverter.select("id", *INVERTER_KEY, "ts", anomaly_label().alias("is_anomaly"))
    return splits.normal_only_split(labelled, INVERTER_KEY).select("id", "split")


@query(
    "time_series_folds",
    f"""select id, case when i <= n - 5 * b then 0 else (i - (n - 5 * b) - 1) // b + 1 end as test_fold from
 (select id, row_number() over ({PART}) as i, count(*) over (partition by plant_id, inverter_id) as n, count(*) over (partition by plant_id, inverter_id) // 6 as b from inverter)""",
    "inverter", ints="test_fold",
)
def _(r):
    return splits.time_series_folds(r.inverter.select("id", *INVERTER_KEY, "ts"), INVERTER_KEY, 5).select("id", "test_fold")


# ---- profiling -----------------------------------------------------------------------


@query(
    "failure_share",
    """select plant_id, inverter_id, count(active_failures) as total_records, count(*) filter (where active_failures > 0) as records_with_failures,
 round_even(count(*) filter (where active_failures > 0) / nullif(count(active_failures), 0) * 100, 2) as failure_percentage from inverter group by plant_id, inverter_id""",
    "inverter", "failure_percentage",
)
def _(r):
    return p.failure_share(r.inverter)


@query(
    "anomaly_distribution",
    """select plant_id, inverter_id, count(*) as total, sum(a) as anomalies, count(*) filter (where a = 0) as normal, round_even(avg(a) * 100, 2) as anomaly_ratio
 from (select plant_id, inverter_id, case when coalesce(active_failures, 0) > 0 then 1 else 0 end as a from inverter) group by plant_id, inverter_id""",
    "inverter", "anomaly_ratio", "anomalies",
)
def _(r):
    return p.anomaly_distribution(r.inverter.select(*INVERTER_KEY, anomaly_label().alias("is_anomaly")))


_NULLS = ["ac_power_kw", "inverter_temp_c", "ac_freq_hz", "dc_power_kw", "active_failures", "dc_voltage_v"]


@query("null_counts", " union all ".join(f"select '{c}' as \"column\", count(*) - count({c}) as nulls from inverter" for c in _NULLS), "inverter")
def _(r):
    return p.null_counts(r.inverter, _NULLS)


@query("duplicate_rows", "select coalesce(sum(n - 1), 0) as duplicate_rows from (select count(*) as n from inverter group by plant_id, inverter_id, date_trunc('hour', ts))", "inverter", ints="duplicate_rows")
def _(r):
    return p.duplicate_rows(r.inverter.select(*INVERTER_KEY, F.date_trunc("hour", "ts").alias("hour")))


@query("rows_per_key", "select inverter_id, count(*) as rows from inverter group by inverter_id", "inverter")
def _(r):
    return p.rows_per_key(r.inverter, ["inverter_id"])


@query(
    "describe_power",
    """select inverter_id, count(ac_power_kw) as count, avg(ac_power_kw) as mean, stddev_samp(ac_power_kw) as std, min(ac_power_kw) as min, max(ac_power_kw) as max,
 quantile_cont(ac_power_kw, 0.25) as p25, quantile_cont(ac_power_kw, 0.5) as p50, quantile_cont(ac_power_kw, 0.75) as p75 from inverter group by inverter_id""",
    "inverter", "mean std min max p25 p50 p75",
)
def _(r):
    return p.describe(r.inverter, ["inverter_id"], "ac_power_kw")


_MODE = "arg_min(gap_seconds, {'a': -occurrences, 'b': gap_seconds})"
_LONG = f"select round_even((epoch_us(ts) - lag(epoch_us(ts)) over ({PART})) / 1e6, 0) as g from inverter"


@query(
    "gap_stats",
    f"""select sum(occurrences) as gaps, sum(gap_seconds * occurrences) / sum(occurrences) as mean_gap, (select median(g) from ({_LONG})) as median_gap, {_MODE} as mode_gap from gaps""",
    "gaps", "mean_gap median_gap mode_gap", "gaps", decimals=4,
)
def _(r):
    return p.gap_stats(r.gaps)


@query("gap_top10", "select * from gaps order by occurrences desc, gap_seconds limit 10", "gaps", "gap_seconds")
def _(r):
    return p.gap_top(r.gaps)


@query("sampling_interval", f"select {_MODE} as interval_seconds, {_MODE} / 60 as interval_minutes from gaps", "gaps", "interval_seconds interval_minutes")
def _(r):
    return p.sampling_interval(r.gaps)


@query(
    "gap_histogram",
    f"""with b as (select min(g) as lo, quantile_cont(g, 0.99) as hi from ({_LONG}) where g is not null)
 select least(100, floor((least(gap_seconds, hi) - lo) / ((hi - lo) / 100)) + 1) as bin, sum(occurrences) as gaps from gaps, b group by 1""",
    "gaps", ints="bin gaps",
)
def _(r):
    return p.clipped_histogram(r.gaps)


_IQR = ["inverter_temp_c", "ac_power_kw", "ac_freq_hz", "dc_power_kw"]
_bounds = "select inverter_id, " + ", ".join(
    f"{c}_q1, {c}_q3, {c}_q1 - 1.5e0 * ({c}_q3 - {c}_q1) as {c}_lower, {c}_q3 + 1.5e0 * ({c}_q3 - {c}_q1) as {c}_upper" for c in _IQR
) + " from (select inverter_id, " + ", ".join(f"quantile_cont({c}, 0.25) as {c}_q1, quantile_cont({c}, 0.75) as {c}_q3" for c in _IQR) + " from inverter group by inverter_id)"


@query("iqr_bounds", _bounds, "inverter", " ".join(f"{c}_{s}" for c in _IQR for s in ("q1", "q3", "lower", "upper")))
def _(r):
    return p.iqr_bounds(r.inverter, _IQR, ["inverter_id"])


_flag = {c: f"coalesce(i.{c} < b.{c}_lower or i.{c} > b.{c}_upper, false)" for c in _IQR}
_marked = "select i.id, i.inverter_id, i.ts, i.active_failures, " + ", ".join(f"{x} as {c}_outlier" for c, x in _flag.items()) + ", " + " or ".join(_flag.values()) + f" as any_outlier from inverter i join ({_bounds}) b on b.inverter_id = i.inverter_id"


def marked(r):
    return p.with_outliers(r.inverter.select("id", "inverter_id", "ts", "active_failures", *_IQR), _IQR, ["inverter_id"])


@query("iqr_outliers", f"select id, {', '.join(f'{c}_outlier' for c in _IQR)}, any_outlier from ({_marked})", "inverter")
def _(r):
    return marked(r).select("id", *[f"{c}_outlier" for c in _IQR], "any_outlier")


@query(
    "outliers_in_failures",
    f"""select inverter_id, count(distinct ts) as outlier_times, count(distinct case when active_failures > 0 then ts end) as in_failure
 from ({_marked}) where any_outlier group by inverter_id""", "inverter",
)
def _(r):
    return p.outliers_in_failures(marked(r), ["inverter_id"])


@query("timestamp_intersect", f"select inverter_id, ts from ({_marked}) where any_outlier intersect select inverter_id, ts from inverter where active_failures > 0", "inverter")
def _(r):
    return p.timestamp_intersect(marked(r), ["inverter_id"])


# ---- metrics -------------------------------------------------------------------------


@query(
    "confusion_metrics",
    """select inverter_id, tp, tn, fp, fn, error_normal, error_anomaly, pr as "precision", re as recall, case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end as f1 from
 (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as pr, case when tp + fn > 0 then tp / (tp + fn) else 0 end as re from
 (select inverter_id, count(*) filter (where y_true = 1 and y_pred = 1) as tp, count(*) filter (where y_true = 0 and y_pred = 0) as tn,
   count(*) filter (where y_true = 0 and y_pred = 1) as fp, count(*) filter (where y_true = 1 and y_pred = 0) as fn,
   coalesce(avg(reconstruction_error) filter (where y_true = 0), 0) as error_normal, coalesce(avg(reconstruction_error) filter (where y_true = 1), 0) as error_anomaly
  from pred group by inverter_id))""",
    "pred", 'error_normal error_anomaly "precision" recall f1',
)
def _(r):
    return m.confusion_metrics(r.pred, ["inverter_id"], error="reconstruction_error")


_REG = """avg(abs(actual - predicted)) as mae, avg((actual - predicted) * (actual - predicted)) as mse, sqrt(avg((actual - predicted) * (actual - predicted))) as rmse,
 avg(abs((actual - predicted) / nullif(actual, 0))) * 100 as mape, count(*) as rows"""


@query("regression_metrics", f"select inverter_id, {_REG} from pred group by inverter_id", "pred", "mae mse rmse mape")
def _(r):
    return m.regression_metrics(r.pred, ["inverter_id"])


@query("mae_by_hour", "select hour(ts) as hour, avg(abs(actual - predicted)) as mae, count(*) as rows from pred group by 1", "pred", "mae", "hour")
def _(r):
    return m.mae_by_hour(r.pred)


@query(
    "residual_stats",
    "select inverter_id, avg(actual - predicted) as mean, stddev_pop(actual - predicted) as std, min(actual - predicted) as least, max(actual - predicted) as greatest from pred group by inverter_id",
    "pred", "mean std least greatest",
)
def _(r):
    return m.residual_stats(r.pred, ["inverter_id"])


@query(
    "fold_summary",
    """select inverter_id, avg(mae) as mae_mean, stddev_pop(mae) as mae_std from (select inverter_id, model_run_id, avg(abs(actual - predicted)) as mae from pred group by all) group by inverter_id""",
    "pred", "mae_mean mae_std",
)
def _(r):
    scores = m.regression_metrics(r.pred, ["inverter_id", "model_run_id"])
    return m.fold_summary(scores, ["inverter_id"], "mae")


_THRESH = "select inverter_id, quantile_cont(reconstruction_error, 0.99) as threshold from pred where y_true = 0 group by inverter_id"


@query("error_threshold", _THRESH, "pred", "threshold")
def _(r):
    return m.error_threshold(r.pred.filter("y_true = 0"), ["inverter_id"], "reconstruction_error")


@query(
    "score_threshold",
    f"""select p.id, p.inverter_id, t.threshold, case when p.reconstruction_error > t.threshold then 1 else 0 end as is_anomaly from pred p join ({_THRESH}) t on t.inverter_id = p.inverter_id""",
    "pred", "threshold", "is_anomaly",
)
def _(r):
    limits = m.error_threshold(r.pred.filter("y_true = 0"), ["inverter_id"], "reconstruction_error")
    return m.score_threshold(r.pred, limits, ["inverter_id"]).select("id", "inverter_id", "threshold", "is_anomaly")


_SCALE = ["inverter_temp_c", "ac_power_kw", "dc_voltage_v"]
_stats = "select plant_id, inverter_id, " + ", ".join(f"avg({c}) as {c}_mean, case when stddev_samp({c}) = 0 then 1 else stddev_samp({c}) end as {c}_std" for c in _SCALE) + " from inverter where active_failures = 0 group by plant_id, inverter_id"


def stats_of(r):
    return m.scaler_stats(r.inverter.filter("active_failures = 0"), INVERTER_KEY, _SCALE)


@query("scaler_stats", _stats, "inverter", " ".join(f"{c}_{s}" for c in _SCALE for s in ("mean", "std")))
def _(r):
    return stats_of(r)


_scaled = [f"coalesce((i.{c} - s.{c}_mean) / s.{c}_std, 0)" for c in _SCALE]


@query(
    "standardize",
    "select i.id, " + ", ".join(f"{x} as {c}" for x, c in zip(_scaled, _SCALE)) + f", ({' + '.join(f'{x} * {x}' for x in _scaled)}) / 3 as mean_square from inverter i left join ({_stats}) s on s.plant_id = i.plant_id and s.inverter_id = i.inverter_id",
    "inverter", " ".join([*_SCALE, "mean_square"]),
)
def _(r):
    scaled = m.standardize(r.inverter.select("id", *INVERTER_KEY, *_SCALE), stats_of(r), INVERTER_KEY, _SCALE)
    return scaled.select("id", *_SCALE, m.mean_square(_SCALE).alias("mean_square"))


_RUNS = "select inverter_id, model_run_id as run_id, status, avg(abs(actual - predicted)) as mae from pred group by inverter_id, model_run_id, status"


def runs(r):
    return r.pred.groupBy("inverter_id", F.col("model_run_id").alias("run_id"), "status").agg(F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae"))


@query(
    "best_run",
    f"select inverter_id, run_id, status, mae from (select *, row_number() over (partition by inverter_id order by mae, run_id) as n from ({_RUNS}) where status = 'FINISHED') where n = 1",
    "pred", "mae",
)
def _(r):
    return m.best_run(runs(r), "mae", True)


@query(
    "fleet_best",
    """select avg(mae) as mean_mae, arg_min(inverter_id, mae) as best_inverter, min(mae) as best_mae, count(*) as inverters
 from (select inverter_id, avg(abs(actual - predicted)) as mae from pred group by inverter_id)""", "pred", "mean_mae best_mae",
)
def _(r):
    return m.fleet_best(m.regression_metrics(r.pred, ["inverter_id"]), "mae", True)


@query(
    "top_trials",
    """select user_id as number, avg(value) as value from e group by user_id having max(k) < 99 order by value, number limit 5""", "e", "value",
)
def _(r):
    trials = r.e.groupBy(F.col("user_id").alias("number")).agg(F.avg("value").alias("value"), F.when(F.max("k") < 99, "COMPLETE").otherwise("PRUNED").alias("state"))
    return m.top_trials(trials).select("number", "value")


@query(
    "best_model_per_metric",
    """select 'mae' as metric, arg_min(run_id, mae) as model from r union all select 'rmse', arg_min(run_id, rmse) from r""".replace(
        " from r", " from (select model_run_id as run_id, avg(abs(actual - predicted)) as mae, sqrt(avg((actual - predicted) * (actual - predicted))) as rmse from pred group by 1)"
    ), "pred",
)
def _(r):
    scores = m.regression_metrics(r.pred, ["model_run_id"])
    return m.best_model_per_metric(scores, ["mae", "rmse"], "model_run_id")


# ---- documents and dimensions ----------------------------------------------------------

CONFIG = """to_json(named_struct('version', '1.0', 'plant', named_struct('plant_id', concat('C', c_custkey), 'plant_name', c_name,
  'location', named_struct('latitude', 30D + c_nationkey, 'longitude', -3.5D, 'timezone', 'Europe/Madrid'),
  'commissioning_date', '2024-01-01', 'total_capacity_kwp', 1260D + c_acctbal,
  'grid_connection', named_struct('voltage_nominal_v', 400, 'frequency_nominal_hz', 50, 'phases', 3)),
 'inverter_groups', array(
  named_struct('group_id', 'A', 'inverter_count', 1 + c_nationkey % 4, 'inverter_ids', transform(sequence(0, c_nationkey % 4), i -> concat('A', i))),
  named_struct('group_id', 'B', 'inverter_count', 1 + c_custkey % 3, 'inverter_ids', transform(sequence(0L, c_custkey % 3), i -> concat('B', i)))),
 'inverter_specs', named_struct('nominal_capacity_kw', 90, 'dc_side', named_struct('current_max_a', 100 + c_nationkey, 'strings_count', 10 + c_custkey % 4,
   'panels_per_string', 20, 'panel_wp', 400 + c_nationkey), 'efficiency', named_struct('system_efficiency_range', array(0.88D, 0.92D))),
 'poi_meter_specs', if(c_nationkey < 5, null, named_struct('meter_id', concat('M', c_nationkey), 'power_capacity', named_struct('max_export_kw', 1300, 'max_import_kw', 500))),
 'meteo_station_specs', named_struct('station_id', 'W1'),
 'thresholds', named_struct('inverter', named_struct('temp_critical_c', 60 + c_nationkey, 'efficiency_alert_min', 0.95D, 'house_limit', c_acctbal), 'poi_meter', named_struct('power_factor_warning_min', 0.9D))))"""


def configs(r):
    return plant_config.parse_configs(r.table("customer").select(F.expr(CONFIG).alias("value")))


_GROUPS = """select concat('C', c_custkey) as plant_id, concat('A', i) as asset_id, 'A' as asset_group, c_custkey, c_nationkey from customer, range(4) t(i) where i <= c_nationkey % 4
 union all select concat('C', c_custkey), concat('B', i), 'B', c_custkey, c_nationkey from customer, range(3) t(i) where i <= c_custkey % 3"""


@query(
    "dim_plant_config",
    """select concat('C', c_custkey) as plant_id, c_name as plant_name, 30e0 + c_nationkey as latitude, 1260 + c_acctbal as total_capacity_kwp,
 2 + c_nationkey % 4 + c_custkey % 3 as total_inverters, 3 as grid_phases, '2024-01-01' as commissioning_date, '1.0' as config_version from customer""",
    floats="latitude total_capacity_kwp", ints="total_inverters grid_phases",
)
def _(r):
    dim = plant_config.dim_plant_config(configs(r))
    return dim.select("plant_id", "plant_name", "latitude", "total_capacity_kwp", "total_inverters", "grid_phases", "commissioning_date", "config_version")


@query(
    "dim_asset_flatten",
    f"""select plant_id, asset_id, 'inverter' as asset_type, asset_group, 90e0 as nominal_capacity_kw, 10 + c_custkey % 4 as strings_count, 0.88e0 as efficiency_system_min,
  cast(null as double) as max_export_kw from ({_GROUPS})
 union all select concat('C', c_custkey), case when c_nationkey < 5 then 'POI_METER_01' else concat('M', c_nationkey) end, 'poi_meter', null,
  case when c_nationkey >= 5 then 1300 end, null, null, case when c_nationkey >= 5 then 1300 end from customer
 union all select concat('C', c_custkey), 'W1', 'meteo_station', null, null, null, null, null from customer""",
    floats="nominal_capacity_kw efficiency_system_min max_export_kw", ints="strings_count",
)
def _(r):
    dim = plant_config.dim_asset(configs(r))
    return dim.select("plant_id", "asset_id", "asset_type", "asset_group", "nominal_capacity_kw", "strings_count", "efficiency_system_min", "max_export_kw")


@query(
    "dim_thresholds_flatten",
    """select concat('C', c_custkey) as plant_id, 'inverter' as threshold_category, 'temp_critical_c' as threshold_name, 60e0 + c_nationkey as threshold_value, '°C' as threshold_unit, 'critical' as severity from customer
 union all select concat('C', c_custkey), 'inverter', 'efficiency_alert_min', 0.95e0, 'ratio', 'alert' from customer
 union all select concat('C', c_custkey), 'inverter', 'house_limit', c_acctbal, null, 'info' from customer
 union all select concat('C', c_custkey), 'poi_meter', 'power_factor_warning_min', 0.9e0, 'ratio', 'warning' from customer""",
    floats="threshold_value",
)
def _(r):
    return plant_config.dim_thresholds(configs(r)).drop("description")


@query(
    "string_specs",
    f"""select plant_id, asset_id, (100 + c_nationkey) / (10 + c_custkey % 4) as current_per_string_a, 20 * (400 + c_nationkey) / 1000 as power_per_string_kw from ({_GROUPS})""",
    floats="current_per_string_a power_per_string_kw",
)
def _(r):
    assets = plant_config.inverter_assets(configs(r))
    return plant_config.string_specs(assets).select("plant_id", "asset_id", "current_per_string_a", "power_per_string_kw")


@query(
    "inverter_group",
    f"select plant_id, asset_id, asset_group from ({_GROUPS})",
)
def _(r):
    docs = configs(r).select(F.col("plant.plant_id").alias("plant_id"), "inverter_groups")
    ids = F.flatten(F.transform("inverter_groups", lambda g: g["inverter_ids"]))
    listed = docs.withColumn("asset_id", F.explode(ids))
    return listed.select("plant_id", "asset_id", plant_config.group_of(F.col("asset_id"), F.col("inverter_groups")).alias("asset_group"))


@query(
    "dim_partial_upsert",
    """select coalesce(o.plant_id, n.plant_id) as plant_id, case when n.plant_id is not null then n.label else o.label end as label,
 case when o.plant_id is not null then o.capacity else n.capacity end as capacity, case when n.plant_id is not null then timestamp '2024-06-01' else timestamp '2024-01-01' end as updated_at
 from (select concat('C', c_custkey) as plant_id, c_name as label, c_acctbal as capacity from customer where c_mktsegment <> 'BUILDING') o
 full outer join (select concat('C', o_custkey) as plant_id, max(o_orderpriority) as label, max(o_totalprice) as capacity from orders group by o_custkey) n on n.plant_id = o.plant_id""",
    floats="capacity",
)
def _(r):
    stamp = F.lit("2024-01-01").cast("timestamp")
    old = r.table("customer").filter("c_mktsegment <> 'BUILDING'").select(
        F.expr("concat('C', c_custkey)").alias("plant_id"), F.col("c_name").alias("label"), F.col("c_acctbal").alias("capacity"), stamp.alias("updated_at")
    )
    new = r.table("orders").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("label"), F.max("o_totalprice").alias("capacity"))
    new = new.select(F.expr("concat('C', o_custkey)").alias("plant_id"), "label", "capacity", stamp.alias("updated_at"))
    return tables.partial_upsert(old, new, ["plant_id"], ["label"], F.lit("2024-06-01").cast("timestamp"))


_EXPORT = ["id", "plant_id", "timestamp", "raw_json", "ingestion_timestamp", "source", "processing_status", "error_message"]


@query(
    "csv_json_split",
    """select cast(event_id as varchar) as id, concat('P', user_id % 2) as plant_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as "timestamp",
 case when k < 5 then null when k < 50 then concat('{""a"": ', k, ', ""b"": [1,', k, ']}') else concat('{"a": ', k, '}') end as raw_json,
 '2024-02-01' as ingestion_timestamp, 'kafka' as source, case when k % 2 = 0 then 'new' end as processing_status, case when k >= 90 then 'late' end as error_message from e""",
    "e",
)
def _(r):
    line = F.expr("""concat(event_id, ',P', user_id % 2, ',', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ',',
     case when k < 5 then '""' when k < 50 then concat('"{""a"": ', k, ', ""b"": [1,', k, ']}"') else concat('{"a": ', k, '}') end,
     ',2024-02-01,kafka,', if(k % 2 = 0, 'new', ' '), ',', if(k >= 90, 'late', ''))""")
    return delimited.split_export(r.e.select(line.alias("value")), _EXPORT)
