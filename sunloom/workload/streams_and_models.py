"""Queries: streams run to their end, model steps, fingerprints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom import forests, models
from sunloom.functions.quality import anomaly_label
from sunloom.operators import dashboard, metrics, splits, timeseries
from sunloom.plans.medallion import Warehouse
from sunloom.session import ensure_checkpoint_dir
from sunloom.streaming import jobs
from sunloom.workload.quality_and_gold import MESSAGE
from sunloom.workload.registry import query
from sunloom.workload.relations import EVENTS, FAILURES, INVERTER, INVERTER_KEY, METEO, Relations


def scratch(r: Relations) -> str:
    """A new folder beside the checkpoints, on storage all executors share."""
    return f"{ensure_checkpoint_dir(r.spark)}/run-{uuid.uuid4().hex}"


def events_stream(r: Relations) -> DataFrame:
    reader = r.spark.readStream.schema(r.table("events").schema).option("pathGlobFilter", "events.parquet")
    return reader.parquet(r.sf_dir).selectExpr(*EVENTS)


def landed(r: Relations, stream: DataFrame) -> DataFrame:
    """Run a stream until its input is used up and return what it wrote."""
    root = scratch(r)
    jobs.started(stream.writeStream.format("parquet").option("path", f"{root}/out"), f"{root}/ck", None).awaitTermination()
    return r.spark.read.parquet(f"{root}/out")


def readings(r: Relations) -> DataFrame:
    return events_stream(r).selectExpr(*INVERTER).withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_hourly_energy",
    """select plant_id, inverter_id, date_trunc('hour', ts) as timestamp_hour, sum(coalesce(ac_power_kw, 0)) / 60.0 as energy_kwh, avg(ac_power_kw) as avg_power_kw,
 count(*) as record_count from inverter group by all
 having date_trunc('hour', min(ts)) + interval 1 hour <= (select max(ts) - interval 10 minutes from inverter)""",
    "inverter", "energy_kwh avg_power_kw",
)
def _(r):
    return landed(r, jobs.hourly_energy(readings(r)))


@query("stream_deduplicated", "select distinct plant_id, inverter_id, date_trunc('hour', ts) as hour from inverter", "inverter")
def _(r):
    hours = readings(r).select(*INVERTER_KEY, F.date_trunc("hour", "ts").alias("hour"))
    return landed(r, jobs.deduplicated(hours, [*INVERTER_KEY, "hour"], "hour"))


@query(
    "stream_failure_sessions",
    """with f as (select plant_id, start_ts as ts, severity, failure_type, start_ts + interval 1 minute * (case severity when 'CRITICAL' then 60 when 'HIGH' then 30 when 'MEDIUM' then 20 else 10 end) as until from failures),
 s as (select *, coalesce(ts > max(until) over (partition by plant_id order by ts, until rows between unbounded preceding and 1 preceding), true) as new from f),
 n as (select *, sum(cast(new as int)) over (partition by plant_id order by ts, until rows unbounded preceding) as session from s)
 select plant_id, min(ts) as start_ts, max(until) as end_ts, max(ts) as last_ts, count(*) as readings,
 case max(case severity when 'CRITICAL' then 3 when 'HIGH' then 2 when 'MEDIUM' then 1 else 0 end) when 3 then 'CRITICAL' when 2 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as severity,
 array_to_string(list_sort(list(distinct failure_type)), ',') as failure_types
 from n group by plant_id, session having max(until) <= (select max(start_ts) - interval 1 hour from failures)""",
    "failures",
)
def _(r):
    failing = events_stream(r).filter("event_type = 'error'").selectExpr(*FAILURES).withColumn("ts", F.col("start_ts").cast("timestamp"))
    sessions = landed(r, jobs.outage_sessions(failing.select("plant_id", "ts", "severity", "failure_type"), ["plant_id"]))
    return sessions.withColumn("failure_types", F.array_join("failure_types", ","))


NEAR = """l as (select event_id as id, concat('P', event_id % 2) as plant_id, ts from e where event_type = 'click'),
 r as (select event_id as meteo_id, concat('P', event_id % 2) as plant_id, ts, case when k = 3 then -60e0 else k - 20e0 end as amb_temp_c from e where event_type = 'view'),
 b as (select l.id, r.meteo_id as bid, epoch_us(l.ts) - epoch_us(r.ts) as bd from l asof left join r on r.plant_id = l.plant_id and l.ts >= r.ts),
 f as (select l.id, r.meteo_id as fid, epoch_us(r.ts) - epoch_us(l.ts) as fd from l asof left join r on r.plant_id = l.plant_id and l.ts < r.ts),
 c as (select l.*, case when bd <= 1.8e9 and (fd is null or bd <= fd) then bid when fd <= 1.8e9 then fid end as meteo_id from l join b using (id) join f using (id))"""


@query(
    "stream_asof_nearest",
    f"""with {NEAR} select c.id, c.plant_id, c.ts, c.meteo_id, r.amb_temp_c from c left join r using (meteo_id)
 where c.ts <= least((select max(ts) from l), (select max(ts) from r)) - interval 90 minutes""",
    "e", "amb_temp_c",
)
def _(r):
    e = events_stream(r).withColumn("ts", F.col("ts").cast("timestamp"))
    left = e.filter("event_type = 'click'").selectExpr(*INVERTER).select("id", "plant_id", "ts")
    right = e.filter("event_type = 'view'").selectExpr(*METEO).select("plant_id", "ts", F.col("id").alias("meteo_id"), "amb_temp_c")
    return landed(r, jobs.nearest_joined(left, right, right_order=["meteo_id"]))


FOREST_BINS = "[hour(ts), minute(ts) // 15, isodow(ts) - 1, month(ts), dayofyear(ts) // 5]"


@query(
    "forest_first_splits",
    f"""with v as (select plant_id, inverter_id, {FOREST_BINS} as b, cast(round(ac_power_kw * 1000) as bigint) as y from inverter_s where ac_power_kw is not null),
 x as (select plant_id, inverter_id, y, unnest(range(5)) as feature, unnest(b) as bin from v),
 h as (select plant_id, inverter_id, feature, bin, count(*) as n, sum(y) as g from x group by all),
 s as (select *, sum(n) over u as nl, sum(g) over u as gl, sum(n) over w as na, sum(g) over w as ga from h
   window u as (partition by plant_id, inverter_id, feature order by bin rows unbounded preceding), w as (partition by plant_id, inverter_id, feature)),
 q as (select *, gl * (gl + 0e0) / (nl + 1e0) + (ga - gl) * (ga - gl + 0e0) / (na - nl + 1e0) - ga * (ga + 0e0) / (na + 1e0) as gain from s where nl >= 5 and na - nl >= 5),
 d as (select *, cast(floor(log10(gain)) as int) - 8 as digits from q where gain > 1e-9)
 select plant_id, inverter_id, cast(feature as int) as feature, cast(bin as int) as bin from d
 qualify row_number() over (partition by plant_id, inverter_id order by digits desc, round(gain * pow(10e0, -digits)) desc, feature, bin) = 1""",
    "inverter_s", ints="feature bin",
)
def _(r):
    cells = forests.cells(r.inverter_s)
    return forests.best_splits(cells.withColumn("node", F.lit(1)).withColumn("g", F.col("y")), INVERTER_KEY, F.lit(5), F.lit(1.0)).drop("node")


@query("forest_scores")
def _(r):
    """Held-out error of the forests of all inverters beside that of their own mean."""
    ensure_checkpoint_dir(r.spark)
    parts = splits.chronological_split(r.inverter_s.select("id", *INVERTER_KEY, "ts", "ac_power_kw").filter("ac_power_kw is not null"), INVERTER_KEY).checkpoint()
    forest, _ = forests.grow(forests.cells(parts.filter("split = 'train'")), trees=4)
    scored = forests.predict(parts.filter("split = 'test'"), forest)
    return metrics.regression_metrics(scored, INVERTER_KEY, "ac_power_kw", "predicted")


@query(
    "stream_bronze_to_gold",
    """select 'inverter_hourly' as layer, plant_id, date_trunc('hour', ts) as at, count(*) as records, sum(value) / 60 as energy_kwh from (
   select concat('P', event_id % 2) as plant_id, user_id % 14 as inv, date_trunc('second', ts) as ts, arg_max(value, event_id) as value
   from e where event_type = 'click' group by all) group by plant_id, date_trunc('hour', ts)
 union all select 'dead_letters', kind, null, count(*), null from (select case when event_type = 'purchase' then 'poi_meter' when event_type = 'view' then 'meteo'
   when k < 30 or k >= 80 then 'unreadable' when k < 60 then 'unknown' else 'inverter' end as kind from e
   where event_type = 'error' or (event_type = 'purchase' and k = 9) or (event_type = 'view' and k = 3)) group by kind""",
    "e", "energy_kwh", decimals=4,
)
def _(r):
    house = Warehouse(r.spark, scratch(r))
    e = events_stream(r).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = e.select(F.expr(MESSAGE).alias("value"), F.col("event_id").alias("offset"))
    jobs.ingest(house, stream, f"{house.root}/ck-in", uuid_plants=False).awaitTermination()
    jobs.bronze_to_gold(house, "inverter", f"{house.root}/ck-inverter").awaitTermination()
    hours = house.read("inverter_hourly").groupBy("plant_id", F.col("timestamp_hour").alias("at")).agg(
        F.sum("record_count").alias("records"), F.sum("energy_kwh").alias("energy_kwh")
    )
    dead = house.read("dead_letters").groupBy(F.col("message_type").alias("plant_id")).agg(F.count(F.lit(1)).alias("records"))
    both = hours.withColumn("layer", F.lit("inverter_hourly")).unionByName(dead.withColumn("layer", F.lit("dead_letters")), allowMissingColumns=True)
    return both.select("layer", "plant_id", "at", "records", "energy_kwh")


@query(
    "stream_all_feeds_to_plant",
    """with i as (select concat('P', event_id % 2) as plant_id, user_id % 14 as inv, date_trunc('second', ts) as ts, arg_max(value, event_id) as value from e where event_type = 'click' group by all),
 m as (select concat('P', event_id % 2) as plant_id, date_trunc('second', ts) - interval 1 hour as ts, arg_max(value * 5e0, event_id) as poa from e where event_type = 'view' and k <> 3 group by all),
 p as (select concat('P', event_id % 2) as plant_id, date_trunc('second', ts) as ts, arg_max(value, event_id) as export from e where event_type = 'purchase' and k <> 9 group by all),
 s as (select concat('P', event_id % 2) as plant_id, date_trunc('second', ts) as ts, arg_max(k * 0.0111e0, event_id) as stress from e where event_type = 'signup' group by all),
 ih as (select plant_id, date_trunc('hour', ts) as timestamp_hour, sum(value) / 60 as generation_kwh, count(distinct inv) as total_inverters from i group by all),
 mh as (select plant_id, date_trunc('hour', ts) as timestamp_hour, sum(poa) / 60 as irradiation from m group by all),
 ph as (select plant_id, date_trunc('hour', ts) as timestamp_hour, sum(export) / 60 as export from p group by all),
 sh as (select plant_id, date_trunc('hour', ts) as timestamp_hour, avg(stress) as stress from s group by all)
 select plant_id, timestamp_hour, generation_kwh, total_inverters, coalesce(irradiation, 0) as irradiation_wh_m2, coalesce(export, 0) as grid_export_kwh, coalesce(stress, 0) as system_stress_avg
 from ih left join mh using (plant_id, timestamp_hour) left join ph using (plant_id, timestamp_hour) left join sh using (plant_id, timestamp_hour)""",
    "e", "generation_kwh irradiation_wh_m2 grid_export_kwh system_stress_avg", "total_inverters", decimals=4,
)
def _(r):
    """All four feeds to the plant rows by their one writer; the weather starts when the others are done."""
    house = Warehouse(r.spark, scratch(r))
    e = events_stream(r).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = e.select(F.expr(MESSAGE).alias("value"), F.col("event_id").alias("offset"))
    jobs.ingest(house, stream, f"{house.root}/ck-in", uuid_plants=False).awaitTermination()
    for kinds in (("inverter", "poi_meter", "system_status"), ("meteo",)):
        running = [jobs.bronze_to_gold(house, kind, f"{house.root}/ck-{kind}") for kind in kinds]
        for one in running:
            one.awaitTermination()
        jobs.plants_to_gold(house, f"{house.root}/ck-plants").awaitTermination()
    return house.read("plant_hourly_summary").select(
        "plant_id", "timestamp_hour", F.col("total_generation_kwh").alias("generation_kwh"), "total_inverters", "irradiation_wh_m2", "grid_export_kwh", "system_stress_avg"
    )


@query(
    "run_metrics",
    """select case when event_type = 'click' or (event_type = 'error' and k between 60 and 79) then 'inverter' when event_type = 'view' then 'meteo' when event_type = 'purchase' then 'poi_meter'
  when event_type = 'signup' then 'system_status' when k < 30 or k >= 80 then 'unreadable' else 'unknown' end as message_type,
 count(*) filter (event_type <> 'error' and not (event_type = 'purchase' and k = 9) and not (event_type = 'view' and k = 3)) as processed,
 count(*) filter (event_type = 'error' or (event_type = 'purchase' and k = 9) or (event_type = 'view' and k = 3)) as failed from e group by 1""",
    "e",
)
def _(r):
    house = Warehouse(r.spark, scratch(r))
    stream = events_stream(r).withColumn("ts", F.col("ts").cast("timestamp")).select(F.expr(MESSAGE).alias("value"), F.col("event_id").alias("offset"))
    jobs.ingest(house, stream, f"{house.root}/ck", uuid_plants=False).awaitTermination()
    return house.read("run_metrics").groupBy("message_type").agg(F.sum("processed").alias("processed"), F.sum("failed").alias("failed"))


@query(
    "forecast_job",
    """with l as (select plant_id, inverter_id, max(ts) as last_ts from inverter_s group by all),
 g as (select plant_id, inverter_id, last_ts + to_minutes(15 * i) as ts from l, (select unnest(range(1, 193)) as i)),
 m as (select plant_id, inverter_id, hour(ts) as h, avg(ac_power_kw) as predicted from inverter_s group by all)
 select g.plant_id, g.inverter_id, g.ts, 'hour-mean' as model_run_id, predicted as predicted_ac_power_kw
 from g join m on m.plant_id = g.plant_id and m.inverter_id = g.inverter_id and m.h = hour(g.ts) where predicted is not null""",
    "inverter_s", "predicted_ac_power_kw",
)
def _(r):
    """The stored forecasts of a job that is run twice, with the mean of the hour as model."""
    house = Warehouse(r.spark, scratch(r))
    house.upsert(r.inverter_s, "silver_inverter", ["id"], "ts")
    hours = r.inverter_s.groupBy(*INVERTER_KEY, F.hour("ts").alias("h")).agg(F.avg("ac_power_kw").alias("predicted_ac_power_kw"))

    def predict(grid: DataFrame) -> DataFrame:
        return grid.withColumn("h", F.hour("ts")).join(hours, [*INVERTER_KEY, "h"])

    for _ in range(2):
        jobs.store_forecasts(house, predict, "hour-mean")
    return house.read("forecast_predictions").select(*INVERTER_KEY, "ts", "model_run_id", "predicted_ac_power_kw")


@query("anomaly_cells", "select plant_id, inverter_id, ts, avg(reconstruction_error) as error from anomalies group by all", "anomalies", "error")
def _(r):
    return dashboard.anomaly_cells(r.anomalies)


@query("dataset_fingerprint")
def _(r):
    return metrics.fingerprint(r.inverter_s.drop("failure_types"))


@query("forecast_model_scores")
def _(r):
    ensure_checkpoint_dir(r.spark)
    rows = r.inverter_s.select("id", *INVERTER_KEY, "ts", "ac_power_kw")
    parts = splits.chronological_split(rows, INVERTER_KEY).checkpoint()
    model = models.fit_forecaster(parts.filter("split = 'train'"))
    return models.evaluate_forecaster(model, parts.filter("split = 'test'"))


@query("anomaly_model_scores")
def _(r):
    ensure_checkpoint_dir(r.spark)
    weather = r.meteo.select("plant_id", "ts", F.col("id").alias("meteo_id"), "amb_temp_c", "module_temp_c", "wind_speed_ms", "humidity_percent", "poa_irradiance_wm2")
    joined = timeseries.asof_nearest(r.inverter_s, weather, 7200, right_order=["meteo_id"]).withColumn("is_anomaly", anomaly_label())
    columns = [c for c in models.ANOMALY_COLUMNS if c in joined.columns]
    # stored, because keys are measured before they are cut
    rows = joined.select("id", *INVERTER_KEY, "ts", *columns, "is_anomaly").checkpoint()
    filled = timeseries.fill_gaps(rows, INVERTER_KEY, columns).checkpoint()
    parts = splits.normal_only_split(filled, INVERTER_KEY).checkpoint()
    model = models.fit_anomaly_model(parts.filter("split = 'train'"), k=5)
    return models.evaluate_anomaly_model(model, parts.filter("split = 'test'"))
