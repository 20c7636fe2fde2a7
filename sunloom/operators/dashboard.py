"""Data behind the operator's dashboard."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.functions.quality import availability_tier
from sunloom.functions.temporal import floor_minutes, percent_change
from sunloom.operators.timeseries import latest_per_key
from sunloom.plans.skew import lookup


INVERTER = ("plant_id", "inverter_id")


def forecast_15min(forecasts: DataFrame, by: Sequence[str] = INVERTER, ts: str = "ts", value: str = "predicted_ac_power_kw") -> DataFrame:
    """Mean forecast per inverter and quarter of an hour."""
    return forecasts.groupBy(floor_minutes(ts, 15).alias(ts), *by).agg(F.avg(value).alias(value))


def forecast_plant_sum(forecasts: DataFrame, by: Sequence[str] = ("plant_id",), ts: str = "ts", value: str = "predicted_ac_power_kw") -> DataFrame:
    return forecasts.groupBy(*by, ts).agg(F.sum(value).alias("forecast_kw"))


def forecast_vs_actual(summary: DataFrame, forecasts: DataFrame, by: Sequence[str] = ("plant_id",), ts: str = "ts", hourly: bool = False) -> DataFrame:
    """Actual plant power with the summed forecasts of the hour.

    The forecast is summed per time stamp and the stamp cut to the hour, so an hour
    can match several rows; ``hourly`` averages them to one.
    """
    f = forecast_plant_sum(forecasts, by, ts).withColumn("timestamp_hour", F.date_trunc("hour", ts)).drop(ts)
    if hourly:
        f = f.groupBy(*by, "timestamp_hour").agg(F.avg("forecast_kw").alias("forecast_kw"))
    actual = summary.select(*by, "timestamp_hour", F.col("total_power_kw").alias("actual_kw"))
    return actual.join(f, [*by, "timestamp_hour"]).withColumn("error_kw", F.col("forecast_kw") - F.col("actual_kw"))


def dashboard_mape(pairs: DataFrame, by: Sequence[str] = ("plant_id",)) -> DataFrame:
    """MAPE in percent with zero actuals counted as 1; NULL unless power was produced."""
    actual = F.col("actual_kw")
    per_row = F.abs(F.col("forecast_kw") - actual) / F.when(actual == 0, 1.0).otherwise(actual)
    return pairs.groupBy(*by).agg(
        F.when(F.sum("actual_kw") > 0, F.avg(per_row) * 100).alias("mape"), F.count(F.lit(1)).alias("pairs")
    )


def anomaly_heatmap(predictions: DataFrame, start: datetime, days: int, by: Sequence[str] = INVERTER, ts: str = "ts") -> DataFrame:
    """Mean error per inverter, one column per day.

    The column list follows from the report's range, so no pass is needed to find it.
    """
    labels = [(start + timedelta(days=d)).strftime("%Y-%m-%d") for d in range(days)]
    day = predictions.withColumn("_day", F.date_format(ts, "yyyy-MM-dd"))
    wide = day.groupBy(*by).pivot("_day", labels).agg(F.avg("reconstruction_error"))
    return wide.select(*by, *[F.col(c).alias("d_" + c.replace("-", "_")) for c in labels])


def anomaly_cells(predictions: DataFrame, by: Sequence[str] = INVERTER, ts: str = "ts") -> DataFrame:
    """The heat map in long form, for any range and time stamps."""
    return predictions.groupBy(*by, ts).agg(F.avg("reconstruction_error").alias("error"))


def kpi_delta(summary: DataFrame, by: Sequence[str] = ("plant_id",)) -> DataFrame:
    """Power of the newest hour and its change from the hour row before.

    The input has one row per plant and hour.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("timestamp_hour"))
    pair = summary.select(*by, "timestamp_hour", "total_power_kw", F.row_number().over(w).alias("_n")).filter("_n <= 2")
    newest, before = F.max(F.when(F.col("_n") == 1, F.col("total_power_kw"))), F.max(F.when(F.col("_n") == 2, F.col("total_power_kw")))
    return pair.groupBy(*by).agg(F.max("timestamp_hour").alias("timestamp_hour"), newest.alias("current_kw"), before.alias("previous_kw")).withColumn(
        "delta_percent", percent_change(F.col("current_kw"), F.col("previous_kw"))
    )


def kpi_row(summary: DataFrame, anomalies: DataFrame, by: Sequence[str] = ("plant_id",)) -> DataFrame:
    """Energy of the window, the newest performance ratio and inverters, and alerts."""
    newest = F.struct("instantaneous_pr", "active_inverters", "total_inverters")
    energy = summary.groupBy(*by).agg(F.sum("total_generation_kwh").alias("total_energy_kwh"), F.max_by(newest, "timestamp_hour").alias("_n"))
    alerts = anomalies.filter("is_anomaly = 1").groupBy(*by).agg(F.count(F.lit(1)).alias("alerts"))
    return energy.select(*by, "total_energy_kwh", "_n.*").join(alerts, list(by), "left").withColumn("alerts", F.coalesce("alerts", F.lit(0)))


def latest_per_inverter(hours: DataFrame, by: Sequence[str] = ("plant_id", "inverter_id")) -> DataFrame:
    return latest_per_key(hours, by, "timestamp_hour")


def availability_by_tier(hours: DataFrame, by: Sequence[str] = ("plant_id", "inverter_id")) -> DataFrame:
    latest = latest_per_inverter(hours.select(*by, "timestamp_hour", "availability_percent"), by)
    return latest.withColumn("tier", availability_tier())


def fixed(c: str, decimals: int) -> Column:
    """Number as text with fixed decimals, half to even."""
    return F.translate(F.format_number(c, decimals), ",", "")


def alerts(anomalies: DataFrame, hours: DataFrame, by: Sequence[str] = ("plant_id",), low: float = 80.0) -> DataFrame:
    """Anomalies, and inverters whose newest availability is below the limit."""
    odd = anomalies.select(
        *by, F.col("ts"), F.col("inverter_id").alias("source"), F.lit("Anomaly").alias("type"),
        F.concat(F.lit("Reconstruction error: "), fixed("reconstruction_error", 4)).alias("message"),
    )
    latest = latest_per_inverter(hours.select(*by, "inverter_id", "timestamp_hour", "availability_percent"), [*by, "inverter_id"])
    idle = latest.filter(F.col("availability_percent") < low).select(
        *by, F.col("timestamp_hour").alias("ts"), F.col("inverter_id").alias("source"), F.lit("Availability").alias("type"),
        F.concat(F.lit("Low availability: "), fixed("availability_percent", 1), F.lit("%")).alias("message"),
    )
    return odd.unionByName(idle)


def newest_alerts(rows: DataFrame, n: int = 10) -> DataFrame:
    newest = rows.orderBy(F.desc("ts"), "source", "type", "message").limit(n)
    return newest.withColumn("clock", F.coalesce(F.date_format("ts", "HH:mm"), F.lit("--:--")))


def threshold_alerts(silver: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Readings beyond the configured limits, with name, limit and severity.

    The limits of a plant become one row of columns, so a reading meets them in a
    single join and only the alerts it raises are listed.
    """
    names = ["temp_warning_c", "temp_critical_c", "efficiency_alert_min", "efficiency_warning_min", "freq_deviation_warning_hz", "freq_deviation_critical_hz"]
    mine = thresholds.filter((F.col("threshold_category") == "inverter") & F.col("threshold_name").isin(*names))
    wide = mine.groupBy("plant_id").agg(
        *[F.max(F.when(F.col("threshold_name") == n, F.struct("threshold_value", "severity"))).alias(n) for n in names]
    )
    j = silver.join(lookup(wide), "plant_id")

    def hit(name: str, value: Column, test) -> Column:
        limit = F.col(name)["threshold_value"]
        body = F.struct(F.lit(name).alias("alert"), value.alias("value"), limit.alias("limit"), F.col(name)["severity"].alias("severity"))
        return F.when(test(value, limit), body)

    temp, eff = F.col("inverter_temp_c"), F.col("instant_efficiency")
    off = F.abs(F.col("ac_freq_hz") - 50)
    above, below = (lambda v, t: v > t), (lambda v, t: v < t)
    found = F.array(
        *[hit(n, temp, above) for n in names[:2]], *[hit(n, eff, below) for n in names[2:4]], *[hit(n, off, above) for n in names[4:]]
    )
    listed = j.select("plant_id", "inverter_id", "ts", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a"))
    return listed.select("plant_id", "inverter_id", "ts", "a.*")


# Measure of each configured limit and whether a reading alerts above it.
LIMITS = [
    ("inverter", "temp_warning_c", "inverter", "temperature", True),
    ("inverter", "temp_critical_c", "inverter", "temperature", True),
    ("inverter", "efficiency_alert_min", "inverter", "efficiency", False),
    ("inverter", "efficiency_warning_min", "inverter", "efficiency", False),
    ("inverter", "freq_deviation_warning_hz", "inverter", "frequency_deviation", True),
    ("inverter", "freq_deviation_critical_hz", "inverter", "frequency_deviation", True),
    ("dc_diagnostics", "string_current_imbalance_pct", "inverter", "string_loss_pct", True),
    ("dc_diagnostics", "voltage_deviation_pct", "inverter", "dc_voltage_deviation_pct", True),
    ("dc_diagnostics", "min_power_for_efficiency_calc_kw", "inverter", None, None),
    ("poi_meter", "voltage_deviation_warning_pct", "poi_meter", "grid_voltage_deviation_pct", True),
    ("poi_meter", "voltage_deviation_critical_pct", "poi_meter", "grid_voltage_deviation_pct", True),
    ("poi_meter", "power_factor_warning_min", "poi_meter", "power_factor", False),
    ("poi_meter", "power_factor_critical_min", "poi_meter", "power_factor", False),
]


def off_percent(c: str, nominal: float) -> Column:
    return F.abs(F.col(c) - nominal) / nominal * 100


def limit_measures(nominal_dc_v: float, nominal_grid_v: float) -> dict[str, dict[str, Column]]:
    """What the limits of each feed are compared with."""
    strings = F.col("healthy_strings") + F.col("failed_strings")
    return {
        "inverter": {
            "temperature": F.col("inverter_temp_c"), "efficiency": F.col("instant_efficiency"), "frequency_deviation": F.abs(F.col("ac_freq_hz") - 50),
            "string_loss_pct": F.try_divide(F.col("failed_strings") * 100.0, strings), "dc_voltage_deviation_pct": off_percent("dc_voltage_v", nominal_dc_v),
        },
        "poi_meter": {
            "grid_voltage_deviation_pct": F.greatest(*(off_percent(f"grid_voltage_l{i}_v", nominal_grid_v) for i in (1, 2, 3))),
            "power_factor": F.col("power_factor"),
        },
    }


def limit_alerts(feeds: dict[str, DataFrame], thresholds: DataFrame, nominal_dc_v: float, nominal_grid_v: float) -> DataFrame:
    """Readings beyond any configured limit: plant_id, source, ts, category, alert, measure, value, limit, severity.

    ``feeds`` has silver rows of ``inverter`` and ``poi_meter``; ``thresholds`` are rows as
    in the threshold dimension. A limit is a row: those of a plant and feed are packed
    into one array, at most as long as ``LIMITS``, that a reading meets in one join, and
    only the alerts it raises are listed. Strings of an inverter are judged by the share
    that failed, voltages by their distance from the nominal one, the grid by its worst
    phase. Efficiency is judged from ``min_power_for_efficiency_calc_kw`` on. A missing
    reading or limit raises nothing; a reading equal to its limit does not either.
    """
    spark = thresholds.sparkSession
    # a fixed table of a dozen rows, so broadcasting it is bounded
    rules = F.broadcast(spark.createDataFrame(LIMITS, "threshold_category string, threshold_name string, feed string, measure string, above boolean"))
    known = thresholds.join(rules, ["threshold_category", "threshold_name"]).filter("threshold_value is not null")
    body = F.struct(
        F.col("threshold_category").alias("category"), F.col("threshold_name").alias("alert"), "measure", "above",
        F.col("threshold_value").cast("double").alias("limit"), "severity",
    )
    packed = known.groupBy("plant_id", "feed").agg(
        F.collect_list(F.when(F.col("measure").isNotNull(), body)).alias("_limits"),
        F.max(F.when(F.col("measure").isNull(), F.col("threshold_value").cast("double"))).alias("_least_kw"),
    )
    packed = lookup(packed)
    measures = limit_measures(nominal_dc_v, nominal_grid_v)
    found = []
    for feed, rows in feeds.items():
        mine = packed.filter(F.col("feed") == feed).select(F.col("plant_id").alias("_plant"), "_limits", "_least_kw")
        met = rows.join(mine, F.col("plant_id") == F.col("_plant"))
        values = dict(measures[feed])
        if feed == "inverter":
            enough = F.col("_least_kw").isNull() | (F.col("ac_power_kw") >= F.col("_least_kw"))
            values["efficiency"] = F.when(enough, values["efficiency"])
        of = F.create_map(*(x for name, value in values.items() for x in (F.lit(name), value.cast("double"))))
        source = F.col("inverter_id") if feed == "inverter" else F.lit(feed)
        seen = met.select("plant_id", source.alias("source"), "ts", of.alias("_of"), "_limits")
        hits = F.filter(
            F.transform("_limits", lambda x: F.struct(x.alias("rule"), F.try_element_at(F.col("_of"), x["measure"]).alias("value"))),
            lambda x: F.when(x["rule"]["above"], x["value"] > x["rule"]["limit"]).otherwise(x["value"] < x["rule"]["limit"]),
        )
        found.append(seen.select("plant_id", "source", "ts", F.explode(hits).alias("h")))
    listed = reduce(DataFrame.unionByName, found)
    return listed.select("plant_id", "source", "ts", *(F.col(f"h.rule.{c}").alias(c) for c in ("category", "alert", "measure")), F.col("h.value").alias("value"), F.col("h.rule.limit").alias("limit"), F.col("h.rule.severity").alias("severity"))
