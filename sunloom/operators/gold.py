"""Hourly, daily and plant-level aggregates of the clean tables.

Every level is one aggregation over all keys, with partial sums before the
shuffle. The hour is the finest key, so a plant that owns most of the rows is
still spread over its inverters and hours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INVERTER_HOUR = ["plant_id", "inverter_id", "timestamp_hour"]
PLANT_HOUR = ["plant_id", "timestamp_hour"]

# Fixed values of the plant indicators.
DEFAULT_CAPACITY_KWP = 1260.0
MODULE_TEMP_COEFFICIENT = -0.004
STC_TEMPERATURE_C = 25.0
SUNSHINE_WM2 = 120.0


def share(test: Column) -> Column:
    """Percent of the rows of the group for which the test holds."""
    return F.count_if(test) / F.count(F.lit(1)) * 100


def spread(c: str, avg: str, low: str, high: str) -> list[Column]:
    return [F.avg(c).alias(avg), F.min(c).alias(low), F.max(c).alias(high)]


def energy(c: str, per_hour: float) -> Column:
    """Power readings summed to energy; a missing reading counts as zero."""
    return F.sum(F.coalesce(F.col(c), F.lit(0.0))) / per_hour


def records(flag: str = "data_quality_flag") -> list[Column]:
    return [F.count(F.lit(1)).alias("record_count"), F.count_if(F.col(flag) == "valid").alias("valid_record_count")]


def by_hour(df: DataFrame, keys: Sequence[str], ts: str = "ts"):
    return df.groupBy(*keys, F.date_trunc("hour", ts).alias("timestamp_hour"))


def by_day(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*keys, F.to_date("timestamp_hour").alias("date"))


def inverter_hourly(silver: DataFrame, samples_per_hour: float = 60.0, extended: bool = False) -> DataFrame:
    """Energy, power, temperature, availability and failures per inverter and hour.

    ``extended`` adds the DC and efficiency columns that the daily table declares.
    The failure types of an hour are the distinct non-empty lists seen in it.
    """
    running = F.col("state") == 1
    # DISTINCT lets Spark hash-aggregate the measures first and list the few kinds last;
    # collect_set would turn the whole aggregation into a sort of the readings
    kinds = F.expr("collect_list(distinct if(size(failure_types) > 0, failure_types, null))")
    cols = [
        energy("ac_power_kw", samples_per_hour).alias("energy_kwh"),
        *spread("ac_power_kw", "avg_power_kw", "min_power_kw", "max_power_kw"),
        *spread("inverter_temp_c", "temp_avg_c", "temp_min_c", "temp_max_c"),
        F.avg("ac_freq_hz").alias("freq_avg_hz"),
        share(running).alias("availability_percent"),
        F.count_if(running).alias("operating_minutes"),
        F.sum(F.coalesce("active_failures", F.lit(0))).alias("failure_count"),
        F.array_sort(kinds).alias("failure_types"),
        *records(),
    ]
    if extended:
        cols += [
            energy("dc_power_kw", samples_per_hour).alias("dc_energy_kwh"),
            F.avg("dc_voltage_v").alias("avg_dc_voltage_v"),
            F.avg("dc_current_a").alias("avg_dc_current_a"),
            F.avg("instant_efficiency").alias("avg_efficiency"),
            F.min("instant_efficiency").alias("min_efficiency"),
            F.count_if(F.col("efficiency_flag") != "normal").alias("efficiency_below_threshold_minutes"),
            F.count_if(F.col("failed_strings") > 0).alias("string_failure_events"),
        ]
    return by_hour(silver, ["plant_id", "inverter_id"]).agg(*cols)


def inverter_daily(hourly: DataFrame, extended: bool = False) -> DataFrame:
    """Daily roll-up of the hourly rows; averages are averages of hourly averages."""
    filled = F.when(F.size("failure_types") > 0, F.struct("timestamp_hour", "failure_types"))
    cols = [
        F.sum("energy_kwh").alias("total_energy_kwh"),
        F.max("max_power_kw").alias("peak_power_kw"),
        F.avg("avg_power_kw").alias("avg_power_kw"),
        F.min("min_power_kw").alias("min_power_kw"),
        F.avg("temp_avg_c").alias("temp_avg_c"),
        F.min("temp_min_c").alias("temp_min_c"),
        F.max("temp_max_c").alias("temp_max_c"),
        *spread("freq_avg_hz", "freq_avg_hz", "freq_min_hz", "freq_max_hz"),
        F.avg("availability_percent").alias("availability_percent"),
        (F.sum("operating_minutes") / 60).alias("operating_hours"),
        F.sum("record_count").alias("total_records"),
        F.sum("valid_record_count").alias("valid_records"),
        F.sum("failure_count").alias("total_failures"),
        # at most 24 hourly lists per group
        F.transform(F.array_sort(F.collect_list(filled)), lambda s: s["failure_types"]).alias("failure_types_summary"),
    ]
    if extended:
        cols += [
            F.sum("dc_energy_kwh").alias("dc_energy_kwh"),
            F.avg("avg_dc_voltage_v").alias("avg_dc_voltage_v"),
            F.avg("avg_dc_current_a").alias("avg_dc_current_a"),
            F.avg("avg_efficiency").alias("avg_efficiency"),
            F.min("min_efficiency").alias("min_efficiency"),
            F.sum("efficiency_below_threshold_minutes").alias("efficiency_below_threshold_minutes"),
            F.sum("string_failure_events").alias("string_failure_events"),
        ]
    return by_day(hourly, ["plant_id", "inverter_id"]).agg(*cols)


def meteo_hourly(silver: DataFrame, samples_per_hour: float = 60.0, circular_wind: bool = False) -> DataFrame:
    """Weather per plant and hour; the wind direction is a plain mean unless asked."""
    cols = [
        *spread("amb_temp_c", "temp_avg_c", "temp_min_c", "temp_max_c"),
        *spread("module_temp_c", "module_temp_avg_c", "module_temp_min_c", "module_temp_max_c"),
        *spread("humidity_percent", "humidity_avg_percent", "humidity_min_percent", "humidity_max_percent"),
        F.avg("wind_speed_ms").alias("wind_speed_avg_ms"),
        F.max("wind_speed_ms").alias("wind_speed_max_ms"),
        F.avg("wind_dir_deg").alias("wind_dir_avg_deg"),
        energy("poa_irradiance_wm2", samples_per_hour).alias("irradiation_wh_m2"),
        F.avg("poa_irradiance_wm2").alias("avg_irradiance_wm2"),
        F.max("poa_irradiance_wm2").alias("peak_irradiance_wm2"),
        *records(),
    ]
    if circular_wind:
        rad = F.radians("wind_dir_deg")
        mean = F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad))))
        cols.append(F.pmod(mean, F.lit(360.0)).alias("wind_dir_circular_deg"))
    return by_hour(silver, ["plant_id"]).agg(*cols)


def meteo_daily(hourly: DataFrame) -> DataFrame:
    return by_day(hourly, ["plant_id"]).agg(
        F.avg("temp_avg_c").alias("temp_avg_c"),
        F.min("temp_min_c").alias("temp_min_c"),
        F.max("temp_max_c").alias("temp_max_c"),
        F.avg("module_temp_avg_c").alias("module_temp_avg_c"),
        F.min("module_temp_min_c").alias("module_temp_min_c"),
        F.max("module_temp_max_c").alias("module_temp_max_c"),
        F.avg("humidity_avg_percent").alias("humidity_avg_percent"),
        F.min("humidity_min_percent").alias("humidity_min_percent"),
        F.max("humidity_max_percent").alias("humidity_max_percent"),
        F.avg("wind_speed_avg_ms").alias("wind_speed_avg_ms"),
        F.max("wind_speed_max_ms").alias("wind_speed_max_ms"),
        F.avg("wind_dir_avg_deg").alias("predominant_wind_dir_deg"),
        (F.sum("irradiation_wh_m2") / 1000).alias("total_irradiation_kwh_m2"),
        F.max("peak_irradiance_wm2").alias("peak_irradiance_wm2"),
        F.avg("avg_irradiance_wm2").alias("avg_irradiance_wm2"),
        F.count_if(F.col("avg_irradiance_wm2") > SUNSHINE_WM2).alias("sunshine_hours"),
        F.sum("record_count").alias("total_records"),
        F.sum("valid_record_count").alias("valid_records"),
    )


def poi_hourly(silver: DataFrame, samples_per_hour: float = 60.0, phase_imbalance: bool = False) -> DataFrame:
    """Grid exchange per plant and hour.

    Average export and import leave out zero readings. ``voltage_imbalance_pct``
    is the variation of the sum of the phases over the hour; ``phase_imbalance``
    adds the mean largest deviation of a phase from the mean of the three.
    """
    v = [F.col(f"grid_voltage_l{i}_v") for i in (1, 2, 3)]
    total = v[0] + v[1] + v[2]
    freq, cut = F.col("grid_frequency_hz"), F.col("connection_issues")
    cols = [
        energy("export_active_power_kw", samples_per_hour).alias("export_energy_kwh"),
        energy("import_active_power_kw", samples_per_hour).alias("import_energy_kwh"),
        energy("reactive_power_kvar", samples_per_hour).alias("reactive_kvarh"),
        F.avg(F.nullif(F.col("export_active_power_kw"), F.lit(0.0))).alias("avg_export_kw"),
        F.max("export_active_power_kw").alias("max_export_kw"),
        F.avg(F.nullif(F.col("import_active_power_kw"), F.lit(0.0))).alias("avg_import_kw"),
        F.max("import_active_power_kw").alias("max_import_kw"),
        F.avg("reactive_power_kvar").alias("avg_reactive_kvar"),
        *[F.avg(f"grid_voltage_l{i}_v").alias(f"voltage_l{i}_avg_v") for i in (1, 2, 3)],
        (F.try_divide(F.stddev_samp(total), F.avg(total)) * 100).alias("voltage_imbalance_pct"),
        *spread("grid_frequency_hz", "frequency_avg_hz", "frequency_min_hz", "frequency_max_hz"),
        F.count_if((freq < 49.5) | (freq > 50.5)).alias("frequency_deviation_count"),
        F.avg("power_factor").alias("power_factor_avg"),
        F.min("power_factor").alias("power_factor_min"),
        share(~cut).alias("availability_percent"),
        F.count_if(cut).alias("connection_issue_minutes"),
        F.sum(F.coalesce("active_failures", F.lit(0))).alias("failure_count"),
        *records(),
    ]
    if phase_imbalance:
        mean = total / 3
        worst = F.greatest(*[F.abs(x - mean) for x in v])
        cols.append(F.avg(F.try_divide(worst, mean) * 100).alias("phase_imbalance_pct"))
    return by_hour(silver, ["plant_id"]).agg(*cols)


def poi_daily(hourly: DataFrame) -> DataFrame:
    """Daily roll-up. ``voltage_deviation_minutes`` counts hours, on the first phase only."""
    l1 = F.col("voltage_l1_avg_v")
    return by_day(hourly, ["plant_id"]).agg(
        F.sum("export_energy_kwh").alias("total_export_kwh"),
        F.sum("import_energy_kwh").alias("total_import_kwh"),
        F.max("max_export_kw").alias("peak_export_kw"),
        F.max("max_import_kw").alias("peak_import_kw"),
        F.avg("avg_export_kw").alias("avg_export_kw"),
        F.avg("avg_import_kw").alias("avg_import_kw"),
        F.sum("reactive_kvarh").alias("total_reactive_kvarh"),
        F.avg("avg_reactive_kvar").alias("avg_reactive_kvar"),
        *[F.avg(f"voltage_l{i}_avg_v").alias(f"voltage_l{i}_avg_v") for i in (1, 2, 3)],
        F.avg("voltage_imbalance_pct").alias("voltage_imbalance_pct"),
        F.count_if((l1 < 360) | (l1 > 440)).alias("voltage_deviation_minutes"),
        F.avg("frequency_avg_hz").alias("frequency_avg_hz"),
        F.min("frequency_min_hz").alias("frequency_min_hz"),
        F.max("frequency_max_hz").alias("frequency_max_hz"),
        F.sum("frequency_deviation_count").alias("frequency_deviation_minutes"),
        F.avg("power_factor_avg").alias("power_factor_avg"),
        F.min("power_factor_min").alias("power_factor_min"),
        F.max("power_factor_avg").alias("power_factor_max"),
        F.avg("availability_percent").alias("availability_percent"),
        (F.sum("connection_issue_minutes") / 60).alias("connection_issue_hours"),
        F.sum("failure_count").alias("total_failures"),
        F.sum("record_count").alias("total_records"),
        F.sum("valid_record_count").alias("valid_records"),
    )


def status_hourly(silver: DataFrame) -> DataFrame:
    return by_hour(silver, ["plant_id"]).agg(
        F.sum("total_failures").alias("total_failures"),
        F.max("total_failures").alias("max_concurrent_failures"),
        F.avg("total_failures").alias("avg_failures"),
        *spread("stress_level", "stress_level_avg", "stress_level_min", "stress_level_max"),
        F.avg("healthy_components").alias("avg_healthy_components"),
        F.min("healthy_components").alias("min_healthy_components"),
        F.avg("failed_components").alias("avg_failed_components"),
        F.max("failed_components").alias("max_failed_components"),
        F.sum("critical_failures").alias("critical_failure_count"),
        F.max("critical_failures").alias("max_concurrent_critical"),
        *records(),
    )


def status_daily(hourly: DataFrame) -> DataFrame:
    return by_day(hourly, ["plant_id"]).agg(
        F.sum("total_failures").alias("total_failures_sum"),
        F.max("max_concurrent_failures").alias("max_concurrent_failures"),
        F.avg("avg_failures").alias("avg_failures"),
        F.avg("stress_level_avg").alias("stress_level_avg"),
        F.max("stress_level_max").alias("stress_level_max"),
        F.min("stress_level_min").alias("stress_level_min"),
        F.avg("avg_healthy_components").alias("avg_healthy_components"),
        F.min("min_healthy_components").alias("min_healthy_components"),
        F.avg("avg_failed_components").alias("avg_failed_components"),
        F.max("max_failed_components").alias("max_failed_components"),
        F.sum("critical_failure_count").alias("total_critical_failures"),
        F.max("max_concurrent_critical").alias("max_concurrent_critical"),
        F.sum("record_count").alias("total_records"),
        F.sum("valid_record_count").alias("valid_records"),
    )


def with_capacity(df: DataFrame, capacity: DataFrame | None) -> DataFrame:
    """Add ``capacity_kwp`` from the plant dimension, or the default."""
    if capacity is None:
        return df.withColumn("capacity_kwp", F.lit(DEFAULT_CAPACITY_KWP))
    joined = df.join(capacity.select("plant_id", "capacity_kwp"), "plant_id", "left")
    return joined.withColumn("capacity_kwp", F.coalesce("capacity_kwp", F.lit(DEFAULT_CAPACITY_KWP)))


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def performance_ratio(generation: Column, irradiation_kwh_m2: Column, capacity: Column) -> Column:
    """Share of the theoretical yield, at most 1; NULL without sun."""
    return F.when(irradiation_kwh_m2 > 0, F.least(F.lit(1.0), F.try_divide(generation, irradiation_kwh_m2 * capacity)))


def completeness() -> Column:
    """Reporting inverters that produced, in percent of those that reported."""
    return F.when(F.col("total_inverters") > 0, F.col("active_inverters") / F.col("total_inverters") * 100).otherwise(100.0)


def plant_hourly_summary(
    inverter_hours: DataFrame, meteo_hours: DataFrame, poi_hours: DataFrame, status_silver: DataFrame,
    capacity: DataFrame | None = None,
) -> DataFrame:
    """Energy balance and performance ratio per plant and hour.

    The sides are aggregated to (plant, hour) before they meet, so each join is
    one row to one row on a shared key and partitioning.
    """
    inv = inverter_hours.groupBy(*PLANT_HOUR).agg(
        F.sum("energy_kwh").alias("total_generation_kwh"),
        F.sum("avg_power_kw").alias("total_power_kw"),
        F.count_if(F.col("energy_kwh") > 0).alias("active_inverters"),
        F.count(F.lit(1)).alias("total_inverters"),
        F.sum("failure_count").alias("failure_count"),
    )
    met = meteo_hours.select(
        *PLANT_HOUR, "irradiation_wh_m2", "avg_irradiance_wm2",
        F.col("temp_avg_c").alias("avg_ambient_temp_c"), F.col("module_temp_avg_c").alias("avg_module_temp_c"),
    )
    poi = poi_hours.select(*PLANT_HOUR, "import_energy_kwh", "export_energy_kwh", "avg_import_kw")
    stress = by_hour(status_silver, ["plant_id"]).agg(F.avg("stress_level").alias("stress"))
    joined = inv.join(met, PLANT_HOUR, "left").join(poi, PLANT_HOUR, "left").join(stress, PLANT_HOUR, "left")
    gen, imported = F.col("total_generation_kwh"), zero("import_energy_kwh")
    return with_capacity(joined, capacity).select(
        *PLANT_HOUR,
        "total_generation_kwh",
        imported.alias("total_consumption_kwh"),
        (gen - imported).alias("net_energy_kwh"),
        F.least(gen, imported).alias("self_consumption_kwh"),
        zero("export_energy_kwh").alias("grid_export_kwh"),
        imported.alias("grid_import_kwh"),
        "total_power_kw",
        zero("avg_import_kw").alias("import_kw"),
        zero("irradiation_wh_m2").alias("irradiation_wh_m2"),
        zero("avg_irradiance_wm2").alias("avg_irradiance_wm2"),
        performance_ratio(gen, zero("irradiation_wh_m2") / 1000, F.col("capacity_kwp")).alias("instantaneous_pr"),
        "avg_ambient_temp_c", "avg_module_temp_c", "active_inverters", "total_inverters", "failure_count",
        zero("stress").alias("system_stress_avg"),
        completeness().alias("data_completeness_percent"),
    )


def plant_daily_summary(
    inverter_days: DataFrame, meteo_days: DataFrame, poi_days: DataFrame, status_days: DataFrame,
    capacity: DataFrame | None = None,
) -> DataFrame:
    """Yield, performance ratio, capacity factor and availability per plant and day."""
    day = ["plant_id", "date"]
    inv = inverter_days.groupBy(*day).agg(
        F.sum("total_energy_kwh").alias("total_generation_kwh"),
        F.avg("availability_percent").alias("inverter_availability_avg"),
        F.count_if(F.col("total_energy_kwh") > 0).alias("active_inverters"),
        F.count(F.lit(1)).alias("total_inverters"),
        F.sum("total_failures").alias("inverter_failures"),
    )
    met = meteo_days.select(
        *day, "total_irradiation_kwh_m2", "sunshine_hours",
        F.col("temp_avg_c").alias("avg_ambient_temp_c"), F.col("module_temp_avg_c").alias("avg_module_temp_c"),
    )
    poi = poi_days.select(*day, "total_import_kwh", "total_export_kwh", F.col("availability_percent").alias("poi_availability"))
    status = status_days.select(*day, "total_failures_sum", "total_critical_failures", "stress_level_avg")
    joined = inv.join(met, day, "left").join(poi, day, "left").join(status, day, "left")
    gen, imported, cap = F.col("total_generation_kwh"), zero("total_import_kwh"), F.col("capacity_kwp")
    own = F.least(gen, imported)
    return with_capacity(joined, capacity).select(
        *day,
        "total_generation_kwh",
        imported.alias("total_consumption_kwh"),
        (gen - imported).alias("net_energy_kwh"),
        own.alias("self_consumption_kwh"),
        F.when(gen > 0, own / gen).otherwise(0.0).alias("self_consumption_ratio"),
        zero("total_export_kwh").alias("grid_export_kwh"),
        imported.alias("grid_import_kwh"),
        zero("total_irradiation_kwh_m2").alias("total_irradiation_kwh_m2"),
        F.coalesce("sunshine_hours", F.lit(0)).alias("sunshine_hours"),
        F.try_divide(gen, cap).alias("specific_yield_kwh_kwp"),
        performance_ratio(gen, zero("total_irradiation_kwh_m2"), cap).alias("performance_ratio"),
        F.try_divide(gen, cap * 24).alias("capacity_factor"),
        "avg_ambient_temp_c", "avg_module_temp_c",
        (1 + (F.col("avg_module_temp_c") - STC_TEMPERATURE_C) * MODULE_TEMP_COEFFICIENT).alias("temp_loss_factor"),
        F.coalesce("poi_availability", F.lit(100.0)).alias("plant_availability_percent"),
        "inverter_availability_avg",
        (F.coalesce("total_failures_sum", F.lit(0)) + F.col("inverter_failures")).alias("total_failures"),
        F.coalesce("total_critical_failures", F.lit(0)).alias("critical_failures"),
        "inverter_failures",
        zero("stress_level_avg").alias("system_stress_avg"),
        "active_inverters", "total_inverters",
        completeness().alias("data_completeness_percent"),
    )


def missing_keys(source: DataFrame, target: DataFrame | None, keys: dict[str, Column]) -> DataFrame:
    """Distinct keys of the finer table that the coarser one does not have yet.

    ``keys`` gives each key name and how the source computes it.
    """
    found = source.select(*[c.alias(k) for k, c in keys.items()]).distinct()
    return found if target is None else found.join(target.select(*keys), list(keys), "left_anti")


def oldest_keys(keys: DataFrame, time: str, n: int) -> DataFrame:
    """The ``n`` oldest keys, for a caller that wants to fill back in steps."""
    rest = [c for c in keys.columns if c != time]
    return keys.orderBy(time, *rest).limit(n)


def touched(source: DataFrame, batch_keys: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Source rows that belong to the touched keys, with the key columns added."""
    return source.withColumns(keys).join(batch_keys.select(*keys).distinct(), list(keys), "left_semi")
