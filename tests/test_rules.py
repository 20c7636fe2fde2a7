"""Limits of every check: at, just below, just above, and missing."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sunloom.functions.quality import availability_tier, clean
from sunloom.functions.temporal import format_kpi

INVERTER = dict(
    ac_power_kw=50.0, inverter_temp_c=20.0, ts="2024-01-01", dc_power_kw=52.0, dc_voltage_v=800.0, dc_current_a=10.0, failed_strings=0,
    ac_freq_hz=50.0, active_failures=0,
)
POI = dict(
    export_active_power_kw=10.0, import_active_power_kw=0.0, grid_voltage_l1_v=400.0, grid_voltage_l2_v=400.0, grid_voltage_l3_v=400.0,
    grid_frequency_hz=50.0, power_factor=0.9, connection_issues=False, active_failures=0,
)
METEO = dict(amb_temp_c=20.0, module_temp_c=30.0, humidity_percent=50.0, poa_irradiance_wm2=500.0, wind_speed_ms=3.0)
STATUS = dict(stress_level=0.1, total_failures=0, critical_failures=0)
BASE = {"inverter": INVERTER, "poi_meter": POI, "meteo": METEO, "system_status": STATUS}
TYPES = {"ts": "string", "connection_issues": "boolean"}

CASES = [
    ("inverter", {}, "valid", False),
    ("inverter", {"ac_power_kw": None}, "missing_power", False),
    ("inverter", {"inverter_temp_c": None}, "missing_temp", False),
    ("inverter", {"ts": None}, "missing_timestamp", False),
    ("inverter", {"ac_power_kw": 0.0}, "valid", False),
    ("inverter", {"ac_power_kw": -0.001}, "negative_power", True),
    ("inverter", {"ac_power_kw": 1000.0}, "valid", False),
    ("inverter", {"ac_power_kw": 1000.001}, "excessive_power", True),
    ("inverter", {"dc_power_kw": -0.001}, "negative_dc_power", True),
    ("inverter", {"dc_power_kw": None}, "valid", False),
    ("inverter", {"dc_voltage_v": 0.0}, "valid", False),
    ("inverter", {"dc_voltage_v": -0.1}, "dc_voltage_out_of_range", True),
    ("inverter", {"dc_voltage_v": 1500.0}, "valid", False),
    ("inverter", {"dc_voltage_v": 1500.1}, "dc_voltage_out_of_range", True),
    ("inverter", {"dc_current_a": -0.1}, "negative_dc_current", True),
    ("inverter", {"failed_strings": 1}, "valid", True),
    ("inverter", {"failed_strings": None}, "valid", False),
    ("inverter", {"inverter_temp_c": -40.0}, "valid", False),
    ("inverter", {"inverter_temp_c": -40.1}, "temp_out_of_range", True),
    ("inverter", {"inverter_temp_c": 100.0}, "valid", False),
    ("inverter", {"inverter_temp_c": 100.1}, "temp_out_of_range", True),
    ("inverter", {"ac_freq_hz": 45.0}, "valid", False),
    ("inverter", {"ac_freq_hz": 44.9}, "freq_out_of_range", True),
    ("inverter", {"ac_freq_hz": 65.0}, "valid", False),
    ("inverter", {"ac_freq_hz": 65.1}, "freq_out_of_range", True),
    ("inverter", {"ac_freq_hz": 40.0, "ac_power_kw": 0.0}, "valid", False),
    ("inverter", {"ac_freq_hz": 40.0, "ac_power_kw": None}, "missing_power", False),
    ("inverter", {"active_failures": 1}, "valid", True),
    ("inverter", {"active_failures": None}, "valid", False),
    ("inverter", {"ac_power_kw": -1.0, "dc_power_kw": -1.0, "dc_voltage_v": -1.0, "dc_current_a": -1.0, "inverter_temp_c": 101.0},
     "negative_power,negative_dc_power,dc_voltage_out_of_range,negative_dc_current,temp_out_of_range", True),
    ("poi_meter", {}, "valid", False),
    ("poi_meter", {"export_active_power_kw": -0.1}, "negative_export", True),
    ("poi_meter", {"import_active_power_kw": -0.1}, "negative_import", True),
    ("poi_meter", {"import_active_power_kw": 0.1}, "simultaneous_export_import", True),
    ("poi_meter", {"import_active_power_kw": None}, "valid", False),
    ("poi_meter", {"grid_voltage_l1_v": 300.0}, "valid", False),
    ("poi_meter", {"grid_voltage_l1_v": 299.9}, "l1_voltage_out_of_range", True),
    ("poi_meter", {"grid_voltage_l2_v": 500.1}, "l2_voltage_out_of_range", True),
    ("poi_meter", {"grid_voltage_l3_v": None}, "valid", False),
    ("poi_meter", {"grid_frequency_hz": 49.0}, "valid", False),
    ("poi_meter", {"grid_frequency_hz": 48.9}, "frequency_deviation", True),
    ("poi_meter", {"grid_frequency_hz": 51.1}, "frequency_deviation", True),
    ("poi_meter", {"power_factor": 1.0}, "valid", False),
    ("poi_meter", {"power_factor": 1.01}, "pf_out_of_range", True),
    ("poi_meter", {"power_factor": -0.01}, "pf_out_of_range", True),
    ("poi_meter", {"connection_issues": True}, "valid", True),
    ("poi_meter", {"connection_issues": None}, "valid", False),
    ("poi_meter", {"active_failures": None}, "valid", False),
    ("meteo", {}, "valid", False),
    ("meteo", {"amb_temp_c": -50.0}, "valid", False),
    ("meteo", {"amb_temp_c": -50.1}, "amb_temp_out_of_range", True),
    ("meteo", {"amb_temp_c": 60.1}, "amb_temp_out_of_range", True),
    ("meteo", {"module_temp_c": 100.1}, "module_temp_out_of_range", True),
    ("meteo", {"humidity_percent": 100.0}, "valid", False),
    ("meteo", {"humidity_percent": -0.1}, "humidity_out_of_range", True),
    ("meteo", {"poa_irradiance_wm2": 1500.1}, "irradiance_out_of_range", True),
    ("meteo", {"wind_speed_ms": 100.1}, "wind_out_of_range", True),
    ("meteo", {"wind_speed_ms": None, "amb_temp_c": None}, "valid", False),
    ("system_status", {}, "valid", False),
    ("system_status", {"stress_level": -0.1}, "stress_out_of_range", False),
    ("system_status", {"stress_level": 0.7}, "valid", False),
    ("system_status", {"stress_level": 0.71}, "high_stress", True),
    ("system_status", {"stress_level": 1.1}, "stress_out_of_range,high_stress", True),
    ("system_status", {"total_failures": 1}, "failures_present", True),
    ("system_status", {"critical_failures": 1}, "critical_failures_present", True),
    ("system_status", {"total_failures": None, "critical_failures": None}, "valid", False),
]


@pytest.mark.parametrize("kind", list(BASE))
def test_limits(spark, kind):
    cases = [c for c in CASES if c[0] == kind]
    types = {n: TYPES.get(n, "int" if isinstance(v, int) and not isinstance(v, bool) else "double") for n, v in BASE[kind].items()}
    schema = "n int, " + ", ".join(f"{n} {t}" for n, t in types.items())
    data = [(i, *{**BASE[kind], **change}.values()) for i, (_, change, _, _) in enumerate(cases)]
    got = clean(spark.createDataFrame(data, schema), kind).orderBy("n").select("data_quality_flag", "anomaly_flag").collect()
    assert [tuple(r) for r in got] == [(text, bad) for _, _, text, bad in cases]


def test_efficiency_tiers(spark):
    pairs = [(92.9, 100.0, "alert"), (93.0, 100.0, "warning"), (94.9, 100.0, "warning"), (95.0, 100.0, "normal"), (0.0, 100.0, "normal"), (5.0, 0.0, "normal"), (5.0, -1.0, "normal"), (None, 1.0, "normal")]
    base = {k: v for k, v in INVERTER.items() if k not in ("ac_power_kw", "dc_power_kw")}
    df = spark.createDataFrame([Row(n=i, **base) for i in range(len(pairs))])
    p = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "n int, ac_power_kw double, dc_power_kw double")
    got = clean(df.join(p, "n"), "inverter").orderBy("n").collect()
    assert [r["efficiency_flag"] for r in got] == [x[2] for x in pairs]
    assert got[4]["instant_efficiency"] is None and got[5]["instant_efficiency"] is None


def test_labels(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (999.95,), (-1234.5,), (2_500_000.0,), (None,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(format_kpi("x", " kW")).collect()] == [
        f"{0.25:.1f} kW", f"{0.35:.1f} kW", f"{999.95:.1f} kW", f"{-1234.5:.1f} kW", "2500.0M kW", "N/A", "N/A"
    ]
    tiers = spark.createDataFrame([(90.0,), (89.9,), (70.0,), (69.9,), (None,)], "a double").select(availability_tier("a"))
    assert [r[0] for r in tiers.collect()] == ["good", "medium", "medium", "low", "low"]


def test_clear_sky_in_a_zone(spark):
    """The zone shifts the clock but not the sun, up to whole seconds."""
    from sunloom.functions.temporal import clear_sky_poa

    df = spark.sql("select explode(sequence(timestamp'2024-06-21 03:00:00', timestamp'2024-06-21 21:00:00', interval 37 minutes)) as ts")
    got = df.select(clear_sky_poa("ts", 40.4, -3.7).alias("a"), clear_sky_poa("ts", 40.4, -3.7, "Europe/Madrid").alias("b")).collect()
    assert all(abs(r.a - r.b) < 1e-6 for r in got)
    assert max(r.a for r in got) > 900 and min(r.a for r in got) == 0.0
    assert F is not None


def test_limits_as_rows(spark):
    """Every configured limit is judged; null, equal and unknown ones raise nothing."""
    from sunloom.operators.dashboard import LIMITS, limit_alerts

    values = {
        "temp_warning_c": 55.0, "temp_critical_c": 65.0, "efficiency_alert_min": 0.95, "efficiency_warning_min": 0.93, "freq_deviation_warning_hz": 0.5,
        "freq_deviation_critical_hz": 1.0, "string_current_imbalance_pct": 10.0, "voltage_deviation_pct": 5.0, "min_power_for_efficiency_calc_kw": 1.0,
        "voltage_deviation_warning_pct": 5.0, "voltage_deviation_critical_pct": 10.0, "power_factor_warning_min": 0.9, "power_factor_critical_min": 0.85,
    }
    assert sorted(values) == sorted(x[1] for x in LIMITS)
    limits = [("P", c, n, values[n], "warning") for c, n, *_ in LIMITS] + [("P", "inverter", "unheard_of", 1.0, "info"), ("Q", "inverter", "temp_warning_c", None, "info")]
    thresholds = spark.createDataFrame(limits, "plant_id string, threshold_category string, threshold_name string, threshold_value double, severity string")
    inverter = spark.createDataFrame(
        [("P", "calm", 55.0, 0.95, 50.5, 9, 1, 840.0, 5.0), ("P", "bad", 65.5, 0.9, 51.5, 6, 6, 700.0, 5.0), ("P", "idle", 20.0, 0.1, 50.0, 12, 0, 800.0, 0.5),
         ("P", "silent", None, None, None, None, None, None, None), ("P", "none", 20.0, 1.0, 50.0, 0, 0, 800.0, 5.0), ("Q", "bad", 99.0, 0.1, 60.0, 0, 9, 1.0, 9.0), ("R", "bad", 99.0, 0.1, 60.0, 0, 9, 1.0, 9.0)],
        "plant_id string, inverter_id string, inverter_temp_c double, instant_efficiency double, ac_freq_hz double, healthy_strings int, failed_strings int, dc_voltage_v double, ac_power_kw double",
    ).withColumn("ts", F.lit("2026-01-15").cast("timestamp"))
    meter = spark.createDataFrame([("P", 400.0, 424.0, 399.0, 0.9), ("P", 400.0, None, 350.0, 0.8)], "plant_id string, grid_voltage_l1_v double, grid_voltage_l2_v double, grid_voltage_l3_v double, power_factor double").withColumn("ts", F.lit("2026-01-15").cast("timestamp"))
    got = limit_alerts({"inverter": inverter, "poi_meter": meter}, thresholds, 800.0, 400.0).collect()
    raised = sorted((r["source"], r["alert"]) for r in got)
    inverter_names = [n for c, n, *_ in LIMITS if c != "poi_meter" and n != "min_power_for_efficiency_calc_kw"]
    meter_names = [n for c, n, *_ in LIMITS if c == "poi_meter"]
    assert raised == sorted([("bad", n) for n in inverter_names] + [("poi_meter", n) for n in [*meter_names, "voltage_deviation_warning_pct"]])
    assert limit_alerts({"inverter": inverter.limit(0)}, thresholds, 800.0, 400.0).isEmpty()
