"""Validation rules, efficiency tiers and value clean-up, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule:
    """One check: the issue it names (or none) and whether it marks an anomaly."""

    def __init__(self, issue: str | None, when: Column, anomaly: bool = True):
        self.issue = issue
        self.when = F.coalesce(when, F.lit(False))
        self.anomaly = anomaly


def outside(name: str, low: float, high: float) -> Column:
    c = F.col(name)
    return (c < low) | (c > high)


# Issue names, their order and the limits of each check.
def inverter_rules() -> list[Rule]:
    power = F.col("ac_power_kw")
    return [
        Rule("missing_power", power.isNull(), anomaly=False),
        Rule("missing_temp", F.col("inverter_temp_c").isNull(), anomaly=False),
        Rule("missing_timestamp", F.col("ts").isNull(), anomaly=False),
        Rule("negative_power", power < 0),
        Rule("excessive_power", power > 1000),
        Rule("negative_dc_power", F.col("dc_power_kw") < 0),
        Rule("dc_voltage_out_of_range", outside("dc_voltage_v", 0, 1500)),
        Rule("negative_dc_current", F.col("dc_current_a") < 0),
        Rule(None, F.col("failed_strings") > 0),
        Rule("temp_out_of_range", outside("inverter_temp_c", -40, 100)),
        Rule("freq_out_of_range", outside("ac_freq_hz", 45, 65) & (power > 0)),
        Rule(None, F.col("active_failures") > 0),
    ]


def poi_rules() -> list[Rule]:
    export, imported = F.col("export_active_power_kw"), F.col("import_active_power_kw")
    return [
        Rule("negative_export", export < 0),
        Rule("negative_import", imported < 0),
        Rule("simultaneous_export_import", (export > 0) & (imported > 0)),
        *[Rule(f"{p}_voltage_out_of_range", outside(f"grid_voltage_{p}_v", 300, 500)) for p in ("l1", "l2", "l3")],
        Rule("frequency_deviation", outside("grid_frequency_hz", 49, 51)),
        Rule("pf_out_of_range", outside("power_factor", 0, 1)),
        Rule(None, F.col("connection_issues")),
        Rule(None, F.col("active_failures") > 0),
    ]


def meteo_rules() -> list[Rule]:
    return [
        Rule("amb_temp_out_of_range", outside("amb_temp_c", -50, 60)),
        Rule("module_temp_out_of_range", outside("module_temp_c", -50, 100)),
        Rule("humidity_out_of_range", outside("humidity_percent", 0, 100)),
        Rule("irradiance_out_of_range", outside("poa_irradiance_wm2", 0, 1500)),
        Rule("wind_out_of_range", outside("wind_speed_ms", 0, 100)),
    ]


def status_rules() -> list[Rule]:
    return [
        Rule("stress_out_of_range", outside("stress_level", 0, 1), anomaly=False),
        Rule("high_stress", F.col("stress_level") > 0.7),
        Rule("failures_present", F.col("total_failures") > 0),
        Rule("critical_failures_present", F.col("critical_failures") > 0),
    ]


RULES = {"inverter": inverter_rules, "poi_meter": poi_rules, "meteo": meteo_rules, "system_status": status_rules}


def with_quality(df: DataFrame, kind: str) -> DataFrame:
    """Add ``data_quality_flag`` and ``anomaly_flag`` for one kind of reading.

    A missing failure counter counts as no failure, so such a row is validated
    like any other. The full issue text is kept, whatever its length.
    """
    rules = RULES[kind]()
    text = F.concat_ws(",", *[F.when(r.when, F.lit(r.issue)) for r in rules if r.issue])
    flags = [r.when for r in rules if r.anomaly]
    return df.withColumns(
        {
            "data_quality_flag": F.when(text == "", "valid").otherwise(text),
            "anomaly_flag": reduce(lambda a, b: a | b, flags),
        }
    )


def with_efficiency(df: DataFrame, alert_below: float = 0.93, warning_below: float = 0.95) -> DataFrame:
    """Add AC/DC efficiency and its tier; undefined when either power is zero.

    The tier names follow the processing code, where the lower limit is the alert.
    """
    ac, dc = F.col("ac_power_kw"), F.col("dc_power_kw")
    ratio = F.when((dc > 0) & (ac != 0), ac / dc)
    tier = F.when(ratio < alert_below, "alert").when(ratio < warning_below, "warning").otherwise("normal")
    return df.withColumns({"instant_efficiency": ratio, "efficiency_flag": tier})


def clean(df: DataFrame, kind: str) -> DataFrame:
    """Bronze rows of one kind to silver rows."""
    checked = with_quality(df, kind)
    return with_efficiency(checked) if kind == "inverter" else checked


def decimal_comma(c: Column | str) -> Column:
    """Text with a decimal comma to a number; NULL when it is not one."""
    return F.trim(F.replace(F.col(c) if isinstance(c, str) else c, F.lit(","), F.lit("."))).try_cast("double")


def blank_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~c.rlike(r"^\s*$"), c)


def finite_or_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def clip_nonneg(c: Column | str) -> Column:
    """Replace values below zero by zero; NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c < 0, 0.0).otherwise(c)


def anomaly_label(c: Column | str = "active_failures") -> Column:
    return (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) > 0).cast("int")


def availability_tier(c: Column | str = "availability_percent") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c >= 90, "good").when(c >= 70, "medium").otherwise("low")


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Fail before any job runs when columns are missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))
    return df


def existing_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep the named columns that are there, in the order asked for."""
    return df.select(*[c for c in names if c in df.columns])


def numeric_columns(df: DataFrame, drop: Sequence[str] = ()) -> list[str]:
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in df.dtypes if (t in numeric or t.startswith("decimal")) and c not in drop]


def drop_incomplete(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with NULL in the named columns that exist, or in any column."""
    cols = df.columns if names is None else [c for c in names if c in df.columns]
    return df.dropna(subset=list(cols))


def healthy_only(df: DataFrame) -> DataFrame:
    """Rows without active failures, without that column."""
    return df.filter("active_failures = 0").drop("active_failures")


def null_row_counts(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows, and rows a not-null requirement would remove, in one pass."""
    gap = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in names])
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(gap).alias("removed"), F.count_if(~gap).alias("kept")
    )
