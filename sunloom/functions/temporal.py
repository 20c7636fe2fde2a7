"""Time and scalar expressions: calendar features, ratios, sun position, labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hour_of(c: Column | str) -> Column:
    return F.date_trunc("hour", c)


def floor_minutes(c: Column | str, minutes: int) -> Column:
    """Start of the ``minutes``-long interval that holds the time."""
    c = F.col(c) if isinstance(c, str) else c
    width = minutes * 60_000_000
    return F.timestamp_micros((F.floor(F.unix_micros(c) / width) * width).cast("long"))


def parse_ts(c: Column | str) -> Column:
    """ISO 8601 text to a UTC instant; NULL when it does not parse."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("timestamp")


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Hour, weekday (Monday is 0), day, month, quarter and weekend marker."""
    day = F.weekday(ts)
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "day_of_week": day,
            "day_of_month": F.dayofmonth(ts),
            "month": F.month(ts),
            "quarter": F.quarter(ts),
            "is_weekend": (day >= 5).cast("int"),
        }
    )


def cyclic_features(df: DataFrame) -> DataFrame:
    """Sine and cosine of hour, weekday and month; needs the calendar columns."""
    out = {}
    for name, period in (("hour", 24), ("day_of_week", 7), ("month", 12)):
        angle = F.col(name) * F.lit(2 * math.pi) / F.lit(period)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return df.withColumns(out)


CALENDAR_COLUMNS = [
    "hour", "day_of_week", "day_of_month", "month", "quarter", "is_weekend",
    "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
]


def ratio_features(df: DataFrame) -> DataFrame:
    """Power ratio, power per string, temperature difference and interaction.

    A power of exactly -1e-6 makes the ratio undefined, which gives NULL.
    """
    c = F.col
    return df.withColumns(
        {
            "dc_to_ac_ratio": F.try_divide(c("dc_power_kw"), c("ac_power_kw") + 1e-6),
            "power_per_healthy_string": c("ac_power_kw") / (c("healthy_strings") + 1),
            "temp_diff": c("module_temp_c") - c("amb_temp_c"),
            "irradiance_temp_interaction": c("poa_irradiance_wm2") * c("amb_temp_c"),
        }
    )


def percent_change(current: Column, previous: Column) -> Column:
    """Change in percent; NULL when the previous value is missing or zero."""
    return F.try_divide(current - previous, previous) * 100


def format_kpi(c: Column | str, unit: str = "", decimals: int = 1) -> Column:
    """``N/A``, a plain number, or millions of thousands once it reaches a million."""
    c = F.col(c) if isinstance(c, str) else c
    def number(x: Column) -> Column:
        # format_number rounds half to even on the exact binary value
        return F.translate(F.format_number(x, decimals), ",", "")

    large = F.concat(number(c / 1000), F.lit("M" + unit))
    plain = F.concat(number(c), F.lit(unit))
    return F.when(c.isNull() | F.isnan(c), "N/A").when(F.abs(c) >= 1_000_000, large).otherwise(plain)


def clear_sky_poa(
    ts: Column | str,
    latitude: Column | float,
    longitude: Column | float | None = None,
    timezone: Column | str | None = None,
) -> Column:
    """Clear-sky plane-of-array irradiance in W/m²; zero below the horizon.

    ``ts`` is a UTC instant. With a time zone, the local clock and its offset are
    taken from the zone's rules at that instant.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    lat = latitude if isinstance(latitude, Column) else F.lit(latitude)
    utc = ts.cast("timestamp")
    if timezone is None:
        local = utc
    else:
        local = F.from_utc_timestamp(utc, timezone)
    offset = (F.unix_seconds(local) - F.unix_seconds(utc)) / 60
    minutes = F.hour(local) * 60 + F.minute(local) + F.second(local) / 60.0
    day = F.dayofyear(local)
    b = F.radians(F.lit(360) * (day - 81) / 365)
    equation_of_time = 9.87 * F.sin(2 * b) - 7.53 * F.cos(b) - 1.5 * F.sin(b)
    east = 0 if longitude is None else 4 * (longitude if isinstance(longitude, Column) else F.lit(longitude))
    solar_hour = (minutes + equation_of_time + east - offset) / 60
    declination = F.radians(23.45 * F.sin(F.radians(F.lit(360) / 365 * (284 + day))))
    hour_angle = F.radians(15 * (solar_hour - 12))
    cos_zenith = F.sin(F.radians(lat)) * F.sin(declination) + F.cos(F.radians(lat)) * F.cos(declination) * F.cos(hour_angle)
    return F.when(cos_zenith > 0, 1000 * F.exp(-0.1 * (1 / cos_zenith - 1))).otherwise(F.when(cos_zenith.isNotNull(), 0.0))
