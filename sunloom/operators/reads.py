"""Parameterised reads of the stored tables: ranges, latest times, lists, look-backs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.plans.skew import lookup


def in_range(
    df: DataFrame, time: str, start, end, plant_id: str | None = None, inverter_id: str | None = None,
    component_type: str | None = None, event_date: str | None = None,
) -> DataFrame:
    """Rows with ``start <= time <= end`` and the optional exact matches.

    The bounds are literals, so they reach the scan. With ``event_date`` naming the
    partition column, the same range also prunes partitions.
    """
    def bound(v) -> Column:
        return v if isinstance(v, Column) else F.lit(v).cast(df.schema[time].dataType)

    out = df.filter(F.col(time).between(bound(start), bound(end)))
    if event_date:
        out = out.filter(F.col(event_date).between(F.to_date(bound(start)), F.to_date(bound(end))))
    for name, value in (("plant_id", plant_id), ("inverter_id", inverter_id), ("component_type", component_type)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out


def newest_first(df: DataFrame, time: str, *ties: str) -> DataFrame:
    """Presentation order for the rows of a report."""
    return df.orderBy(F.desc(time), *[F.asc(t) for t in ties])


def latest_timestamp(df: DataFrame, time: str, plant_id: str | None = None) -> DataFrame:
    rows = df if plant_id is None else df.filter(F.col("plant_id") == plant_id)
    return rows.agg(F.max(time).alias("latest_ts"))


def distinct_values(df: DataFrame, column: str, plant_id: str | None = None) -> DataFrame:
    rows = df if plant_id is None else df.filter(F.col("plant_id") == plant_id)
    return rows.select(column).distinct()


def distinct_plants(*tables: DataFrame) -> DataFrame:
    """Plants of several tables, each made distinct before the union."""
    out = tables[0].select("plant_id").distinct()
    for t in tables[1:]:
        out = out.union(t.select("plant_id").distinct())
    return out.distinct()


def hours_with_data(silver: DataFrame, plant_id: str, day: str, ts: str = "ts") -> DataFrame:
    """Hours of one day that have rows; the day is a range on the raw time."""
    start = F.lit(day).cast("timestamp")
    rows = silver.filter((F.col("plant_id") == plant_id) & (F.col(ts) >= start) & (F.col(ts) < start + F.expr("interval 1 day")))
    return rows.select(F.date_trunc("hour", ts).alias("hour")).distinct()


def since_watermark(df: DataFrame, watermark: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows later than the stored time of their key; keys without one give all rows."""
    marks = lookup(watermark.select(*keys, F.col("last_processed_ts").alias("_last")))
    joined = df.join(marks, list(keys), "left")
    return joined.filter(F.col("_last").isNull() | (F.col(ts) > F.col("_last"))).drop("_last")


def advanced_watermark(scored: DataFrame, mode: str = "anomaly", ts: str = "ts") -> DataFrame:
    """Watermark rows after scoring: the greatest time per plant and inverter."""
    return scored.groupBy("plant_id", "inverter_id").agg(F.max(ts).alias("last_processed_ts")).select(
        "plant_id", "inverter_id", F.lit(mode).alias("inference_mode"), "last_processed_ts"
    )


def latest_span(df: DataFrame, ts: str, span: str) -> DataFrame:
    """Rows of the last ``span`` before the newest row; the bound is a scalar subquery."""
    newest = df.agg(F.max(ts).alias("m")).scalar()
    return df.filter(F.col(ts) >= newest - F.expr(f"interval {span}"))


def rows_by_id(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def with_weather(telemetry: DataFrame, weather: DataFrame, ts: str = "ts") -> DataFrame:
    """Telemetry with the weather of the same plant and exact time."""
    return telemetry.join(weather, ["plant_id", ts], "left")


def latest_anomalies(predictions: DataFrame, plant_id: str | None = None, limit: int = 20, ts: str = "ts") -> DataFrame:
    rows = predictions.filter("is_anomaly = 1")
    if plant_id is not None:
        rows = rows.filter(F.col("plant_id") == plant_id)
    return rows.orderBy(F.desc(ts), "plant_id", "inverter_id").limit(limit)


def newest_time(df: DataFrame, time: str, plant_id: str | None = None) -> datetime | None:
    return latest_timestamp(df, time, plant_id).first()[0]


def lookback(
    tables: dict[str, tuple[DataFrame, str]], anchor: str, hours: int = 24, plant_id: str | None = None,
    ahead: dict[str, tuple[DataFrame, str, int]] | None = None,
) -> dict[str, DataFrame]:
    """Recent rows of several tables, up to the newest time of the anchor table.

    ``tables`` gives each frame and its time column; ``ahead`` adds frames that
    reach some hours past that time. Without any anchor row all frames are empty.
    """
    newest = newest_time(*tables[anchor], plant_id)
    ahead = ahead or {}
    if newest is None:
        return {n: t[0].limit(0) for n, t in {**tables, **ahead}.items()}
    start = newest - timedelta(hours=hours)
    out = {n: in_range(df, time, start, newest, plant_id) for n, (df, time) in tables.items()}
    out.update({n: in_range(df, time, start, newest + timedelta(hours=h), plant_id) for n, (df, time, h) in ahead.items()})
    return out
