"""Data profiling: shares, missing values, duplicates, gaps, outliers, histograms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.operators.timeseries import median_of_counts, time_gaps
from sunloom.plans import skew


def failure_share(df: DataFrame, by: Sequence[str] = ("plant_id", "inverter_id"), failures: str = "active_failures") -> DataFrame:
    """Rows with a known failure count, those above zero, and the percentage."""
    bad = F.count_if(F.col(failures) > 0)
    pct = F.bround(F.try_divide(bad, F.count(failures)) * 100, 2)
    return df.groupBy(*by).agg(F.count(failures).alias("total_records"), bad.alias("records_with_failures"), pct.alias("failure_percentage"))


def anomaly_distribution(df: DataFrame, by: Sequence[str] = ("plant_id", "inverter_id"), label: str = "is_anomaly") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(label).alias("total"), F.sum(label).alias("anomalies"), F.count_if(F.col(label) == 0).alias("normal"),
        F.bround(F.avg(label) * 100, 2).alias("anomaly_ratio"),
    )


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, as ``column, nulls``: one aggregate, then a turn."""
    cols = list(cols or df.columns)
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols])
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier one."""
    copies = df.groupBy(*(cols or df.columns)).count()
    return copies.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def rows_per_key(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def describe(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of a measure per key."""
    basic = df.groupBy(*by).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max")
    )
    q = skew.quantiles(df, by, [col], [0.25, 0.5, 0.75]).select(
        *by, *[F.col(col)[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))]
    )
    return basic.join(q, list(by), "left")


def gap_counts(df: DataFrame, by: Sequence[str], ts: str = "ts", tie: Sequence[str] = (), whole_seconds: bool = True, max_rows: int | None = None) -> DataFrame:
    """How often each gap between neighbouring rows occurs."""
    gaps = time_gaps(df.select(*by, ts, *tie), by, ts, tie, max_rows=max_rows).filter("gap_seconds is not null")
    gap = F.bround("gap_seconds", 0) if whole_seconds else F.col("gap_seconds")
    return gaps.groupBy(gap.alias("gap_seconds")).agg(F.count(F.lit(1)).alias("occurrences"))


def most_common() -> Column:
    """Most frequent gap, the smallest of equally frequent ones."""
    return F.max_by("gap_seconds", F.struct("occurrences", -F.col("gap_seconds")))


def gap_stats(counts: DataFrame) -> DataFrame:
    """Mean, median and mode from the gap counts, which are few after rounding."""
    total = F.sum("occurrences")
    return counts.agg(
        total.alias("gaps"),
        (F.sum(F.col("gap_seconds") * F.col("occurrences")) / total).alias("mean_gap"),
        median_of_counts("gap_seconds", "occurrences").alias("median_gap"),
        most_common().alias("mode_gap"),
    )


def gap_top(counts: DataFrame, n: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("occurrences"), "gap_seconds").limit(n)


def sampling_interval(counts: DataFrame) -> DataFrame:
    """Most common gap in seconds and minutes; the median when there is no mode."""
    best = F.coalesce(most_common(), median_of_counts("gap_seconds", "occurrences"))
    return counts.agg(best.alias("interval_seconds"), (best / 60).alias("interval_minutes"))


def iqr_bounds(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: float = 1.5, approximate: bool = False) -> DataFrame:
    """Quartiles and outlier bounds per measure, as ``<column>_q1, _q3, _lower, _upper``.

    Exact by default; ``approximate`` takes one pass with a mergeable sketch.
    """
    if approximate:
        q = df.groupBy(*by).agg(*[F.percentile_approx(c, [0.25, 0.75], 10_000).alias(c) for c in cols])
    else:
        q = skew.quantiles(df, by, cols, [0.25, 0.75])
    out = []
    for c in cols:
        q1, q3 = F.col(c)[0], F.col(c)[1]
        out += [q1.alias(f"{c}_q1"), q3.alias(f"{c}_q3"), (q1 - (q3 - q1) * k).alias(f"{c}_lower"), (q3 + (q3 - q1) * k).alias(f"{c}_upper")]
    return q.select(*by, *out)


def with_outliers(df: DataFrame, cols: Sequence[str], by: Sequence[str], bounds: DataFrame | None = None) -> DataFrame:
    """Rows with ``<column>_outlier`` and ``any_outlier`` by the bounds of their key."""
    bounds = iqr_bounds(df, cols, by) if bounds is None else bounds
    joined = df.join(skew.lookup(bounds), list(by), "left")
    tests = {c: F.coalesce((F.col(c) < F.col(f"{c}_lower")) | (F.col(c) > F.col(f"{c}_upper")), F.lit(False)) for c in cols}
    marked = joined.withColumns({f"{c}_outlier": t for c, t in tests.items()})
    return marked.withColumn("any_outlier", reduce(lambda a, b: a | b, [F.col(f"{c}_outlier") for c in cols])).select(
        *df.columns, *[f"{c}_outlier" for c in cols], "any_outlier"
    )


def failure_times(df: DataFrame, by: Sequence[str], ts: str = "ts") -> DataFrame:
    return df.filter("active_failures > 0").select(*by, ts).distinct()


def outliers_in_failures(marked: DataFrame, by: Sequence[str], ts: str = "ts") -> DataFrame:
    """Outlier times per key, and how many of them are failure times."""
    times = marked.filter("any_outlier").select(*by, ts).distinct()
    both = times.join(failure_times(marked, by, ts), [*by, ts], "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("hits"))
    totals = times.groupBy(*by).agg(F.count(F.lit(1)).alias("outlier_times"))
    return totals.join(both, list(by), "left").select(*by, "outlier_times", F.coalesce("hits", F.lit(0)).alias("in_failure"))


def timestamp_intersect(marked: DataFrame, by: Sequence[str], ts: str = "ts") -> DataFrame:
    return marked.filter("any_outlier").select(*by, ts).intersect(failure_times(marked, by, ts))


def clipped_histogram(counts: DataFrame, bins: int = 100, q: float = 0.99) -> DataFrame:
    """Histogram of gaps clipped at a quantile, in equal bins from the least value.

    Works on the gap counts; the range is three numbers joined as a scalar row.
    """
    edge = counts.agg(
        F.min("gap_seconds").alias("lo"), F.percentile("gap_seconds", q, F.col("occurrences")).alias("hi")
    )
    lo, hi = edge.select("lo").scalar(), edge.select("hi").scalar()
    ranged = counts.withColumns({"_lo": lo, "_hi": hi})
    clipped = F.least("gap_seconds", "_hi")
    bin_no = F.least(F.lit(bins), F.floor((clipped - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)) + 1)
    safe = F.when(F.col("_hi") > F.col("_lo"), bin_no).otherwise(1)
    return ranged.groupBy(safe.cast("int").alias("bin")).agg(F.sum("occurrences").alias("gaps"))
