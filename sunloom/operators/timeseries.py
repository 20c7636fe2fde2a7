"""As-of and interval joins, gaps, lags, rolling values, grids and smoothing."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.functions.temporal import floor_minutes
from sunloom.plans import skew

HOUR_US = 3_600_000_000


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    tolerance_seconds: float,
    by: Sequence[str] = ("plant_id",),
    ts: str = "ts",
    right_order: Sequence[str] | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Left rows with the columns of the nearest right row within the tolerance.

    A tie goes to the earlier side. Of right rows at one earlier time the last by
    ``right_order`` is taken, at one later time the first. Left rows without a time
    are dropped. ``by=()`` matches across plants.

    Both sides are laid out in time buckets, right rows also in the bucket next to
    theirs when the tolerance reaches it, and one sorted pass per bucket finds the
    neighbours: the work is linear and no pairs are formed. A bucket with too many
    left rows is dealt to several tasks, each with the bucket's right rows.
    """
    max_rows = skew.MAX_GROUP_ROWS if max_rows is None else max_rows
    by = list(by)
    tol = int(round(tolerance_seconds * 1_000_000))
    width = max(tol, HOUR_US)
    payload = [c for c in right.columns if c not in (*by, ts)]
    order = F.struct(*(right_order or payload))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))

    lefts = left.filter(F.col(ts).isNotNull()).select(
        *by, micros.alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l")
    ).withColumn("_b", F.floor(F.col("_t") / width))
    rights = (
        right.filter(F.col(ts).isNotNull())
        .groupBy(*by, micros.alias("_t"))
        .agg(F.min_by(F.struct(*payload), order).alias("_first"), F.max_by(F.struct(*payload), order).alias("_last"))
        .withColumn("_b", F.explode(F.sequence(F.floor((F.col("_t") - tol) / width), F.floor((F.col("_t") + tol) / width))))
        .withColumn("_side", F.lit(0))
    )
    cell = [*by, "_b"]
    if skew.largest_group(lefts, cell) > max_rows:
        parts = lefts.groupBy(*cell).count().filter(F.col("count") > max_rows)
        parts = parts.select(*cell, F.ceil(F.col("count") / max_rows).cast("int").alias("_k"))
        one = F.coalesce("_k", F.lit(1))
        # the tuple of all left columns decides the part, so a retried task deals alike
        lefts = lefts.join(parts, cell, "left").withColumn("_p", F.pmod(F.xxhash64("_l"), one)).drop("_k")
        rights = rights.join(parts, cell, "left").withColumn("_p", F.explode(F.sequence(F.lit(0), one - 1))).drop("_k")
        rights = rights.withColumn("_p", F.col("_p").cast("long"))
        cell = [*cell, "_p"]

    both = lefts.unionByName(rights, allowMissingColumns=True)
    ahead = Window.partitionBy(*cell).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # read backwards: a frame that ends at unboundedFollowing would be quadratic
    behind = Window.partitionBy(*cell).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_right = F.col("_side") == 0
    found = both.withColumns(
        {
            "_back": F.last(F.when(is_right, F.struct("_t", F.col("_last").alias("r"))), True).over(ahead),
            "_fwd": F.last(F.when(is_right, F.struct("_t", F.col("_first").alias("r"))), True).over(behind),
        }
    ).filter(~is_right)
    gap_b, gap_f = F.col("_t") - F.col("_back._t"), F.col("_fwd._t") - F.col("_t")
    back_ok, fwd_ok = gap_b <= tol, gap_f <= tol
    pick = (
        F.when(back_ok & (gap_f.isNull() | (gap_b <= gap_f)), F.col("_back.r"))
        .when(fwd_ok, F.col("_fwd.r"))
    )
    return found.select("_l.*", pick.alias("_r")).select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in payload])


def dyadic_level(start: str, end: str) -> Column:
    """Power of two, in microseconds, that a time interval is not longer than: the bits of its length less one."""
    length = F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))
    return F.length(F.bin(length - 1)).cast("int")


#: pairs that one task of an interval join tries, about
MAX_PAIRS = 100_000_000


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    by: Sequence[str] = ("plant_id",),
    ts: str = "ts",
    start: str = "start_ts",
    end: str = "end_ts",
    max_pairs: int | None = None,
) -> DataFrame:
    """Points with every interval that covers them, ``start <= ts < end``.

    An interval is listed under the time cells it touches of the least power of two
    that is not shorter than it: two at most, whatever its length. A point asks one cell of
    each power that occurs (a list of 63 at most, read as a scalar), so a long interval
    among short ones adds two rows and no pairs but with points near it. Cells meet in an
    equi-join.

    The rows may be far more than the input, so where ``max_pairs`` is given, the pairs to
    try are counted first, from the points and intervals of each cell: beyond it the join has as many
    partitions as they ask for, which adaptive execution, that goes by bytes, does not
    merge, and a cell with more is dealt to several tasks, each with the cell's intervals.
    Without it, skewed cells are split by adaptive execution.
    """
    def micros(name: str) -> Column:
        return F.unix_micros(F.col(name).cast("timestamp"))

    def cell(at: Column) -> Column:
        return F.call_function("shiftright", at, F.col("_level"))

    live = intervals.filter(F.col(start) < F.col(end)).withColumns({"_level": dyadic_level(start, end), "_from": micros(start), "_to": micros(end)})
    levels = live.agg(F.collect_set("_level").alias("l")).scalar()
    p = points.withColumn("_t", micros(ts)).withColumn("_level", F.explode(levels)).withColumn("_c", cell(F.col("_t")))
    i = live.withColumn("_c", F.explode(F.sequence(cell(F.col("_from")), cell(F.col("_to") - 1))))
    key = [*by, "_level", "_c"]
    if max_pairs is not None:
        sides = p.select(*key, F.lit(1).alias("_n"), F.lit(0).alias("_m")).unionByName(i.select(*key, F.lit(0).alias("_n"), F.lit(1).alias("_m")))
        cells = sides.groupBy(*key).agg(F.sum("_n").alias("_n"), (F.sum("_n").cast("double") * F.sum("_m")).alias("_pairs"))
        most, total = cells.agg(F.max("_pairs"), F.sum("_pairs")).first()
        if (most or 0) > max_pairs:
            parts = cells.filter(F.col("_pairs") > max_pairs).select(*key, F.least("_n", F.ceil(F.col("_pairs") / max_pairs)).alias("_k"))
            one = F.coalesce("_k", F.lit(1).cast("long"))
            # the tuple of all columns of a point decides the part, so a retried task deals alike
            p = p.join(parts, key, "left").withColumn("_p", F.pmod(F.xxhash64(*points.columns), one)).drop("_k")
            i = i.join(parts, key, "left").withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("_k")
            key.append("_p")
        if (total or 0) > max_pairs:
            n = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / max_pairs))
            p, i = (side.repartition(n, *key) for side in (p, i))
    joined = p.join(i, key).filter((F.col("_from") <= F.col("_t")) & (F.col("_t") < F.col("_to")))
    return joined.drop("_level", "_c", "_p", "_t", "_from", "_to")


def time_gaps(df: DataFrame, by: Sequence[str], ts: str = "ts", tie: Sequence[str] = (), name: str = "gap_seconds", max_rows: int | None = None) -> DataFrame:
    """Seconds since the previous row of the key; NULL for the first."""
    fr = skew.ordered_frames(df, by, ts, tie, before=1, max_rows=max_rows)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return fr.finish(fr.df.withColumn(name, (micros - F.lag(micros).over(fr.window)) / 1_000_000))


def rows_for_minutes(minutes: Sequence[float], interval_minutes: float) -> list[int]:
    """Spans in minutes as distinct positive row counts at the sampling interval."""
    return sorted({n for n in (int(m / interval_minutes) for m in minutes) if n > 0})


# Spans in minutes.
LAG_MINUTES = [5, 15, 30, 60, 120, 360, 1440, 2880, 10080]
ROLLING_MINUTES = [5, 15, 60, 360, 720, 1440]


def lag_features(df: DataFrame, by: Sequence[str], cols: Sequence[str], lags: Sequence[int], ts: str = "ts", tie: Sequence[str] = (), max_rows: int | None = None) -> DataFrame:
    """Value of each column ``n`` rows earlier, as ``<column>_lag_<n>``."""
    fr = skew.ordered_frames(df, by, ts, tie, before=max(lags), max_rows=max_rows)
    return fr.finish(fr.df.withColumns({f"{c}_lag_{n}": F.lag(c, n).over(fr.window) for n in lags for c in cols}))


def rolling_features(
    df: DataFrame, by: Sequence[str], windows: Sequence[int], mean: Sequence[str], std: Sequence[str] = (),
    ts: str = "ts", tie: Sequence[str] = (), max_rows: int | None = None, direct: int = 64,
) -> DataFrame:
    """Mean and sample deviation over the last ``n`` rows, the current one included.

    Spark adds up a sliding frame again for every row, so windows longer than
    ``direct`` rows are put together from running values instead: see
    :func:`_moments`.
    """
    fr = skew.ordered_frames(df, by, ts, tie, before=max(windows) - 1, max_rows=max_rows)
    out, rows = {}, fr.df
    for n in [n for n in windows if n <= direct]:
        frame = fr.window.rowsBetween(-(n - 1), 0)
        out.update({f"{c}_rolling_mean_{n}": F.avg(c).over(frame) for c in mean})
        out.update({f"{c}_rolling_std_{n}": F.stddev_samp(c).over(frame) for c in std})
    long = [n for n in windows if n > direct]
    if long:
        if not fr.chunked:
            rows = rows.withColumn("_pos", F.row_number().over(fr.window))
        for n in long:
            rows = _moments(rows, fr, n, list(dict.fromkeys([*mean, *std])))
            out.update({f"{c}_rolling_mean_{n}": F.col(f"_{c}_{n}.m") for c in mean})
            spread = {c: F.sqrt(F.col(f"_{c}_{n}.s") / (F.col(f"_{c}_{n}.n") - 1)) for c in std}
            out.update({f"{c}_rolling_std_{n}": F.when(F.col(f"_{c}_{n}.n") > 1, x) for c, x in spread.items()})
    names = [f"{c}_rolling_{k}_{n}" for n in windows for k, cs in (("mean", mean), ("std", std)) for c in cs]
    extra = [F.col("_home")] if fr.chunked else []
    done = rows.withColumns(out).select(*df.columns, *names, *extra)
    return done.filter("_home").drop("_home") if fr.chunked else done


def _moments(rows: DataFrame, fr: skew.Frames, n: int, cols: Sequence[str]) -> DataFrame:
    """Count, mean and squared deviations of the last ``n`` rows, in ``_<column>_<n>``.

    Positions are cut into blocks of ``n``. The last ``n`` rows are the end of one
    block and the start of the next: a running value from each side, joined by the
    rule for the moments of two sets. Every row costs the same, whatever ``n`` is.
    """
    block = f"_block_{n}"
    rows = rows.withColumn(block, F.floor((F.col("_pos") - 1) / n))
    upto = (Window.unboundedPreceding, Window.currentRow)
    start = Window.partitionBy(*fr.cell, block).orderBy("_pos").rowsBetween(*upto)
    end = Window.partitionBy(*fr.cell, block).orderBy(F.desc("_pos")).rowsBetween(*upto)

    def running(c: str, w) -> Column:
        count = F.count(c).over(w)
        return F.struct(count.alias("n"), F.avg(c).over(w).alias("m"), (F.var_pop(c).over(w) * count).alias("s"))

    rows = rows.withColumns({f"_a_{c}": running(c, start) for c in cols}).withColumns({f"_b_{c}": running(c, end) for c in cols})
    # the tail of the block before begins n - 1 rows back, except at the end of a block
    tails = {f"_t_{c}": F.when(F.col("_pos") % n != 0, F.lag(f"_b_{c}", n - 1).over(fr.window)) for c in cols}
    rows = rows.withColumns(tails)
    joined = {}
    for c in cols:
        a, t = F.col(f"_a_{c}"), F.col(f"_t_{c}")
        na, nt = a["n"], F.coalesce(t["n"], F.lit(0))
        count = na + nt
        gap = a["m"] - t["m"]
        both = F.struct(
            count.alias("n"), ((a["m"] * na + t["m"] * nt) / count).alias("m"), (a["s"] + t["s"] + gap * gap * na * nt / count).alias("s")
        )
        joined[f"_{c}_{n}"] = F.when(nt == 0, a).when(na == 0, t).otherwise(both)
    used = [block, *[f"_{x}_{c}" for c in cols for x in "abt"]]
    return rows.withColumns(joined).drop(*used)


def fill_gaps(df: DataFrame, by: Sequence[str], cols: Sequence[str], ts: str = "ts", tie: Sequence[str] = (), max_rows: int | None = None) -> DataFrame:
    """Forward fill, then backward fill, within the key and in time order.

    Chunks of a large key learn the last value before them and the first after
    them from a summary of one row per chunk. Wide rows make a key large sooner.
    """
    max_rows = skew.group_rows(df, max_rows)
    upto = (Window.unboundedPreceding, Window.currentRow)
    if skew.largest_group(df, by) <= max_rows:
        up = [F.asc(ts), *[F.asc(c) for c in tie]]
        down = [F.desc(ts), *[F.desc(c) for c in tie]]
        ahead = Window.partitionBy(*by).orderBy(*up).rowsBetween(*upto)
        back = Window.partitionBy(*by).orderBy(*down).rowsBetween(*upto)
        return df.withColumns({c: F.coalesce(F.last(c, True).over(ahead), F.last(c, True).over(back)) for c in cols})
    numbered = skew.with_ordinal(df, by, ts, tie, "_pos", max_rows).withColumn("_chunk", F.floor((F.col("_pos") - 1) / max_rows))
    ends = []
    for c in cols:
        seen = F.when(F.col(c).isNotNull(), F.col("_pos"))
        ends += [F.max_by(c, seen).alias(f"_l_{c}"), F.min_by(c, seen).alias(f"_f_{c}")]
    summary = numbered.groupBy(*by, "_chunk").agg(*ends)
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*by).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        *by, "_chunk",
        *[F.last(f"_l_{c}", True).over(earlier).alias(f"_prev_{c}") for c in cols],
        *[F.last(f"_f_{c}", True).over(later).alias(f"_next_{c}") for c in cols],
    )
    ahead = Window.partitionBy(*by, "_chunk").orderBy("_pos").rowsBetween(*upto)
    back = Window.partitionBy(*by, "_chunk").orderBy(F.desc("_pos")).rowsBetween(*upto)
    local = numbered.withColumns(
        {**{f"_up_{c}": F.last(c, True).over(ahead) for c in cols}, **{f"_dn_{c}": F.last(c, True).over(back) for c in cols}}
    )
    filled = local.join(summary, [*by, "_chunk"]).withColumns(
        {c: F.coalesce(f"_up_{c}", f"_prev_{c}", f"_dn_{c}", f"_next_{c}") for c in cols}
    )
    return filled.select(*df.columns)


def _grid(df: DataFrame, by: Sequence[str], value: str, ts: str, minutes: int) -> DataFrame:
    """Grid rows between the first and last interval, each with the measured
    intervals around it: ``_at``/``_v`` before and ``_next``/``_nv`` after.

    Averaging leaves one row per key and interval, so a key is bounded by the
    length of the series. Gaps are opened by exploding from one measured interval
    to the next; no grid table and no join with one is needed.
    """
    step = F.expr(f"interval {minutes} minutes")
    means = df.groupBy(*by, floor_minutes(ts, minutes).alias("_at")).agg(F.avg(value).alias("_v"))
    w = Window.partitionBy(*by).orderBy("_at")
    # the whole key, in the same order, so that one sort serves all windows
    edge = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = F.max(F.col("_v").isNotNull()).over(edge)
    spans = means.withColumns({"_lo": F.min("_at").over(edge), "_hi": F.max("_at").over(edge), "_any": known})
    kept = spans.filter("_v is not null or (not _any and _at = _lo)")
    linked = kept.withColumns({"_next": F.lead("_at").over(w), "_nv": F.lead("_v").over(w), "_prev": F.lag("_at").over(w)})
    first = F.when(F.col("_prev").isNull(), F.col("_lo")).otherwise(F.col("_at"))
    last = F.coalesce(F.col("_next") - step, F.col("_hi"))
    return linked.withColumn(ts, F.explode(F.sequence(first, last, step)))


def resample_interpolate(df: DataFrame, by: Sequence[str], value: str, ts: str = "ts", minutes: int = 1) -> DataFrame:
    """Interval means on a regular grid with linear interpolation over gaps.

    Ends without a measurement take the nearest one.
    """
    g = _grid(df, by, value, ts, minutes)
    part = (F.unix_micros(ts) - F.unix_micros("_at")) / (F.unix_micros("_next") - F.unix_micros("_at"))
    inside = (F.col(ts) > F.col("_at")) & F.col("_next").isNotNull()
    line = F.when(inside, F.col("_v") + (F.col("_nv") - F.col("_v")) * part).otherwise(F.col("_v"))
    return g.select(*by, ts, line.alias(value))


def resample_fill(df: DataFrame, by: Sequence[str], value: str, ts: str = "ts", minutes: int = 60) -> DataFrame:
    """Interval means on a regular grid; a gap repeats the value before it."""
    g = _grid(df, by, value, ts, minutes)
    return g.select(*by, ts, F.when(F.col(ts) >= F.col("_at"), F.col("_v")).alias(value))


def seasonal_decompose(series: DataFrame, by: Sequence[str], value: str, ts: str = "ts", period: int = 24) -> DataFrame:
    """Additive trend, seasonal and residual parts of a regular series.

    The trend is the centred mean over one period, for an even period with half weights
    at both ends; it is NULL where the period does not fit. Input has one row per key and
    interval.
    """
    half = period // 2
    w = Window.partitionBy(*by).orderBy(ts)
    around = F.sum(value).over(w.rowsBetween(-half, half))
    ends = F.lag(value, half).over(w) + F.lead(value, half).over(w)
    complete = F.count(value).over(w.rowsBetween(-half, half)) == 2 * half + 1
    trend = F.when(complete, (around if period % 2 else around - ends / 2) / period)
    rows = series.withColumns({"trend": trend, "phase": F.pmod(F.row_number().over(w) - 1, F.lit(period))})
    detrended = F.col(value) - F.col("trend")
    phases = rows.groupBy(*by, "phase").agg(F.avg(detrended).alias("_m"))
    centre = F.avg("_m").over(Window.partitionBy(*by))
    phases = phases.select(*by, "phase", (F.col("_m") - centre).alias("seasonal"))
    parts = rows.join(phases, [*by, "phase"])
    return parts.select(*by, ts, value, "trend", "seasonal", (F.col(value) - F.col("trend") - F.col("seasonal")).alias("residual"))


def seasonal_naive(series: DataFrame, by: Sequence[str], value: str, ts: str = "ts", days: int = 14, horizon_hours: int = 168) -> DataFrame:
    """Forecast each future hour by the mean of that hour of day over the last days.

    Input has one row per key and hour.
    """
    newest = Window.partitionBy(*by).orderBy(F.desc(ts))
    recent = series.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= days * 24)
    profile = recent.groupBy(*by, F.hour(ts).alias("_h")).agg(F.avg(value).alias("_v"))
    hour = F.expr("interval 1 hour")
    ends = series.groupBy(*by).agg(F.max(ts).alias("_end"))
    future = ends.withColumn(ts, F.explode(F.sequence(F.col("_end") + hour, F.col("_end") + F.expr(f"interval {horizon_hours} hours"), hour)))
    named = future.withColumn("_h", F.hour(ts)).join(profile, [*by, "_h"], "left")
    return named.select(*by, ts, F.when(F.col("_v") < 0, 0.0).otherwise(F.col("_v")).alias("forecast"))


def ewma(df: DataFrame, by: Sequence[str], values: Sequence[str], alpha: float = 0.85, ts: str = "ts", tie: Sequence[str] = (), max_rows: int | None = None) -> DataFrame:
    """Exponential smoothing ``s = alpha * s + (1 - alpha) * x``, started at the first value.

    Rows with a NULL value are left out. A key is cut into chunks of equal length that
    are smoothed from zero; the end of every chunk, one row each, then goes on into the
    later ones with its weight, ``alpha`` to the number of rows between. The window over
    chunks ends where that weight is zero as a double; what is not finite stays for ever.
    """
    size = math.ceil(math.log(1e-18) / math.log(alpha))
    back = math.ceil(math.log(5e-324) / (size * math.log(alpha))) + 1
    numbered = skew.with_ordinal(df.dropna(subset=list(values)), by, ts, tie, "_pos", max_rows)
    chunk = F.floor((F.col("_pos") - 1) / size).cast("long")
    rows = numbered.withColumn("_chunk", chunk).withColumn("_step", F.col("_pos") - F.col("_chunk") * size)
    run = Window.partitionBy(*by, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = {v: F.when(F.col("_pos") == 1, F.col(v)).otherwise(F.col(v) * (1 - alpha)) for v in values}
    rows = rows.withColumns({f"_own_{v}": F.sum(x * F.pow(F.lit(alpha), -F.col("_step"))).over(run) * F.pow(F.lit(alpha), F.col("_step")) for v, x in shares.items()})
    ends = rows.filter(F.col("_step") == size).select(*by, "_chunk", *[F.col(f"_own_{v}").alias(f"_end_{v}") for v in values])
    order = Window.partitionBy(*by).orderBy("_chunk")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def carried(end: str) -> Column:
        finite = F.col(end).between(-1.7976931348623157e308, 1.7976931348623157e308)
        near = [F.coalesce(F.lag(F.when(finite, F.col(end)), m).over(order) if m else F.when(finite, F.col(end)), F.lit(0.0)) * alpha ** (size * m) for m in range(back)]
        return functools.reduce(lambda a, b: a + b, near) + F.coalesce(F.sum(F.when(~finite, F.col(end))).over(before), F.lit(0.0))

    starts = ends.select(*by, (F.col("_chunk") + 1).alias("_chunk"), *[carried(f"_end_{v}").alias(f"_start_{v}") for v in values])
    joined = skew.null_safe_join(rows, starts, [*by, "_chunk"], "left")
    out = {f"{v}_smooth": F.col(f"_own_{v}") + F.coalesce(f"_start_{v}", F.lit(0.0)) * F.pow(F.lit(alpha), F.col("_step")) for v in values}
    return joined.withColumns(out).drop("_chunk", "_pos", "_step", *[f"_{n}_{v}" for v in values for n in ("own", "start")])


def ewma_angle(df: DataFrame, by: Sequence[str], degrees: str, alpha: float = 0.85, ts: str = "ts", tie: Sequence[str] = (), max_rows: int | None = None) -> DataFrame:
    """Smoothed direction: the angle of the smoothed unit vector, in [0, 360).

    The vector keeps its length between steps, so that rows can be summed in any
    chunk; after the first step this differs from smoothing the angle itself.
    """
    rad = F.radians(degrees)
    smooth = ewma(df.withColumns({"_x": F.cos(rad), "_y": F.sin(rad)}), by, ["_x", "_y"], alpha, ts, tie, max_rows)
    angle = F.pmod(F.degrees(F.atan2("_y_smooth", "_x_smooth")), F.lit(360.0))
    return smooth.withColumn(f"{degrees}_smooth", angle).drop("_x", "_y", "_x_smooth", "_y_smooth")


def forecast_grid(
    last_data: DataFrame, last_forecast: DataFrame | None = None, keys: Sequence[str] = ("plant_id", "inverter_id"),
    horizon_hours: float = 48, step_minutes: int = 15,
) -> DataFrame:
    """Future times per key, from the last data or forecast to the end of the horizon.

    ``last_data`` and ``last_forecast`` hold the key and ``last_ts``. The start is
    left out and the end is included; a key whose horizon is covered gives no rows.
    """
    keys = list(keys)
    data = last_data.select(*keys, F.col("last_ts").alias("_data")).filter("_data is not null")
    if last_forecast is not None:
        data = data.join(last_forecast.select(*keys, F.col("last_ts").alias("_done")), keys, "left")
    else:
        data = data.withColumn("_done", F.lit(None).cast("timestamp"))
    step = F.expr(f"interval {step_minutes} minutes")
    first = F.greatest("_data", "_done") + step
    end = F.col("_data") + F.expr(f"interval {int(horizon_hours * 3600)} seconds")
    return data.filter(first <= end).select(*keys, F.explode(F.sequence(first, end, step)).alias("ts"))


def latest_per_key(df: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Last non-null value of every column per key, and the last time."""
    values = [c for c in df.columns if c not in (*by, ts)]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in values]
    return df.groupBy(*by).agg(F.max(ts).alias(ts), *newest)


def median_of_counts(value: str, count: str) -> Column:
    """Median of values that come with how often they occur."""
    return F.percentile(value, 0.5, F.col(count))
