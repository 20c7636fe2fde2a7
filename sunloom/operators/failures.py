"""Failures in time: system impact, component performance, daily failure summary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.functions.temporal import clear_sky_poa
from sunloom.operators.timeseries import interval_join
from sunloom.plans import skew
from sunloom.session import ensure_checkpoint_dir

# Weights of a failure by severity; any other severity counts as LOW.
STRESS_WEIGHTS = {"CRITICAL": 0.4, "HIGH": 0.25, "MEDIUM": 0.15, "LOW": 0.05}
REDUCTION_WEIGHTS = {"CRITICAL": 0.3, "HIGH": 0.2, "MEDIUM": 0.1, "LOW": 0.05}
PERFORMANCE_FACTORS = {"CRITICAL": 0.0, "HIGH": 0.3, "MEDIUM": 0.6, "LOW": 0.9}
MAX_STRESS = 1.0
MAX_REDUCTION = 0.95


def severity_value(weights: dict[str, float], severity: str = "severity") -> Column:
    out = F.when(F.col(severity) == "CRITICAL", weights["CRITICAL"])
    for name in ("HIGH", "MEDIUM"):
        out = out.when(F.col(severity) == name, weights[name])
    return out.otherwise(weights["LOW"])


def _levels() -> dict[str, Column]:
    s = F.col("severity")
    known = {n: s == n.upper() for n in ("critical", "high", "medium")}
    return {**known, "low": F.coalesce(~s.isin("CRITICAL", "HIGH", "MEDIUM"), F.lit(True))}


def _counts() -> dict[str, Column]:
    return {n: F.coalesce(c, F.lit(False)).cast("long") for n, c in _levels().items()}


def system_impact(
    points: DataFrame, failures: DataFrame, by: Sequence[str] = ("plant_id",), ts: str = "ts", max_rows: int | None = None
) -> DataFrame:
    """State of the plant at each point: active failures, components, stress, loss.

    A sweep: each failure adds at its start and takes away at its end, and a point
    reads the running totals. Components are swept one level below, where only the
    change between none and some counts. Nothing is paired, so many failures at
    once cost no more than few.
    """
    by = list(by)
    limit = skew.MAX_GROUP_ROWS if max_rows is None else max_rows
    live = failures.filter("start_ts < end_ts")
    # a failure gives at most two counts and two component changes
    bound = 4 * skew.largest_group(live, by) + skew.largest_group(points, by)
    names = list(_levels())
    marked = live.withColumns(_counts())
    sides = F.array(
        F.struct(F.col("start_ts").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("end_ts").alias("at"), F.lit(-1).alias("sign"))
    )
    edges = marked.withColumn("_e", F.explode(sides)).select(*by, "component_id", F.col("_e.at").alias("_at"), F.col("_e.sign").alias("_s"), *names)
    totals = edges.groupBy(*by, "_at").agg(*[F.sum(F.col(n) * F.col("_s")).alias(n) for n in names])

    steps = edges.groupBy(*by, "component_id", "_at").agg(F.sum("_s").alias("_d")).filter("_d <> 0").withColumn("_n", F.col("_d"))
    if bound > limit:
        ensure_checkpoint_dir(points.sparkSession)
        steps = steps.checkpoint()
    swept = skew.running_totals(steps, [*by, "component_id"], "_at", [], ["_n"], limit, bound)
    change = (F.col("_n") > 0).cast("long") - (F.col("_n") - F.col("_d") > 0).cast("long")
    parts = swept.select(*by, "_at", change.alias("components")).filter("components <> 0")
    parts = parts.groupBy(*by, "_at").agg(F.sum("components").alias("components"))

    columns = [*names, "components"]
    moves = totals.unionByName(parts, allowMissingColumns=True).withColumn("_q", F.lit(0))
    asked = points.select(*by, F.col(ts).alias("_at"), F.struct(*points.columns).alias("_p"), F.lit(1).alias("_q"))
    line = moves.unionByName(asked, allowMissingColumns=True).na.fill(0, columns)
    if bound > limit:
        line = line.checkpoint()
    state = skew.running_totals(line, by, "_at", ["_q"], columns, limit, bound).filter("_q = 1")

    def weighted(weights: dict[str, float], cap: float) -> Column:
        total = sum((F.col(n) * weights[n.upper()] for n in names), F.lit(0.0))
        return F.least(total, F.lit(cap))

    active = sum((F.col(n) for n in names), F.lit(0))
    return state.select(
        "_p.*",
        active.cast("long").alias("active_failures"),
        F.col("components").cast("long").alias("components_affected"),
        F.col("critical").cast("long").alias("critical_active"),
        weighted(STRESS_WEIGHTS, MAX_STRESS).alias("stress"),
        weighted(REDUCTION_WEIGHTS, MAX_REDUCTION).alias("performance_reduction"),
    )


def performance_multiplier(
    points: DataFrame, failures: DataFrame, point_key: Sequence[str], by: Sequence[str] = ("plant_id",), ts: str = "ts",
    failure_types: Sequence[str] | None = None, max_rows: int | None = None,
) -> DataFrame:
    """Product of the severity factors of the failures active at a point, per component.

    A sweep over each component's starts and ends gives the stretches between which its
    product is constant; a point meets one stretch of a component at most, so no point is
    paired with a failure, however many are active at once.
    """
    chosen = failures if failure_types is None else failures.filter(F.col("failure_type").isin(*failure_types))
    # as a struct, a component without a name equals itself in joins
    part = [*by, "_part"]
    limit = skew.MAX_GROUP_ROWS if max_rows is None else max_rows
    names = list(_levels())
    sides = F.array(F.struct(F.col("start_ts").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("end_ts").alias("at"), F.lit(-1).alias("sign")))
    edges = (
        chosen.filter("start_ts < end_ts").withColumns(_counts())
        .select(*by, F.struct("component_id").alias("_part"), F.explode(sides).alias("_e"), *names)
    )
    steps = edges.groupBy(*part, F.col("_e.at").alias("start_ts")).agg(*[F.sum(F.col(n) * F.col("_e.sign")).alias(n) for n in names])
    steps = steps.filter(" or ".join(f"{n} <> 0" for n in names))
    bound = skew.largest_group(steps, part)
    if bound > limit:
        ensure_checkpoint_dir(points.sparkSession)
        steps = steps.checkpoint()
    swept = skew.running_totals(steps, part, "start_ts", [], names, limit, bound)
    fr = skew.ordered_frames(swept, part, "start_ts", after=1, max_rows=limit, at_most=bound)
    stretches = fr.finish(fr.df.withColumn("end_ts", F.lead("start_ts").over(fr.window))).filter(" or ".join(f"{n} > 0" for n in names))
    factor = reduce(Column.__mul__, (F.pow(F.lit(PERFORMANCE_FACTORS[n.upper()]), F.col(n)) for n in names))
    active = interval_join(points.select(*by, *point_key, ts), stretches.select(*by, "_part.component_id", "start_ts", "end_ts", factor.alias("_factor")), by, ts)
    return active.groupBy(*by, *point_key, "component_id").agg(F.product("_factor").alias("multiplier"))


# minutes without a failing reading after which an outage of that severity counts as over
OUTAGE_GAPS = {"CRITICAL": 60, "HIGH": 30, "MEDIUM": 20, "LOW": 10}


def outage_sessions(
    failing: DataFrame, by: Sequence[str] = ("plant_id", "component_id"), ts: str = "ts", gaps: dict[str, int] | None = None, severity: str = "severity",
) -> DataFrame:
    """Outages as sessions of failing readings: start_ts, end_ts, readings, worst severity, kinds.

    A reading keeps its outage open for the gap of its severity, which is that of LOW for
    any other; readings whose stretches overlap belong together, so a late one can join
    two outages. ``end_ts`` is when the last stretch ends. Takes a table or a stream; a
    stream needs a watermark on ``ts`` and gives an outage once the watermark has passed its end.
    """
    gaps = OUTAGE_GAPS if gaps is None else gaps
    minutes = F.expr("case " + " ".join(f"when {severity} = '{n}' then '{m} minutes'" for n, m in gaps.items() if n != "LOW") + f" else '{gaps['LOW']} minutes' end")
    rank = sum((F.when(F.col(severity) == n, i).otherwise(0) for i, n in enumerate(("MEDIUM", "HIGH", "CRITICAL"), 1)), F.lit(0))
    sessions = failing.groupBy(*by, F.session_window(ts, minutes).alias("_s")).agg(
        F.count(F.lit(1)).alias("readings"), F.max(rank).alias("_worst"), F.max(ts).alias("last_ts"),
        F.array_sort(F.collect_set("failure_type")).alias("failure_types"),
    )
    worst = F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL"))), F.col("_worst") + 1)
    return sessions.select(*by, F.col("_s.start").alias("start_ts"), F.col("_s.end").alias("end_ts"), "last_ts", "readings", worst.alias("severity"), "failure_types")


def failure_episodes(silver: DataFrame, by: Sequence[str] = ("plant_id", "inverter_id"), ts: str = "ts", max_rows: int | None = None) -> DataFrame:
    """Runs of readings with active failures, as ``start_ts`` and ``end_ts``.

    A run ends at the first healthy reading after it, or at its last reading when
    none follows. Only the first and last reading of a run go to the second pass.
    """
    return _episodes(silver, list(by), ts, max_rows)[0]


def _episodes(silver: DataFrame, by: list[str], ts: str, max_rows: int | None) -> tuple[DataFrame, int | None]:
    """The episodes, and a bound of their number per key where one is known.

    There are never more run ends than readings, so keys that fit once need no
    second measurement. Otherwise the run ends are stored before they are measured.
    """
    limit = skew.MAX_GROUP_ROWS if max_rows is None else max_rows
    rows = silver.select(*by, ts, (F.coalesce("active_failures", F.lit(0)) > 0).alias("_bad"))
    fr = skew.ordered_frames(rows, by, ts, before=1, after=1, max_rows=limit)
    w = fr.window
    marked = fr.finish(
        fr.df.withColumns(
            {
                "_first": F.col("_bad") & ~F.coalesce(F.lag("_bad").over(w), F.lit(False)),
                "_last": F.col("_bad") & ~F.coalesce(F.lead("_bad").over(w), F.lit(False)),
                "_stop": F.coalesce(F.lead(ts).over(w), F.col(ts)),
            }
        )
    ).filter("_first or _last")
    bound = None if fr.chunked else limit
    if fr.chunked:
        ensure_checkpoint_dir(silver.sparkSession)
        marked = marked.checkpoint()
    ends = skew.ordered_frames(marked, by, ts, after=1, max_rows=limit, at_most=bound)
    stop = F.when(F.col("_last"), F.col("_stop")).otherwise(F.lead("_stop").over(ends.window))
    return ends.finish(ends.df.withColumn("end_ts", stop)).filter("_first").select(*by, F.col(ts).alias("start_ts"), "end_ts"), bound


def failure_daily_summary(
    silver: DataFrame, capacity_kw: float = 90.0, samples_per_hour: float = 60.0, latitude: float = 40.4168,
    longitude: float = -3.7038, max_rows: int | None = None, sites: DataFrame | None = None,
) -> DataFrame:
    """Failures of each inverter and day; the definitions are ours.

    A day has a row if an episode touches it. ``failure_count`` is the number of episodes
    that start on the day; time between failures is the mean distance of those starts
    from the start before them, and the mean repair time is that of their whole length.
    Downtime is cut at midnight, so every day of a long outage has its own part.
    ``critical_failure_count`` counts failing readings of a stopped inverter. The lost
    energy is the clear-sky yield minus the measured one over the failing readings, at
    least zero each. ``sites`` (plant_id, latitude, longitude, capacity_kw) places the
    plants; what it lacks comes from the arguments.
    """
    key = ["plant_id", "inverter_id"]
    day = [*key, "date"]
    episodes, bound = _episodes(silver, key, "ts", max_rows)
    fr = skew.ordered_frames(episodes, key, "start_ts", before=1, max_rows=max_rows, at_most=bound)
    micros = F.unix_micros("start_ts")
    spaced = fr.finish(fr.df.withColumn("_between", (micros - F.lag(micros).over(fr.window)) / 3_600_000_000))
    minutes = (F.unix_micros("end_ts") - micros) / 60_000_000
    timing = spaced.groupBy(*key, F.to_date("start_ts").alias("date")).agg(
        F.count(F.lit(1)).alias("failure_count"),
        F.avg("_between").alias("mean_time_between_failures_hours"),
        F.avg(minutes).alias("mean_time_to_repair_minutes"),
    )
    pieces = episodes.withColumn("date", F.explode(F.sequence(F.to_date("start_ts"), F.to_date("end_ts"), F.expr("interval 1 day"))))
    opens, closes = F.col("date").cast("timestamp"), F.date_add("date", 1).cast("timestamp")
    part = F.unix_micros(F.least(F.col("end_ts").cast("timestamp"), closes)) - F.unix_micros(F.greatest(F.col("start_ts").cast("timestamp"), opens))
    down = pieces.groupBy(*day).agg(F.sum(part / 60_000_000).alias("total_downtime_minutes"))
    bad = silver.filter("active_failures > 0")
    place = {"latitude": F.lit(latitude), "longitude": F.lit(longitude), "capacity_kw": F.lit(capacity_kw)}
    if sites is not None:
        named = sites.select("plant_id", *[F.col(c).cast("double").alias(f"_{c}") for c in place])
        bad = bad.join(named, "plant_id", "left")
        place = {c: F.coalesce(f"_{c}", value) for c, value in place.items()}
    expected = clear_sky_poa("ts", place["latitude"], place["longitude"]) / 1000 * place["capacity_kw"]
    lost = F.greatest(expected - F.coalesce("ac_power_kw", F.lit(0.0)), F.lit(0.0)) / samples_per_hour
    readings = bad.groupBy(*key, F.to_date("ts").alias("date")).agg(
        F.count_if(F.col("state") != 1).alias("critical_failure_count"),
        F.sum(lost).alias("estimated_energy_loss_kwh"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("failure_types")))).alias("failure_types"),
    )
    joined = down.join(timing, day, "left").join(readings, day, "left")
    return joined.select(
        "plant_id", "date", F.lit("inverter").alias("component_type"), F.col("inverter_id").alias("component_id"),
        F.coalesce("failure_count", F.lit(0)).alias("failure_count"),
        F.coalesce("critical_failure_count", F.lit(0)).alias("critical_failure_count"),
        F.coalesce("failure_types", F.array().cast("array<string>")).alias("failure_types"),
        "total_downtime_minutes", F.coalesce("estimated_energy_loss_kwh", F.lit(0.0)).alias("estimated_energy_loss_kwh"),
        "mean_time_between_failures_hours", "mean_time_to_repair_minutes",
    )
