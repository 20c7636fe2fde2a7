"""Structured Streaming jobs: messages to bronze, bronze to silver and gold, scoring."""

from __future__ import annotations

import json
import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState

from sunloom.functions.quality import clean
from sunloom.operators import failures, reads, timeseries
from sunloom.plans.medallion import SILVER, Warehouse, on_days, refresh, refresh_open_plants, refresh_plant_hours
from sunloom.schemas import KEYS, KINDS
from sunloom.session import ensure_checkpoint_dir
from sunloom.sources import messages, tables


def started(writer: DataStreamWriter, checkpoint: str, seconds: float | None) -> StreamingQuery:
    """Start with a checkpoint; without an interval take all there is and stop.

    A restart continues from the checkpoint, so a failed job is simply started again.
    """
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return writer.trigger(**trigger).start()


def store_bronze(house: Warehouse, batch: DataFrame, batch_id: int, uuid_plants: bool = True) -> None:
    """Route one batch of messages into the bronze tables and the dead letters.

    No message raises: what cannot be typed or lacks a required field is stored
    with the reason. The batch is kept in memory for the writes that follow and is
    computed again where an executor is lost.
    """
    routed = messages.route(batch).withColumn("ingested_at", F.current_timestamp()).persist()
    try:
        dead = [
            routed.filter(F.col("message_type").isNull() | (F.col("message_type") == "unknown")).select(
                F.coalesce("message_type", F.lit("unreadable")).alias("message_type"),
                F.when(F.col("message_type").isNull(), "not a JSON object").otherwise("unknown kind of message").alias("error_message"),
                F.col("value").alias("raw_json"), "ingested_at",
            )
        ]
        for kind in KINDS:
            rows = messages.bronze(routed.filter(F.col("message_type") == kind), kind)
            good, bad = messages.split_valid(rows, kind, uuid_plants)
            tables.append_batch(good, house.path(f"bronze_{kind}"), batch_id)
            dead.append(bad.select(F.lit(kind).alias("message_type"), "error_message", "raw_json", "ingested_at"))
        letters = dead[0]
        for part in dead[1:]:
            letters = letters.unionByName(part)
        tables.append_batch(letters, house.path("dead_letters"), batch_id, "ingested_at")
        store_outcome(house, stored_outcome(house, batch_id), "bronze", batch_id)
    finally:
        routed.unpersist()


def stored_outcome(house: Warehouse, batch_id: int) -> DataFrame:
    """Processed and failed rows per kind, of what a batch has stored in bronze and dead letters."""
    rows = house.spark.createDataFrame([], "message_type string, error_message string")
    for kind in KINDS:
        path = f"{house.path(f'bronze_{kind}')}/batch_id={batch_id}"
        if tables.table_exists(house.spark, path):
            rows = rows.unionByName(house.spark.read.parquet(path).select(F.lit(kind).alias("message_type"), F.lit(None).cast("string").alias("error_message")))
    path = f"{house.path('dead_letters')}/batch_id={batch_id}"
    if tables.table_exists(house.spark, path):
        rows = rows.unionByName(house.spark.read.parquet(path).select("message_type", "error_message"))
    return tables.batch_outcome(rows)


def store_outcome(house: Warehouse, outcome: DataFrame, stage: str, batch_id: int | None) -> None:
    """Counts of a batch in ``run_metrics``; a replay replaces them."""
    tables.replace_batch(outcome.withColumn("ts", F.current_timestamp()), house.path("run_metrics"), stage, batch_id)


def ingest(house: Warehouse, stream: DataFrame, checkpoint: str, seconds: float | None = None, uuid_plants: bool = True) -> StreamingQuery:
    """Messages with a ``value`` column to bronze."""
    writer = stream.writeStream.foreachBatch(lambda df, i: store_bronze(house, df, i, uuid_plants))
    return started(writer, checkpoint, seconds)


def archive(stream: DataFrame, path: str, checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """Every message of every topic as JSON lines, one folder per topic."""
    lines = messages.archive_envelope(stream)
    return started(lines.writeStream.format("text").partitionBy("topic").option("path", path), checkpoint, seconds)


def store_silver(house: Warehouse, kind: str, batch: DataFrame, notify: Callable[[DataFrame], None] | None = None, batch_id: int | None = None, **options) -> None:
    """Clean one batch, upsert it, note the count and refresh the gold rows it touches.

    Of several messages for one key the last to arrive is kept, by offset where the
    source has one. The count goes to the trigger table, and to ``notify`` if given,
    such as a function that calls :func:`sunloom.sources.tables.publish`. With a
    ``batch_id`` a replay replaces its count. The cleaned rows are kept for the batch,
    since the upsert and the refresh both read them.
    """
    if batch.isEmpty():
        return
    rows = clean(batch.drop("batch_id", "event_date"), kind).persist()
    try:
        arrival = [c for c in ("ingested_at", "offset", "raw_json") if c in rows.columns]
        house.upsert(rows, SILVER[kind], arrival, "ts")
        counted = tables.trigger_counts(rows.withColumn("message_type", F.lit(kind))).withColumn("ts", F.current_timestamp())
        tables.replace_batch(counted, house.path("inference_trigger"), kind, batch_id)
        outcome = tables.batch_outcome(rows.select(F.lit(kind).alias("message_type"), F.lit(None).cast("string").alias("error_message")))
        store_outcome(house, outcome, f"silver_{kind}", batch_id)
        if notify:
            notify(counted)
        refresh(house, kind, rows, batch_id=batch_id, **options)
    finally:
        rows.unpersist()


def bronze_to_gold(house: Warehouse, kind: str, checkpoint: str, seconds: float | None = None, max_files: int | None = None, **options) -> StreamingQuery:
    """New bronze rows of one kind to silver and gold.

    ``max_files`` bounds a batch, which throttles a large back-fill. The plant tables
    belong to :func:`plants_to_gold`, so that feeds may run at the same time; with
    ``plants=True`` this stream writes them itself, for a warehouse with one feed at a time.
    """
    options = {"plants": False} | options
    path = house.path(f"bronze_{kind}")
    reader = house.spark.readStream.schema(house.spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    writer = reader.parquet(path).writeStream.foreachBatch(lambda df, i: store_silver(house, kind, df, batch_id=i, **options))
    return started(writer, checkpoint, seconds)


def plants_to_gold(house: Warehouse, checkpoint: str, seconds: float | None = None, max_files: int | None = None, **options) -> StreamingQuery:
    """The one writer of the plant tables: plant hours that any feed has touched.

    A feed lists its hours after it has stored them, so the rows of all feeds up to then
    are read. Hours are recomputed whole, which makes replays harmless, and a feed that
    starts late touches the old hours again. Each batch also takes up what earlier runs left open.
    """
    path = house.path("plant_work")
    reader = house.spark.readStream.schema("plant_id string, timestamp_hour timestamp, feed string, batch_id long")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def run(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        refresh_plant_hours(house, batch, **options)
        if house.exists("inverter_hourly"):
            refresh_open_plants(house, **options)

    return started(reader.parquet(path).writeStream.foreachBatch(run), checkpoint, seconds)


def store_forecasts(
    house: Warehouse, predict: Callable[[DataFrame], DataFrame], run_id: str, horizon_hours: float = 48, step_minutes: int = 15, since: str | None = None,
) -> bool:
    """Forecast the horizon after each inverter's last reading and store what is new.

    ``predict`` adds ``predicted_ac_power_kw`` to rows of plant_id, inverter_id and ts; a
    time it has no value for is not stored. Times this run has stored already are not
    asked again, and rows are upserted, so the job may be repeated. ``since`` is a date:
    inverters without a reading from it on are left out and older days are not read.
    Returns whether rows were stored.
    """
    ensure_checkpoint_dir(house.spark)
    key = ["plant_id", "inverter_id"]
    telemetry = house.read(SILVER["inverter"])
    if since is not None:
        telemetry = telemetry.filter(F.col("event_date") >= F.lit(since).cast("date"))
    done = None
    if house.exists("forecast_predictions"):
        done = house.read("forecast_predictions").filter(F.col("model_run_id") == run_id).groupBy(*key).agg(F.max("ts").alias("last_ts"))
    grid = timeseries.forecast_grid(telemetry.groupBy(*key).agg(F.max("ts").alias("last_ts")), done, key, horizon_hours, step_minutes)
    rows = predict(grid).select(*key, "ts", F.lit(run_id).alias("model_run_id"), "predicted_ac_power_kw").dropna(subset=["predicted_ac_power_kw"]).checkpoint()
    if rows.isEmpty():
        return False
    house.upsert(rows, "forecast_predictions", [], "ts")
    return True


def deduplicated(stream: DataFrame, keys: Sequence[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drop repeated messages that arrive within the delay of the first."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def hourly_energy(stream: DataFrame, delay: str = "10 minutes", samples_per_hour: float = 60.0) -> DataFrame:
    """Final hourly energy per inverter, for an append sink.

    An hour is emitted once the watermark has passed its end; rows later than that
    are left out, unlike with :func:`bronze_to_gold`, which recomputes the hour.
    """
    hours = stream.withWatermark("ts", delay).groupBy("plant_id", "inverter_id", F.window("ts", "1 hour"))
    out = hours.agg(
        (F.sum(F.coalesce("ac_power_kw", F.lit(0.0))) / samples_per_hour).alias("energy_kwh"),
        F.avg("ac_power_kw").alias("avg_power_kw"), F.count(F.lit(1)).alias("record_count"),
    )
    return out.select("plant_id", "inverter_id", F.col("window.start").alias("timestamp_hour"), "energy_kwh", "avg_power_kw", "record_count")


def outage_sessions(stream: DataFrame, by: Sequence[str] = ("plant_id", "component_id"), ts: str = "ts", delay: str = "1 hour", gaps: dict[str, int] | None = None) -> DataFrame:
    """Final outages of each component, for an append sink; a reading within the delay can still join two."""
    return failures.outage_sessions(stream.withWatermark(ts, delay), by, ts, gaps)


def nearest_joined(
    left: DataFrame, right: DataFrame, tolerance: str = "30 minutes", delay: str = "1 hour", by: Sequence[str] = ("plant_id",), ts: str = "ts",
    key: str = "id", right_order: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of one stream with the nearest row of another, for an append sink.

    Both streams wait for ``delay``. They are laid out in time cells, right rows in every
    cell that the tolerance reaches, and a cell's state holds the rows that may still be
    asked for. A left row is answered by a binary search once no match can arrive any
    more: the work is linear and no pairs are formed. Left rows of one time and ``key``
    come once. The nearest is chosen as in
    :func:`sunloom.operators.timeseries.asof_nearest`: a tie goes to the earlier side,
    there to the last by ``right_order``, on the later side to the first. Left rows
    without a match come with nulls; those without a time are dropped.
    """
    by = list(by)
    payload = [c for c in right.columns if c not in (*by, ts)]
    order = list(right_order or payload)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    reach = left.sparkSession.sql(f"select unix_micros(timestamp_micros(0) + interval {tolerance})").first()[0]
    width = max(reach, timeseries.HOUR_US)
    text = lambda columns: F.to_json(F.struct(*columns), EXACT_JSON)
    lefts = left.withWatermark(ts, delay).withColumn("_t", micros).filter("_t is not null").select(
        *by, ts, "_t", F.floor(F.col("_t") / width).alias("_cell"), F.lit(True).alias("_asks"), text([key]).alias("_k"), text(left.columns).alias("_row"),
    )
    reached = F.sequence(F.floor((F.col("_t") - reach) / width), F.floor((F.col("_t") + reach) / width))
    rights = right.withWatermark(ts, delay).withColumn("_t", micros).dropna(subset=["_t", *by]).select(
        *by, ts, "_t", F.explode(reached).alias("_cell"), F.lit(False).alias("_asks"), text(order).alias("_k"), text(payload).alias("_row"),
    )
    doubles = [c for c in order if right.schema[c].dataType.typeName() in ("double", "float")]
    met = lefts.union(rights).groupBy(*by, "_cell").applyInPandasWithState(
        nearest_of_cell(reach, width, doubles), "_l string, _r string", "held binary", "append", "EventTimeTimeout",
    )
    read = lambda c, columns, df: F.from_json(c, df.select(*columns).schema, EXACT_JSON | {"mode": "FAILFAST"}).alias(c)
    back = met.select(read("_l", left.columns, left), read("_r", payload, right))
    return back.select("_l.*", *(F.col(f"_r.{c}").alias(c) for c in payload))


#: rows as text that gives every value back as it was; pandas would make doubles of whole numbers beside nulls
EXACT_JSON = {"ignoreNullFields": "false", "timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def nearest_of_cell(reach: int, width: int, doubles: Sequence[str]) -> Callable:
    """The step of :func:`nearest_joined` on one time cell: keep what comes, answer the left rows that are due."""
    odd = {"-Infinity": (1,), "Infinity": (3,), "NaN": (4,)}

    def place(text: str) -> list[tuple]:
        # as Spark orders: null first, NaN last
        values = json.loads(text, parse_float=Decimal).items()
        return [(0,) if v is None else odd[v] if c in doubles and isinstance(v, str) else (2, v) for c, v in values]

    def run(cell: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lefts, rights = pickle.loads(state.get[0]) if state.exists else ({}, [])
        for rows in batches:
            for at, asks, k, row in zip(rows["_t"].tolist(), rows["_asks"], rows["_k"], rows["_row"], strict=True):
                if asks:
                    lefts.setdefault((at, k), row)
                else:
                    rights.append((at, k, row))
        now = state.getCurrentWatermarkMs()
        due = [k for k in lefts if k[0] + reach <= now * 1000]
        if due:
            rights.sort(key=lambda r: (r[0], place(r[1])))
            times = [at for at, _, _ in rights]
            found = []
            for at, _ in due:
                later = bisect_right(times, at)
                back = at - times[later - 1] if later else reach + 1
                ahead = times[later] - at if later < len(times) else reach + 1
                found.append(rights[later - 1 if back <= ahead else later][2] if min(back, ahead) <= reach else None)
            yield pd.DataFrame({"_l": [lefts.pop(k) for k in due], "_r": found})
        closed = (int(cell[-1]) + 1) * width
        waits = min((at for at, _ in lefts), default=None)
        if waits is None and closed <= now * 1000:
            if state.exists:
                state.remove()
            return
        # left rows still to come are later than the watermark
        least = (now * 1000 if waits is None else min(waits, now * 1000)) - reach
        state.update((pickle.dumps((lefts, [r for r in rights if r[0] >= least])),))
        # a timeout has to be passed by the watermark, not met
        state.setTimeoutTimestamp(max(-(-(closed if waits is None else waits + reach) // 1000) - 1, now + 1))

    return run


def score_new_rows(house: Warehouse, score: Callable[[DataFrame], DataFrame], reprocess_from: str | None = None) -> bool:
    """Score silver rows later than the watermark of their plant and inverter, then move it.

    Weather is read for the days of those rows alone, named as literals.

    ``score`` takes telemetry with weather and returns the prediction table's
    columns. Rows that arrive later than the watermark are skipped unless
    ``reprocess_from`` names a time to start from. Returns whether rows were scored.
    """
    ensure_checkpoint_dir(house.spark)
    telemetry = house.read(SILVER["inverter"])
    if reprocess_from is not None:
        telemetry = telemetry.filter(F.col("ts") > F.lit(reprocess_from).cast("timestamp"))
    elif house.exists("inference_watermark"):
        marks = house.read("inference_watermark").filter("inference_mode = 'anomaly'")
        telemetry = reads.since_watermark(telemetry, marks, ["plant_id", "inverter_id"])
    telemetry = telemetry.checkpoint()
    # one value per calendar day of what is to be scored
    days = [r[0] for r in telemetry.select("event_date").distinct().collect()]
    if not days:
        return False
    weather = on_days(house.read(SILVER["meteo"]), days).select(
        "plant_id", "ts", "amb_temp_c", "module_temp_c", "wind_speed_ms", "wind_dir_deg", "humidity_percent", "poa_irradiance_wm2"
    )
    scored = score(reads.with_weather(telemetry.drop("event_date"), weather)).checkpoint()
    if scored.isEmpty():
        return False
    house.insert_only(scored, "anomaly_predictions", "ts")
    marks = reads.advanced_watermark(scored)
    tables.upsert(marks, house.path("inference_watermark"), KEYS["inference_watermark"], ["last_processed_ts"], None)
    return True


def score_on_trigger(house: Warehouse, score: Callable[[DataFrame], DataFrame], checkpoint: str, seconds: float | None = 300) -> StreamingQuery:
    """Score when at least one notification came in and the interval has passed."""
    path = house.path("inference_trigger")
    events = house.spark.readStream.schema(house.spark.read.parquet(path).schema).parquet(path)

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            score_new_rows(house, score)

    return started(events.writeStream.foreachBatch(run), checkpoint, seconds)


def to_console(stream: DataFrame, checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """Print a stream, for looking at it."""
    return started(stream.writeStream.format("console"), checkpoint, seconds)
