"""Raw telemetry messages: streams and files in, typed bronze rows out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.schemas import MEASURES, TOPICS, message_schema

#: keys that tell the kind of a message, in order of priority
TYPE_KEYS = [
    ("inverter", ["inverter_id"]),
    ("meteo", ["poa_irradiance_wm2", "amb_temp_C"]),
    ("poi_meter", ["export_active_power_kW", "import_active_power_kW"]),
    ("system_status", ["system_impact", "component_status"]),
]

UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def kafka_messages(spark: SparkSession, servers: str, topics: Sequence[str] = tuple(TOPICS.values()), **options: str) -> DataFrame:
    """Stream of ``value, topic, partition, offset, received_at`` from the earliest offset.

    Needs Spark's Kafka connector on the cluster.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest")
    )
    raw = reader.options(**options).load()
    return raw.select(
        F.col("value").cast("string").alias("value"), "topic", "partition", "offset",
        F.col("timestamp").alias("received_at"),
    )


def file_messages(spark: SparkSession, path: str, streaming: bool = True, max_files: int | None = None) -> DataFrame:
    """The same message column from text files, one message per line."""
    if not streaming:
        return spark.read.text(path)
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def message_type(payload: Column | str = "value") -> Column:
    """Kind of message by the keys it has; the first match wins.

    A key whose value is JSON null counts as present. Text that is not a JSON
    object gives NULL.
    """
    text = F.col(payload) if isinstance(payload, str) else payload

    def rank(key: Column) -> Column:
        found = F.when(key == TYPE_KEYS[0][1][0], 1)
        for i, (_, names) in enumerate(TYPE_KEYS[1:], start=2):
            found = found.when(key.isin(*names), i)
        return found.otherwise(len(TYPE_KEYS) + 1)

    # the payload is named once: a filter on the type may be pushed below costly columns
    keys = F.concat(F.json_object_keys(text), F.array(F.lit("")))
    names = F.array(*[F.lit(k) for k, _ in TYPE_KEYS], F.lit("unknown"))
    return F.get(names, F.array_min(F.transform(keys, rank)) - 1)


def route(df: DataFrame, payload: str = "value") -> DataFrame:
    return df.withColumn("message_type", message_type(payload))


def number(c: Column, target: str) -> Column:
    """Text to a number; whole numbers may be written with a fraction."""
    wide = c.try_cast("double")
    if target == "double":
        return wide
    return F.when(wide >= 0, F.floor(wide)).otherwise(F.ceil(wide)).try_cast(target)


def truth(c: Column) -> Column:
    """JSON value as a boolean: missing, zero and empty are false, so is the text ``false``."""
    empty = c.isNull() | F.lower(F.trim(c)).isin("", "false", "0", "0.0", "null", "[]", "{}")
    return ~empty


def bronze(df: DataFrame, kind: str, payload: str = "value") -> DataFrame:
    """Typed rows of one kind from routed messages, with the payload kept as ``raw_json``."""
    m = F.from_json(F.col(payload), message_schema(kind)).alias("m")
    parsed = df.select("*", m)
    ts = F.col("m.timestamp").try_cast("timestamp").alias("ts")
    cols: list[Column] = [F.col("m.guid").alias("plant_id")]
    if kind == "inverter":
        cols.append(F.col("m.inverter_id").alias("inverter_id"))
    cols.append(ts)
    if kind == "system_status":
        impact, parts = F.col("m.system_impact"), F.col("m.component_status")
        listed = F.from_json(impact["affected_components"], "array<string>")
        cols += [
            number(impact["total_failures"], "int").alias("total_failures"),
            number(impact["stress_level"], "double").alias("stress_level"),
            F.coalesce(F.size(listed), F.lit(0)).alias("affected_components"),
            number(impact["critical_failures"], "int").alias("critical_failures"),
            number(parts["total"], "int").alias("total_components"),
            number(parts["healthy"], "int").alias("healthy_components"),
            number(parts["failed"], "int").alias("failed_components"),
        ]
    else:
        cols += [number(F.col(f"m.{n}"), t).alias(n.lower()) for n, t in MEASURES[kind].items()]
    if kind == "inverter":
        listed = F.from_json(F.col("m.failure_types"), "array<string>")
        cols.append(F.coalesce(listed, F.array().cast("array<string>")).alias("failure_types"))
    if kind == "poi_meter":
        cols.append(truth(F.col("m.connection_issues")).alias("connection_issues"))
    kept = [c for c in df.columns if c not in (payload, "message_type")]
    return parsed.select(*cols, F.col(payload).alias("raw_json"), *kept)


def rejection(kind: str, uuid_plants: bool = True) -> Column:
    """Why a bronze row may not be stored; NULL when it may."""
    plant_ok = F.col("plant_id").rlike(UUID) if uuid_plants else F.lit(True)
    checks = [
        (F.col("plant_id").isNull(), "plant_id missing"),
        (~plant_ok, "plant_id is not a UUID"),
        (F.col("ts").isNull(), "timestamp missing or unreadable"),
    ]
    if kind == "inverter":
        checks.insert(2, (F.col("inverter_id").isNull(), "inverter_id missing"))
    reason = F.when(checks[0][0], checks[0][1])
    for test, text in checks[1:]:
        reason = reason.when(test, text)
    return reason


def split_valid(df: DataFrame, kind: str, uuid_plants: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy the required fields, and the rest with ``error_message``."""
    checked = df.withColumn("error_message", rejection(kind, uuid_plants))
    return checked.filter("error_message is null").drop("error_message"), checked.filter("error_message is not null")


def archive_envelope(df: DataFrame) -> DataFrame:
    """Messages as ``topic`` and one JSON line ``{timestamp, topic, partition, offset, data}``."""
    body = F.struct(
        F.col("received_at").cast("string").alias("timestamp"), "topic", "partition", "offset",
        F.try_parse_json("value").alias("data"),
    )
    return df.select("topic", F.to_json(body).alias("value"))
