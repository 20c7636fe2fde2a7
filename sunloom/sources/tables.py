"""Table reads and writes: append, upsert, insert-ignore, partial upsert, archives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, path: str, where: Column | str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Stored table with optional row and column selection, both pushed to the scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
        return True
    except Exception as exc:  # Spark reports an absent or empty folder in two ways
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return False
        raise


def with_event_date(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("event_date", F.to_date(ts))


def append(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append rows to a table partitioned by the date of ``ts``."""
    with_event_date(df, ts).write.mode("append").partitionBy("event_date").parquet(path)


def append_batch(df: DataFrame, path: str, batch_id: int, ts: str = "ts") -> None:
    """Append one micro-batch; a replay of the batch replaces what it wrote before."""
    dated = with_event_date(df, ts).withColumn("batch_id", F.lit(batch_id).cast("long"))
    writer = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch_id", "event_date").parquet(path)


def replace_batch(df: DataFrame, path: str, feed: str, batch_id: int | None) -> None:
    """Rows of one micro-batch of one feed, whatever day it is run on; a replay replaces them.

    Without a number the rows are added under -1.
    """
    numbered = df.withColumns({"feed": F.lit(feed), "batch_id": F.lit(-1 if batch_id is None else batch_id).cast("long")})
    writer = numbered.write.mode("append" if batch_id is None else "overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("feed", "batch_id").parquet(path)


def daily_files(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append with the rows of a day brought together, so a day gets few files.

    A day above the size Spark aims at per task is split by adaptive execution.
    """
    dated = with_event_date(df, ts)
    dated.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(path)


def archive(df: DataFrame, path: str) -> None:
    """Message archive: JSON lines, one folder per topic."""
    df.select("topic", "value").write.mode("append").partitionBy("topic").text(path)


def keep_latest(df: DataFrame, keys: Sequence[str], recency: Sequence[str]) -> DataFrame:
    """The newest row of each key, as an aggregate: copies shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*recency)).alias("_r")
    return df.groupBy(*keys).agg(newest).select(*keys, "_r.*").select(*df.columns)


def merged(existing: DataFrame | None, new: DataFrame, keys: Sequence[str], recency: Sequence[str]) -> DataFrame:
    """Content of a table after an upsert: the new row wins over a stored one.

    Among new rows of one key the greatest ``recency`` wins.
    """
    stamped = new.withColumn("_gen", F.lit(1))
    both = stamped if existing is None else existing.withColumn("_gen", F.lit(0)).unionByName(stamped, allowMissingColumns=True)
    return keep_latest(both, keys, ["_gen", *recency]).drop("_gen")


def upsert(df: DataFrame, path: str, keys: Sequence[str], recency: Sequence[str], ts: str | None, days: Sequence | None = None) -> None:
    """Insert or replace rows by key.

    Only the date partitions the batch touches are read and rewritten; ``days``
    names them where the caller knows. Spark writes such partitions aside and swaps
    them in when the job is done, so the table may be read meanwhile. There is one
    writer per table. ``ts`` of ``None`` means an unpartitioned table.
    """
    spark = df.sparkSession
    existing = spark.read.parquet(path) if table_exists(spark, path) else None
    if ts is None:
        # the whole folder is replaced, so the result has to be stored elsewhere first
        ensure_checkpoint_dir(spark)
        merged(existing, df, keys, recency).checkpoint().write.mode("overwrite").parquet(path)
        return
    dated = with_event_date(df, ts)
    if existing is not None:
        if days is None:
            # at most one value per calendar day of the batch
            days = [r[0] for r in dated.select("event_date").distinct().collect()]
        # literals prune the scan to the touched partitions
        existing = existing.filter(F.col("event_date").isin(list(days)))
    result = merged(existing, dated, [*keys, "event_date"], recency)
    # bring the rows of a day together, or every task writes a file for every day
    writer = result.hint("rebalance", "event_date").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)


def absent_rows(new: DataFrame, existing: DataFrame | None, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """New rows whose key is not stored yet; of equal keys the first by ``order`` stays."""
    rest = [c for c in new.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r") if rest else F.lit(None).alias("_r")
    once = new.groupBy(*keys).agg(first)
    once = once.select(*keys, "_r.*").select(*new.columns) if rest else once.select(*keys)
    return once if existing is None else once.join(existing, list(keys), "left_anti")


def insert_ignore(new: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], ts: str = "ts") -> None:
    """Add rows whose key is not stored yet.

    Where the time is part of the key, a row can only stand on its own day, so only the
    days of the batch are read, given as literals that prune the scan.
    """
    spark = new.sparkSession
    ensure_checkpoint_dir(spark)
    existing = spark.read.parquet(path) if table_exists(spark, path) else None
    if existing is not None and ts in keys:
        new = new.checkpoint()
        # at most one value per calendar day of the batch
        days = [r[0] for r in new.select(F.to_date(ts)).distinct().collect()]
        existing = existing.filter(F.col("event_date").isin(days))
    append(absent_rows(new, existing, keys, order).checkpoint(), path, ts)


def partial_upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str], now: Column | None = None) -> DataFrame:
    """Dimension rows after an update of only ``columns``; other columns keep their value.

    A key that is only in ``new`` is inserted with all its columns. ``updated_at``
    is set on every row the update touches.
    """
    now = F.current_timestamp() if now is None else now
    old, fresh = existing.alias("o"), new.withColumn("_in", F.lit(True)).alias("n")
    joined = old.withColumn("_old", F.lit(True)).alias("o").join(fresh, list(keys), "full_outer")
    out = [F.col(k) for k in keys]
    for c in existing.columns:
        if c in keys:
            continue
        if c == "updated_at":
            out.append(F.when(F.col("n._in"), now).otherwise(F.col("o.updated_at")).alias(c))
        elif c not in new.columns:
            out.append(F.col(f"o.{c}"))
        elif c in columns:
            out.append(F.when(F.col("n._in"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(F.col("o._old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return joined.select(*out)


def trigger_counts(batch: DataFrame, kind: str = "message_type", notify: Sequence[str] = ("inverter", "meteo")) -> DataFrame:
    """One notification row per kind that has rows; only some kinds notify."""
    return (
        batch.filter(F.col(kind).isin(*notify))
        .groupBy(F.col(kind).alias("data_type"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.lit("silver_batch_processed").alias("event"), "data_type", "count")
    )


def publish(df: DataFrame, servers: str, topic: str = "inference-trigger") -> None:
    """Send rows as JSON to a topic; needs Spark's Kafka connector on the cluster."""
    body = F.to_json(F.struct(*df.columns)).alias("value")
    df.select(body).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def batch_outcome(batch: DataFrame, error: str = "error_message", kind: str = "message_type") -> DataFrame:
    """Processed and failed rows per kind."""
    return batch.groupBy(kind).agg(
        F.count_if(F.col(error).isNull()).alias("processed"), F.count_if(F.col(error).isNotNull()).alias("failed")
    )
