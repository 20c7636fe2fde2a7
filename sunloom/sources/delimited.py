"""CSV inputs, including the export whose JSON column is not quoted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.functions.quality import blank_to_null


def read_export(spark: SparkSession, path: str, json_column: str = "raw_json") -> DataFrame:
    """Read an export file; the column names come from its first line."""
    header = spark.read.text(path).limit(1).first()
    if header is None:
        raise ValueError(f"{path} is empty")
    names = header[0].strip().split(",")
    lines = spark.read.text(path).filter(F.col("value") != header[0])
    return drop_empty_columns(split_export(lines, names, json_column))


def split_export(lines: DataFrame, names: Sequence[str], json_column: str = "raw_json") -> DataFrame:
    """Split lines at commas; what lies between the fixed ends is the JSON text.

    Quotes around the JSON are removed and those inside stay as they are. Blank
    cells become NULL. A line with too few cells is kept with its leading cells.
    """
    head = list(names).index(json_column)
    tail = len(names) - head - 1
    value = F.trim(F.col("value"))
    parts = F.split(value, ",")
    n = F.size(parts)
    middle = F.when(n - head - tail > 0, F.slice(parts, head + 1, F.greatest(n - head - tail, F.lit(0))))
    json = F.regexp_replace(F.concat_ws(",", middle), r'^"+|"+$', "")
    cut = lines.filter(value != "").select(parts.alias("p"), json.alias("j"))
    cells = [F.get(F.col("p"), F.lit(i)) for i in range(head)]
    cells.append(F.col("j"))
    whole = F.size("p") >= head + tail
    cells += [F.when(whole, F.get(F.col("p"), F.size("p") - (tail - i))) for i in range(tail)]
    return cut.select(*[blank_to_null(c).alias(n) for c, n in zip(cells, names)])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns that are NULL in every row: one aggregate row to the driver."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    return df.select(*[c for c in df.columns if counts[c]])


def usable_rows(df: DataFrame, id_column: str = "id", ts_column: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Rows whose id and time parse, and the rest; shifted cells fail one of them."""
    good = F.col(id_column).try_cast("bigint").isNotNull() & F.col(ts_column).try_cast("timestamp").isNotNull()
    return df.filter(good), df.filter(~good)


def read_dataset(spark: SparkSession, path: str, schema: str, ts: str = "timestamp") -> DataFrame:
    """Typed CSV with a header; the time column becomes a UTC instant."""
    raw = spark.read.option("header", True).schema(schema).csv(path)
    return raw.withColumn(ts, F.col(ts).cast("string").try_cast("timestamp"))


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
