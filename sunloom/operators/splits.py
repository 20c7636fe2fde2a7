"""Chronological splits and folds per inverter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.plans import skew


def numbered(df: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str], max_rows: int | None) -> DataFrame:
    """Rows with their position ``_i`` and the size ``_n`` of their key.

    One count per key serves as the size and as the measure of the largest key.
    """
    sizes = skew.lookup(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
    largest = int(sizes.agg(F.max("_n")).first()[0] or 0)
    return skew.with_ordinal(df, by, ts, tie, "_i", skew.group_rows(df, max_rows), at_most=largest).join(sizes, list(by))


def chronological_split(
    df: DataFrame, by: Sequence[str], ts: str = "ts", tie: Sequence[str] = (), train: float = 0.8, max_rows: int | None = None
) -> DataFrame:
    """``split`` is ``train`` for the first floor(train·n) rows of a key, else ``test``."""
    rows = numbered(df, by, ts, tie, max_rows)
    part = F.when(F.col("_i") <= F.floor(F.col("_n") * train), "train").otherwise("test")
    return rows.withColumn("split", part).drop("_i", "_n")


def normal_only_split(
    df: DataFrame, by: Sequence[str], label: str = "is_anomaly", ts: str = "ts", tie: Sequence[str] = (), train: float = 0.7,
    max_rows: int | None = None,
) -> DataFrame:
    """The first part of the normal rows trains; the other normal rows and all
    anomalies test. A key without normal rows is left out."""
    normal = numbered(df.filter(F.col(label) == 0), by, ts, tie, max_rows)
    part = F.when(F.col("_i") <= F.floor(F.col("_n") * train), "train").otherwise("test")
    known = df.filter(F.col(label) == 0).select(*by).distinct()
    odd = df.filter(F.col(label) == 1).join(known, list(by), "left_semi").withColumn("split", F.lit("test"))
    return normal.withColumn("split", part).drop("_i", "_n").unionByName(odd)


def time_series_folds(
    df: DataFrame, by: Sequence[str], k: int = 5, ts: str = "ts", tie: Sequence[str] = (), max_rows: int | None = None
) -> DataFrame:
    """Fold whose test block holds the row: 1 to ``k``, or 0 for rows before all blocks.

    A block has n // (k + 1) rows and the blocks end the series. Fold ``f`` trains
    on the rows of the blocks before it, ``test_fold < f``.
    """
    rows = numbered(df, by, ts, tie, max_rows)
    block = F.floor(F.col("_n") / (k + 1))
    first = F.col("_n") - block * k
    fold = F.when((block > 0) & (F.col("_i") > first), F.floor((F.col("_i") - first - 1) / F.nullif(block, F.lit(0))) + 1).otherwise(0)
    return rows.withColumn("test_fold", fold.cast("int")).drop("_i", "_n")


def fold_sets(folds: DataFrame, f: int) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of one fold."""
    return folds.filter(F.col("test_fold") < f), folds.filter(F.col("test_fold") == f)


def tagged_union(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
