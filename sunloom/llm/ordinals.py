"""Gapless numbers within groups, where one group may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows that one task should number at a time
ROWS_A_BUCKET = 50_000


def bucket_count(rows: int, rows_a_bucket: int = ROWS_A_BUCKET) -> int:
    return max(16, -(-rows // rows_a_bucket))


def with_ordinals(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column], name: str, measures: Sequence[str] = ()) -> DataFrame:
    """Number the rows of each group from 0, ordered by ``bucket`` and then by ``order``.

    A group is cut into buckets, which tasks number on their own; the totals of the
    earlier buckets, one row per group and bucket, are added. For each of ``measures``
    a column ``before_<measure>`` sums that measure over the earlier rows of the group.
    Null keys are groups of their own.
    """
    df = df.withColumn("_b", bucket)
    totals = df.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(m).alias(f"_s_{m}") for m in measures))
    earlier = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *(F.col(g).alias(f"_g_{g}") for g in group), F.col("_b").alias("_gb"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        *(F.coalesce(F.sum(f"_s_{m}").over(earlier), F.lit(0)).alias(f"_s0_{m}") for m in measures),
    )
    inside = Window.partitionBy(*group, "_b").orderBy(*order)
    summed = inside.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(name, F.row_number().over(inside).cast("long") - 1)
    for m in measures:
        df = df.withColumn(f"before_{m}", F.coalesce(F.sum(m).over(summed), F.lit(0)))
    same = F.col("_b") == F.col("_gb")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    df = df.join(totals, same, "left").withColumn(name, F.col(name) + F.col("_n0"))
    for m in measures:
        df = df.withColumn(f"before_{m}", F.col(f"before_{m}") + F.col(f"_s0_{m}"))
    return df.drop("_b", "_gb", "_n0", *(f"_g_{g}" for g in group), *(f"_s0_{m}" for m in measures))
