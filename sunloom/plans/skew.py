"""Order-dependent work that stays exact when one key holds most of the rows.

Everything here follows one rule: measure the largest group with one
aggregation, use Spark's own window or aggregate while it fits a task, and
otherwise work on pieces of bounded size that give the same answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunloom.session import ensure_checkpoint_dir

#: rows one task may hold for one key before the key is cut into pieces
MAX_GROUP_ROWS = 5_000_000

#: bytes of the rows one task may hold for one key, as :func:`row_bytes` counts them; a sort and a window hold them twice
MAX_GROUP_BYTES = 128 << 20

#: values (rows times columns) of a table that may be broadcast, about 32 MB
BROADCAST_CELLS = 4_000_000

#: widths tried, widest first, when a key is cut along time (microseconds)
BUCKET_WIDTHS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)


def row_bytes(kind: T.DataType) -> int:
    """About how many bytes a value or row of this type takes in a sort."""
    if isinstance(kind, T.StructType):
        return 16 + sum(row_bytes(f.dataType) for f in kind)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return 64
    return 24 if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def group_rows(df: DataFrame, max_rows: int | None = None) -> int:
    """Rows one task may hold for one key: fewer when they are wide, unless a bound is given."""
    return max(1, min(MAX_GROUP_ROWS, MAX_GROUP_BYTES // row_bytes(df.schema))) if max_rows is None else max_rows


def largest_group(df: DataFrame, by: Sequence[Column | str]) -> int:
    """Rows of the largest group: a map-side combined count, one number to the driver."""
    top = df.groupBy(*by).count().agg(F.max("count").alias("n")).first()
    return int(top["n"] or 0)


def lookup(small: DataFrame) -> DataFrame:
    """A per-key table, computed once, counted, and broadcast when it is small.

    Spark cannot tell that an aggregate over a huge table is small and would shuffle
    the huge side of a join with it. A table above the bound is joined by shuffle.
    """
    ensure_checkpoint_dir(small.sparkSession)
    stored = small.checkpoint()
    return F.broadcast(stored) if stored.count() * len(stored.columns) <= BROADCAST_CELLS else stored


def fits(df: DataFrame, by: Sequence[Column | str], max_rows: int, at_most: int | None) -> bool:
    """Whether every group fits a task; measured unless a known bound already says so."""
    if at_most is not None and at_most <= max_rows:
        return True
    return largest_group(df, by) <= max_rows


def time_bucket(ts: Column | str, width_us: int) -> Column:
    """Number of the time bucket of the given width that holds ``ts``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(width_us)).cast("long")


def fitting_width(df: DataFrame, by: Sequence[str], ts: str, max_rows: int) -> int:
    """Widest bucket width whose largest (key, bucket) group fits ``max_rows``."""
    for width in BUCKET_WIDTHS:
        if largest_group(df, [*by, time_bucket(ts, width).alias("_b")]) <= max_rows:
            return width
    return BUCKET_WIDTHS[-1]


def with_ordinal(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    tie: Sequence[str] = (),
    name: str = "ordinal",
    max_rows: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row within its key, by time then ``tie``.

    A key too large for one task is numbered inside time buckets, and each bucket
    starts at the count of rows before it; those counts are one row per bucket.
    ``at_most`` is a bound of the group size the caller knows, here and below.
    """
    max_rows = MAX_GROUP_ROWS if max_rows is None else max_rows
    order = [F.col(ts), *[F.col(c) for c in tie]]
    if fits(df, by, max_rows, at_most):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    width = fitting_width(df, by, ts, max_rows)
    bucketed = df.withColumn("_b", time_bucket(ts, width))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        bucketed.groupBy(*by, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order))
    return (
        bucketed.withColumn(name, inside)
        .join(starts, [*by, "_b"])
        .withColumn(name, (F.col(name) + F.col("_start")).cast("long"))
        .drop("_b", "_start")
    )


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    tie: Sequence[str],
    cols: Sequence[str],
    max_rows: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Replace each of ``cols`` by its running sum within the key, in time order.

    A large key is summed inside time buckets on top of the total of the earlier
    buckets, as in :func:`with_ordinal`.
    """
    max_rows = MAX_GROUP_ROWS if max_rows is None else max_rows
    order = [F.col(ts), *[F.col(c) for c in tie]]
    upto = (Window.unboundedPreceding, Window.currentRow)
    if fits(df, by, max_rows, at_most):
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(*upto)
        return df.withColumns({c: F.sum(c).over(w) for c in cols})
    width = fitting_width(df, by, ts, max_rows)
    bucketed = df.withColumn("_b", time_bucket(ts, width))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = bucketed.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    carried = carried.withColumns({f"_t_{c}": F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)) for c in cols})
    w = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(*upto)
    return (
        bucketed.withColumns({c: F.sum(c).over(w) for c in cols})
        .join(carried, [*by, "_b"])
        .withColumns({c: F.col(c) + F.col(f"_t_{c}") for c in cols})
        .drop("_b", *[f"_t_{c}" for c in cols])
    )


@dataclass
class Frames:
    """Rows arranged so that ``window`` sees every neighbour a frame needs."""

    df: DataFrame
    window: WindowSpec
    cell: list[str]
    chunked: bool

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop the copied neighbour rows and the helper columns."""
        if not self.chunked:
            return df
        return df.filter("_home").drop("_chunk", "_home", "_pos")


def ordered_frames(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    tie: Sequence[str] = (),
    before: int = 0,
    after: int = 0,
    max_rows: int | None = None,
    at_most: int | None = None,
) -> Frames:
    """Prepare a window that looks at most ``before`` rows back and ``after`` ahead.

    Small keys get the plain window. Large keys are cut by row position into equal
    chunks, and the rows next to a cut are copied into the neighbouring chunk, so
    no task sees more than ``max_rows + before + after`` rows of a key.
    """
    max_rows = MAX_GROUP_ROWS if max_rows is None else max_rows
    if fits(df, by, max_rows, at_most):
        order = [F.col(ts), *[F.col(c) for c in tie]]
        return Frames(df, Window.partitionBy(*by).orderBy(*order), list(by), False)
    size = max(max_rows, before, after, 1)
    numbered = with_ordinal(df, by, ts, tie, "_pos", max_rows)
    spread, window = chunk_by_position(numbered, by, "_pos", size, before, after)
    return Frames(spread, window, [*by, "_chunk"], True)


def chunk_by_position(
    df: DataFrame, by: Sequence[str], pos: str, size: int, before: int, after: int
) -> tuple[DataFrame, WindowSpec]:
    """Cut each key into runs of ``size`` positions, with copies at the cuts."""
    chunk = F.floor((F.col(pos) - 1) / size).cast("long")
    offset = (F.col(pos) - 1) % size
    copies = F.array(
        chunk,
        F.when(offset >= size - before, chunk + 1),
        F.when((offset < after) & (chunk > 0), chunk - 1),
    )
    spread = (
        df.withColumn("_own", chunk)
        .withColumn("_chunk", F.explode(F.filter(copies, lambda c: c.isNotNull())))
        .withColumn("_home", F.col("_chunk") == F.col("_own"))
        .drop("_own")
    )
    return spread, Window.partitionBy(*by, "_chunk").orderBy(pos)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which NULL keys meet each other; keeps the left keys."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(right, same, how).drop(*[f"_right_{k}" for k in keys])


#: ranks of the sketch that brackets a quantile are right within one part in so many
BRACKET = 10_000


def quantiles(df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float], max_rows: int | None = None) -> DataFrame:
    """Exact interpolated quantiles per key: one array column per measure.

    Keys that fit a task use Spark's ``percentile``. Beyond that, a sketch of fixed size (``percentile_approx``) brackets each wanted rank, one row a
    key; then one aggregate counts the values below each bracket and tells those inside it
    apart, a few in ten thousand of a key, which alone are put in order. NULL takes no part,
    NaN ranks above infinity, as in Spark's ``percentile``; a rank between two values is
    interpolated, which gives NaN between opposite infinities.
    """
    by, wide = list(by), 4 / BRACKET
    if fits(df, by, MAX_GROUP_ROWS if max_rows is None else max_rows, None):
        return df.groupBy(*by).agg(*(F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, probs))).alias(c) for c in cols))
    values = [f"_v{i}" for i in range(len(cols))]
    rows = df.select(*by, *(F.col(c).cast("double").alias(v) for c, v in zip(cols, values, strict=True)))
    ends = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-wide, wide)]
    seen = []
    for v in values:
        number = F.when(~F.isnan(v), F.col(v))
        sorted_as = F.when(F.isnan(v), float("inf")).otherwise(F.col(v))
        seen.append(F.struct(
            F.count(v).alias("n"), F.count(number).alias("k"), F.percentile_approx(sorted_as, ends, BRACKET).alias("ends"),
            F.min(sorted_as).alias("least"), F.max(sorted_as).alias("most"),
        ).alias(v))

    def bracket(v: str, i: int) -> Column:
        s, p = F.col(v), float(probs[i])
        few = s["n"] * wide < 4
        # a bracket must be wider than the ranks around it; near the ends it reaches to the end
        low = F.when(F.lit(p <= 2 * wide) | few, s["least"]).otherwise(s["ends"][2 * i])
        high = F.when(F.lit(p >= 1 - 2 * wide) | few, s["most"]).otherwise(s["ends"][2 * i + 1])
        return F.struct(((s["n"] - 1) * p).alias("h"), s["k"].alias("k"), low.alias("lo"), high.alias("hi"))

    pairs = [(j, i) for j in range(len(cols)) for i in range(len(probs))]
    names = {(j, i): f"_b{j}_{i}" for j, i in pairs}
    brackets = rows.groupBy(*by).agg(*seen).select(*by, *(bracket(values[j], i).alias(names[j, i]) for j, i in pairs))
    brackets = lookup(brackets)
    if by:
        placed = null_safe_join(rows, brackets, by)
    else:
        placed = rows.withColumns({n: brackets.select(n).scalar() for n in names.values()})

    def inside(j: int, i: int) -> Column:
        v, w = F.col(values[j]), F.col(names[j, i])
        return F.when(~F.isnan(v) & (v >= w["lo"]) & (v <= w["hi"]), F.struct(F.lit(j).alias("_j"), F.lit(i).alias("_i"), v.alias("_v")))

    held = F.array_compact(F.array(*(inside(j, i) for j, i in pairs)))
    below = [F.count_if(~F.isnan(values[j]) & (F.col(values[j]) < F.col(names[j, i])["lo"])).alias(f"_n{j}_{i}") for j, i in pairs]
    counted = placed.groupBy(*by, held.alias("_held")).agg(F.count(F.lit(1)).alias("_c"), *below)
    ensure_checkpoint_dir(df.sparkSession)
    counted = counted.checkpoint()
    under = counted.groupBy(*by).agg(*(F.sum(f"_n{j}_{i}").alias(f"_n{j}_{i}") for j, i in pairs))
    listed = counted.select(*by, "_c", F.explode("_held").alias("_e")).groupBy(*by, "_e._j", "_e._i", "_e._v").agg(F.sum("_c").alias("_c"))
    order = Window.partitionBy(*by, "_j", "_i").orderBy("_v")
    running = listed.withColumn("_to", F.sum("_c").over(order)).withColumn("_from", F.col("_to") - F.col("_c"))
    wanted = F.explode(F.array(*(F.struct(F.lit(j).alias("_j"), F.lit(i).alias("_i"), F.col(f"_n{j}_{i}").alias("_under"), F.col(names[j, i]).alias("_w")) for j, i in pairs)))
    base = null_safe_join(under, brackets, by) if by else under.withColumns({n: brackets.select(n).scalar() for n in names.values()})
    ranks = base.select(*by, wanted.alias("_e")).select(*by, "_e._j", "_e._i", "_e._under", F.col("_e._w.h").alias("_h"), F.col("_e._w.k").alias("_k"))
    near = null_safe_join(ranks, running, [*by, "_j", "_i"], "left")

    def at(rank: Column) -> Column:
        place = rank - F.col("_under")
        found = F.max(F.when((F.col("_from") <= place) & (place < F.col("_to")), F.col("_v")))
        return F.when(F.first(rank) >= F.first("_k"), F.lit(float("nan"))).otherwise(found)

    low, high = at(F.floor("_h")), at(F.ceil("_h"))
    share = F.first("_h") - F.floor(F.first("_h"))
    value = F.when(F.first("_h") < 0, None).when(share == 0, low).when(low == high, low).otherwise(low * (1 - share) + high * share)
    per_rank = near.groupBy(*by, "_j", "_i").agg(value.alias("_q"))
    columns = []
    for j, c in enumerate(cols):
        mine = F.array_sort(F.collect_list(F.when(F.col("_j") == j, F.struct("_i", "_q"))))
        columns.append(F.when(F.exists(mine, lambda x: x["_q"].isNotNull()), F.transform(mine, lambda x: x["_q"])).alias(c))
    return per_rank.groupBy(*by).agg(*columns)
