"""Boosted trees per inverter, all grown together, as joins, grouped histograms and windows.

Inputs are small whole numbers (``bins``), so rows of one key with equal inputs are one
cell with a count and a sum of the target, and all later work is on cells. A level of a tree
is one histogram (key, node, feature, bin) and one window over it: the best split of every
node of every key at once. There is no loop over inverters; settings and folds of a
search are further columns of the key, so a search has as many jobs as one fit.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.operators import splits
from sunloom.plans import skew
from sunloom.session import ensure_checkpoint_dir

KEY = ("plant_id", "inverter_id")

#: inputs known for any future time; the day number is kept in steps of five
CALENDAR_BINS = {
    "hour": F.hour, "quarter": lambda ts: F.floor(F.minute(ts) / 15), "weekday": F.weekday, "month": F.month, "season": lambda ts: F.floor(F.dayofyear(ts) / 5),
}
#: targets are summed as whole thousandths, so that sums do not depend on their order
SCALE = 1000


def calendar_bins(ts: str = "ts") -> Column:
    return F.array(*(make(F.col(ts)).cast("int") for make in CALENDAR_BINS.values()))


def cells(rows: DataFrame, key: Sequence[str] = KEY, target: str = "ac_power_kw", ts: str = "ts", bins: Column | None = None) -> DataFrame:
    """(key, bins, n, y): how many rows have the same inputs and the sum of their target; rows without target or time are left out."""
    number = F.col(target).cast("double")
    able = rows.filter(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")) & F.col(ts).isNotNull())
    whole = F.round(number * SCALE).cast("long")
    return able.groupBy(*key, (calendar_bins(ts) if bins is None else bins).alias("bins")).agg(F.count(F.lit(1)).alias("n"), F.sum(whole).alias("y"))


def best_splits(state: DataFrame, key: Sequence[str], least_rows: Column, damping: Column) -> DataFrame:
    """(key, node, feature, bin): the split ``input <= bin`` that lowers the squared error of a node most.

    ``state`` has key, node, bins, n and g (sum of residuals). Gains are compared to nine
    digits, then the first feature and the least bin win. Nodes without a split that
    leaves ``least_rows`` on both sides and gains something are left out.
    """
    node = [*key, "node"]
    entries = state.select(*node, "n", "g", least_rows.alias("_least"), damping.alias("_damping"), F.posexplode("bins").alias("feature", "bin"))
    histogram = entries.groupBy(*node, "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.first("_least").alias("_least"), F.first("_damping").alias("_damping"))
    upto = Window.partitionBy(*node, "feature").orderBy("bin")
    whole = Window.partitionBy(*node, "feature")
    sides = histogram.select(
        *node, "feature", "bin", "_least", "_damping",
        F.sum("n").over(upto).alias("nl"), F.sum("g").over(upto).alias("gl"), F.sum("n").over(whole).alias("na"), F.sum("g").over(whole).alias("ga"),
    )
    # squares of whole sums pass the range of a long
    score = lambda g, n: g.cast("double") * g / (n + F.col("_damping"))
    gain = score(F.col("gl"), F.col("nl")) + score(F.col("ga") - F.col("gl"), F.col("na") - F.col("nl")) - score(F.col("ga"), F.col("na"))
    able = sides.filter((F.col("nl") >= F.col("_least")) & (F.col("na") - F.col("nl") >= F.col("_least"))).withColumn("gain", gain).filter("gain > 1e-9")
    digits = F.floor(F.log10("gain")).cast("int") - 8
    order = F.struct(digits, F.round(F.col("gain") * F.pow(F.lit(10.0), -digits)), -F.col("feature"), -F.col("bin"))
    return able.groupBy(*node).agg(F.max_by(F.struct("feature", "bin"), order).alias("s")).select(*node, "s.*")


def as_column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def grow(
    of: DataFrame, key: Sequence[str] = KEY, trees: int = 20, depth: int = 3, rate: Column | float = 0.3, least_rows: Column | int = 5,
    damping: Column | float = 1.0, deepest: Column | None = None, begun: DataFrame | None = None, first: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Boosted trees of every key: (the forest, the cells with their prediction ``f``).

    The forest has a row per key and tree: splits, node -> (feature, bin), and leaves,
    node -> value, in units of the target. Node 1 is the root, children of i are 2 i and
    2 i + 1; what is not split goes left to the last level. ``rate``, ``least_rows``,
    ``damping`` and ``deepest`` (levels) may be columns of the cells, constant per key.
    With ``begun`` (cells with ``f``) trees are added from number ``first`` on. A tree is
    ``depth`` + 1 jobs over the cells, each of which is checkpointed.
    """
    key = list(key)
    ensure_checkpoint_dir(of.sparkSession)
    state = of.withColumn("f", F.lit(0.0)) if begun is None else begun
    rate, least_rows, damping = as_column(rate), as_column(least_rows), as_column(damping)
    forest = None
    leaf = Window.partitionBy(*key, "node")
    for tree in range(first, first + trees):
        state = state.withColumn("node", F.lit(1)).withColumn("g", F.col("y") - F.col("n") * F.col("f") * SCALE)
        found = []
        for level in range(depth):
            open_ = state if deepest is None else state.filter(deepest > level)
            split = best_splits(open_, key, least_rows, damping)
            joined = skew.null_safe_join(state, split, [*key, "node"], "left").checkpoint()
            found.append(joined.filter("feature is not null").select(*key, "node", "feature", "bin"))
            right = F.coalesce(F.element_at("bins", F.col("feature") + 1) > F.col("bin"), F.lit(False))
            state = joined.withColumn("node", 2 * F.col("node") + right.cast("int")).drop("feature", "bin")
        value = rate * F.sum("g").over(leaf) / (F.sum("n").over(leaf) + damping) / SCALE
        state = state.withColumn("value", value).withColumn("f", F.col("f") + F.col("value")).checkpoint()
        parts = state.groupBy(*key).agg(F.map_from_entries(F.collect_set(F.struct("node", "value"))).alias("leaves"))
        branches = functools.reduce(DataFrame.unionByName, found).groupBy(*key).agg(F.map_from_entries(F.collect_set(F.struct("node", F.struct("feature", "bin")))).alias("splits"))
        grown = skew.null_safe_join(parts, branches, key, "left").select(*key, F.lit(tree).alias("tree"), F.lit(depth).alias("depth"), "splits", "leaves")
        forest = grown if forest is None else forest.unionByName(grown)
        state = state.drop("value", "node", "g")
    return forest, state


def predict(rows: DataFrame, forest: DataFrame, key: Sequence[str] = KEY, ts: str = "ts", name: str = "predicted", bins: Column | None = None, least: float | None = 0.0) -> DataFrame:
    """Rows with the sum of their key's trees, at least ``least``; null where a key has no forest."""
    key = list(key)
    packed = forest.groupBy(*key).agg(F.collect_list(F.struct("depth", "splits", "leaves")).alias("_trees"))

    def leaf(tree: Column, inputs: Column) -> Column:
        def down(node: Column) -> Column:
            split = F.try_element_at(tree["splits"], node)
            return 2 * node + F.coalesce(F.element_at(inputs, split["feature"] + 1) > split["bin"], F.lit(False)).cast("int")

        node = F.aggregate(F.sequence(F.lit(1), tree["depth"]), F.lit(1), lambda at, _: down(at))
        return F.coalesce(F.try_element_at(tree["leaves"], node), F.lit(0.0))

    joined = skew.null_safe_join(rows.withColumn("_bins", calendar_bins(ts) if bins is None else bins), skew.lookup(packed), key, "left")
    total = F.aggregate("_trees", F.lit(0.0), lambda s, t: s + leaf(t, F.col("_bins")))
    value = total if least is None else F.when(total.isNotNull(), F.greatest(total, F.lit(least)))
    return joined.withColumn(name, value).select(*rows.columns, name)


def search(rows: DataFrame, grid: dict[str, Sequence], folds: int = 3, key: Sequence[str] = KEY, trees: int = 8, rungs: int = 2, target: str = "ac_power_kw") -> DataFrame:
    """Settings with the mean absolute error over all folds: number, trees, mae, stopped; best first.

    ``grid`` may name depth, rate, least_rows and damping. Setting and fold are columns of
    the key, so all are grown in the same jobs. After each of ``rungs`` portions of
    ``trees`` the better half of the settings goes on (successive halving); the others keep
    the error they were stopped with. Each fold trains on the rows before its block.
    """
    base = {"depth": 3, "rate": 0.3, "least_rows": 5, "damping": 1.0}
    unknown = set(grid) - set(base)
    if unknown:
        raise ValueError(f"not a setting: {sorted(unknown)}")
    key = list(key)
    spark = rows.sparkSession
    names = sorted(grid)
    settings = [(i, *(float((base | dict(zip(names, values, strict=True)))[c]) for c in base)) for i, values in enumerate(product(*(grid[n] for n in names)))]
    schema = "setting int, " + ", ".join(f"s_{c} double" for c in base)
    labelled = splits.time_series_folds(rows, key, folds)
    # a row of block b is a training row of the folds after b and a test row of fold b
    uses = F.filter(F.transform(F.sequence(F.lit(1), F.lit(folds)), lambda f: F.struct(f.alias("fold"), (F.col("test_fold") == f).alias("test"))), lambda u: u["fold"] >= F.col("test_fold"))
    used = labelled.withColumn("_u", F.explode(uses)).select(*key, "ts", target, "_u.fold", "_u.test")
    counted = cells(used, [*key, "fold", "test"], target).checkpoint()
    train = counted.filter("not test").drop("test")
    if counted.filter("test").isEmpty():
        return spark.createDataFrame([], "number int, params string, trees int, mae double, stopped boolean")
    state, kept, done, forest = None, [s[0] for s in settings], [], None
    deep = int(max(s[1] for s in settings))
    for rung in range(rungs):
        alive = spark.createDataFrame([s for s in settings if s[0] in kept], schema)
        if state is None:
            state = spread(train, alive).withColumn("f", F.lit(0.0))
        else:
            state = state.filter(F.col("setting").isin(kept))
            forest = forest.filter(F.col("setting").isin(kept))
        grown, state = grow(
            state, [*key, "fold", "setting"], trees, deep, F.col("s_rate"), F.col("s_least_rows"), F.col("s_damping"), F.col("s_depth"), state, rung * trees,
        )
        forest = grown if forest is None else forest.unionByName(grown)
        asked = used.filter("test").filter(F.col(target).isNotNull()).select(*key, "ts", target, "fold")
        scored = predict(spread(asked, alive.select("setting")), forest, [*key, "fold", "setting"])
        errors = {r["setting"]: r["mae"] for r in scored.groupBy("setting").agg(F.avg(F.abs(F.col(target) - F.coalesce("predicted", F.lit(0.0)))).alias("mae")).collect()}
        ranked = sorted(kept, key=lambda i: (errors.get(i, float("inf")), i))
        going = ranked[: max(1, -(-len(ranked) // 2))] if rung < rungs - 1 else []
        done += [(i, str(dict(zip([f"{c}" for c in base], settings[i][1:], strict=True))), (rung + 1) * trees, errors.get(i), bool(going)) for i in ranked if i not in going]
        kept = going
    return spark.createDataFrame(done, "number int, params string, trees int, mae double, stopped boolean").orderBy("stopped", "mae", "number")


def spread(rows: DataFrame, settings: DataFrame) -> DataFrame:
    """Each row once for every setting, which are few and stand in the plan as one array."""
    packed = settings.agg(F.collect_list(F.struct(*settings.columns)).alias("s")).scalar()
    return rows.withColumn("_s", F.explode(packed)).select(*rows.columns, "_s.*")
