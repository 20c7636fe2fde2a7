"""Forests per inverter: against a plain tree, against one pooled forest, and the search."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sunloom import forests

KEY = ["plant_id", "inverter_id"]


@pytest.fixture(scope="module")
def rows(spark):
    """Inverters of one id in two plants, with profiles that no common model can hold."""
    rng = random.Random(3)
    data = []
    for p, (plant, inverter) in enumerate([("P0", "A"), ("P1", "A"), ("P0", "B")]):
        for i in range(360):
            hour = i % 24
            power = 10 * (p + 1) if (hour + 8 * p) % 24 < 12 else 2.0 * p
            data.append((plant, inverter, 1_700_000_000 - 1_700_000_000 % 86_400 + i * 3_600, round(power + rng.random(), 3)))
    data += [("P0", "A", None, 5.0), ("P0", "A", 1_700_000_000, None), ("P1", "A", 1_700_000_000, float("nan"))]
    return spark.createDataFrame(data, "plant_id string, inverter_id string, t long, ac_power_kw double").selectExpr("plant_id", "inverter_id", "timestamp_seconds(t) as ts", "ac_power_kw").checkpoint()


def plain_split(cells, least, damping):
    """Best root split of [(bins, n, y)] by trying all."""
    score = lambda part: sum(y for _, _, y in part) ** 2 / (sum(n for _, n, _ in part) + damping)
    best = None
    for feature in range(len(cells[0][0])):
        for edge in sorted({b[feature] for b, _, _ in cells}):
            left, right = [c for c in cells if c[0][feature] <= edge], [c for c in cells if c[0][feature] > edge]
            if min(sum(n for _, n, _ in side) for side in (left, right)) < least:
                continue
            gain = score(left) + score(right) - score(cells)
            if gain > 1e-9:
                key = (float(f"{gain:.8e}"), -feature, -edge)
                best = max(best, key) if best else key
    return (-best[1], -best[2]) if best else None


def test_root_splits(rows):
    cells = forests.cells(rows)
    state = cells.withColumn("node", F.lit(1)).withColumn("g", F.col("y"))
    got = {(r["plant_id"], r["inverter_id"]): (r["feature"], r["bin"]) for r in forests.best_splits(state, KEY, F.lit(5), F.lit(1.0)).collect()}
    by = {}
    for r in cells.collect():
        by.setdefault((r["plant_id"], r["inverter_id"]), []).append((r["bins"], r["n"], r["y"]))
    assert len(by) == 3 and got == {k: plain_split(v, 5, 1.0) for k, v in by.items()}


def test_root_splits_of_large_sums(spark):
    """Sums of targets whose square is beyond a long, as whole numbers."""
    large = [([h, 0], 400_000, (h % 5) * 20_000_000_000) for h in range(24)]
    state = spark.createDataFrame([("P", "A0", b, n, y) for b, n, y in large], "plant_id string, inverter_id string, bins array<int>, n long, g long").withColumn("node", F.lit(1))
    got = forests.best_splits(state, KEY, F.lit(5), F.lit(1.0)).first()
    assert (got["feature"], got["bin"]) == plain_split(large, 5, 1.0)


def test_forests_beat_a_pooled_one_on_held_out_rows(rows):
    able = rows.filter("ts is not null and ac_power_kw is not null and not isnan(ac_power_kw)")
    train, test = (able.filter(f"(unix_seconds(ts) div 86400) % 4 {op} 0") for op in ("<>", "="))
    errors = []
    train, test = (df.withColumn("every", F.lit(1)) for df in (train, test))
    for key in (KEY, ["every"]):
        forest, state = forests.grow(forests.cells(train, key), key, trees=3, depth=3, rate=0.8)
        assert forest.count() == 3 * (3 if key == KEY else 1)
        # what the trees give is what the cells were given while they grew
        both = forests.predict(train, forest, key, least=None).withColumn("bins", forests.calendar_bins())
        fitted = state.select(*key, "bins", "f")
        assert both.join(fitted, [*key, "bins"]).agg(F.max(F.abs(F.col("predicted") - F.col("f")))).first()[0] < 1e-9
        scored = forests.predict(test, forest, key)
        errors.append(scored.agg(F.avg(F.abs(F.col("predicted") - F.col("ac_power_kw")))).first()[0])
    assert errors[0] < 1.0 < errors[1] / 2


def test_a_key_without_a_forest_and_no_rows(rows):
    forest, _ = forests.grow(forests.cells(rows.filter("inverter_id = 'B'")), trees=1, depth=1)
    got = forests.predict(rows.filter("ts is not null"), forest)
    assert got.filter("inverter_id = 'A' and predicted is not null").isEmpty() and not got.filter("predicted > 0").isEmpty()
    assert got.columns == [*rows.columns, "predicted"]
    empty, _ = forests.grow(forests.cells(rows.limit(0)), trees=1, depth=1)
    assert empty.count() == 0 and forests.predict(rows.limit(0), empty).count() == 0


def test_search_halves_the_settings(rows, spark):
    able = rows.filter("ts is not null and ac_power_kw is not null and not isnan(ac_power_kw)")
    jobs = []
    for grid in ({"depth": [1, 3]}, {"depth": [1, 2, 3], "rate": [0.1, 0.6]}):
        group = f"search-{len(jobs)}"
        spark.sparkContext.setJobGroup(group, group)
        got = forests.search(able, grid, folds=2, trees=1).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        spark.sparkContext.setJobGroup("", "")
        n = math.prod(map(len, grid.values()))
        assert len(got) == n and sum(not r["stopped"] for r in got) == -(-n // 2) and got[0]["mae"] == min(r["mae"] for r in got if not r["stopped"])
        assert {r["trees"] for r in got} == {1, 2}
    assert jobs[1] <= jobs[0] + 2  # the grid is three times as large
    with pytest.raises(ValueError, match="not a setting"):
        forests.search(able, {"x": [1]})
