"""Cutting a large key into pieces gives what one window gives."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sunloom.operators import failures as fl
from sunloom.operators import splits, timeseries
from sunloom.plans import skew

KEY = ["plant_id"]


@pytest.fixture(scope="module")
def series(spark):
    """Three plants, one with most of the rows, with equal times and gaps."""
    rng = random.Random(7)
    data = []
    for plant, n in (("P0", 700), ("P1", 60), ("P2", 1)):
        t = 1_704_067_200_000_000
        for i in range(n):
            t += rng.choice([0, 1, 999, 60_000_000, 61_500_000, 86_400_000_000])
            v = None if rng.random() < 0.2 else round(rng.uniform(-5, 500), 2)
            data.append((plant, len(data), t, v, rng.random() < 0.3))
    pdf = pd.DataFrame(data, columns=["plant_id", "id", "us", "v", "bad"])
    df = spark.createDataFrame(data, "plant_id string, id long, us long, v double, bad boolean").selectExpr(
        "plant_id", "id", "timestamp_micros(us) as ts", "v", "case when bad then 1 else 0 end as active_failures"
    )
    return df.checkpoint(), pdf


SIZES = [10_000, 9]


@pytest.mark.parametrize("size", SIZES)
def test_ordinal(series, size):
    df, pdf = series
    got = skew.with_ordinal(df, KEY, "ts", ["id"], max_rows=size).toPandas().sort_values("id")
    want = pdf.sort_values(["us", "id"]).groupby("plant_id").cumcount() + 1
    assert (got.set_index("id")["ordinal"] == want.sort_index()).all() and len(got) == len(pdf)


@pytest.mark.parametrize("size", SIZES)
def test_running_totals(series, size):
    df, pdf = series
    got = skew.running_totals(df.fillna(0, ["v"]), KEY, "ts", ["id"], ["v"], size).toPandas().set_index("id")["v"].sort_index()
    want = pdf.fillna({"v": 0}).sort_values(["us", "id"]).groupby("plant_id")["v"].cumsum().sort_index()
    np.testing.assert_allclose(got, want, atol=1e-8)


@pytest.mark.parametrize("size", SIZES)
def test_lags_and_gaps(series, size):
    df, pdf = series
    s = pdf.sort_values(["us", "id"])
    got = timeseries.lag_features(df, KEY, ["v"], [1, 5, 30], tie=["id"], max_rows=size).toPandas().set_index("id").sort_index()
    assert len(got) == len(pdf)
    for n in (1, 5, 30):
        want = s.groupby("plant_id")["v"].shift(n).sort_index()
        np.testing.assert_array_equal(got[f"v_lag_{n}"].to_numpy(float), want.to_numpy(float))
    gaps = timeseries.time_gaps(df, KEY, tie=["id"], max_rows=size).toPandas().set_index("id").sort_index()["gap_seconds"]
    np.testing.assert_allclose(gaps, (s.groupby("plant_id")["us"].diff() / 1e6).sort_index())


@pytest.mark.parametrize("direct", [64, 3])
@pytest.mark.parametrize("size", SIZES)
def test_rolling(series, size, direct):
    df, pdf = series
    got = timeseries.rolling_features(df, KEY, [5, 40], ["v"], ["v"], tie=["id"], max_rows=size, direct=direct).toPandas().set_index("id").sort_index()
    assert list(got.columns) == ["plant_id", "ts", "v", "active_failures"] + [f"v_rolling_{k}_{n}" for n in (5, 40) for k in ("mean", "std")]
    s = pdf.sort_values(["us", "id"]).groupby("plant_id")["v"]
    for n in (5, 40):
        roll = s.rolling(n, min_periods=1)
        np.testing.assert_allclose(got[f"v_rolling_mean_{n}"].astype(float), roll.mean().droplevel(0).sort_index(), atol=1e-8)
        np.testing.assert_allclose(got[f"v_rolling_std_{n}"].astype(float), roll.std().droplevel(0).sort_index(), atol=1e-6)


@pytest.mark.parametrize("size", SIZES)
def test_fill(series, size):
    df, pdf = series
    got = timeseries.fill_gaps(df, KEY, ["v"], tie=["id"], max_rows=size).toPandas().set_index("id").sort_index()["v"]
    s = pdf.sort_values(["us", "id"])
    want = s.groupby("plant_id")["v"].transform(lambda x: x.ffill().bfill()).sort_index()
    np.testing.assert_array_equal(got.to_numpy(float), want.to_numpy(float))


@pytest.mark.parametrize("size", SIZES)
def test_smoothing(series, size):
    df, pdf = series
    got = timeseries.ewma(df, KEY, ["v"], 0.85, tie=["id"], max_rows=size).toPandas().set_index("id").sort_index()["v_smooth"]
    s = pdf.dropna().sort_values(["us", "id"])
    want = s.groupby("plant_id")["v"].transform(lambda x: x.ewm(alpha=0.15, adjust=False).mean()).sort_index()
    np.testing.assert_allclose(got, want, rtol=1e-10, atol=1e-9)


def test_smoothing_keeps_what_is_far_back(spark):
    values = [1.0] * 3_000
    values[759], values[2_400] = 1e20, INF
    df = spark.createDataFrame([("P0", i, v) for i, v in enumerate(values)], "plant_id string, id long, v double").withColumn("ts", F.timestamp_seconds("id"))
    got = timeseries.ewma(df, KEY, ["v"], 0.85).toPandas().set_index("id").sort_index()["v_smooth"]
    want, s = [], None
    for v in values:
        s = v if s is None else 0.85 * s + 0.15 * v
        want.append(s)
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_decomposition_of_an_odd_period(spark):
    df = spark.createDataFrame([("P0", i, float(i)) for i in range(9)], "plant_id string, id long, v double").withColumn("ts", F.timestamp_seconds("id"))
    got = timeseries.seasonal_decompose(df, KEY, "v", period=3).orderBy("ts").toPandas()["trend"]
    np.testing.assert_allclose(got[1:8], range(1, 8))


@pytest.mark.parametrize("size", SIZES)
def test_splits(series, size):
    df, pdf = series
    s = pdf.sort_values(["us", "id"]).copy()
    s["i"] = s.groupby("plant_id").cumcount()
    s["n"] = s.groupby("plant_id")["id"].transform("size")
    got = splits.chronological_split(df, KEY, tie=["id"], max_rows=size).toPandas().set_index("id")["split"].sort_index()
    want = np.where(s["i"] < np.floor(0.8 * s["n"]), "train", "test")
    assert (got == pd.Series(want, s["id"]).sort_index()).all()

    folds = splits.time_series_folds(df, KEY, 5, tie=["id"], max_rows=size).toPandas().set_index("id")["test_fold"].sort_index()
    block = s["n"] // 6
    first = s["n"] - 5 * block
    fold = np.where((block > 0) & (s["i"] >= first), (s["i"] - first) // block.clip(lower=1) + 1, 0)
    assert (folds == pd.Series(fold, s["id"]).sort_index()).all()
    sizes = folds[folds > 0].to_frame().join(pdf.set_index("id")).groupby(["plant_id", "test_fold"]).size()
    assert sizes["P0"].nunique() == 1 and len(sizes["P0"]) == 5


@pytest.mark.parametrize("limit", [None, 0])
def test_quantiles(series, limit):
    df, pdf = series
    probs = [0.0, 0.25, 0.5, 0.9, 0.995, 1.0]
    skewed = df.selectExpr("plant_id", "v", "case when id % 3 = 0 then 7D else exp(coalesce(v, 0) / 20) end as w")
    rows = {r["plant_id"]: r for r in skew.quantiles(skewed, KEY, ["v", "w"], probs, limit).collect()}
    for plant, group in skewed.toPandas().groupby("plant_id"):
        for c in ("v", "w"):
            values = group[c].dropna()
            if len(values):
                np.testing.assert_allclose(rows[plant][c], values.quantile(probs).to_numpy(), rtol=1e-12)


INF, NAN = float("inf"), float("nan")
ODD = [[1, 2, 3, INF], [1, 2, 3, NAN], [-1.7e308, 1, 2, 1.7e308], [-INF, -INF, 0, 5e-324, INF, NAN, NAN], [5.0], [NAN], [INF, INF], [0.0] * 50 + [1.0]]


def test_quantiles_of_odd_values_equal_the_builtin(spark):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    data = [(None if k == 4 else k, float(v)) for k, values in enumerate(ODD) for v in values] + [(0, None), (99, None)]
    df = spark.createDataFrame(data, "k int, v double")
    want = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("v", probs).alias("q")).collect()}
    got = {r["k"]: r["v"] for r in skew.quantiles(df, ["k"], ["v"], probs, 0).collect()}
    for k, q in want.items():
        if k != 99:
            np.testing.assert_allclose(got[k], q, rtol=1e-12, err_msg=str(k))


def test_quantiles_of_a_group_larger_than_the_sketch(spark):
    df = spark.range(60_000).selectExpr("id % 2 as k", "cast(xxhash64(id) % 1000000 as double) as v", "cast(least(id, 59000) as double) as w")
    probs = [0.0, 0.0001, 0.003, 0.25, 0.5, 0.9, 0.9995, 1.0]
    want = {r["k"]: r for r in df.groupBy("k").agg(F.percentile("v", probs).alias("v"), F.percentile("w", probs).alias("w")).collect()}
    for r in skew.quantiles(df, ["k"], ["v", "w"], probs, 0).collect():
        for c in ("v", "w"):
            np.testing.assert_allclose(r[c], want[r["k"]][c], rtol=1e-12)


@pytest.mark.parametrize("size", SIZES)
def test_failure_episodes(series, size):
    df, _ = series
    unique = df.dropDuplicates(["plant_id", "ts"])
    got = fl.failure_episodes(unique, KEY, max_rows=size).toPandas().sort_values(["plant_id", "start_ts"]).to_numpy().tolist()
    want = []
    for plant, g in unique.toPandas().sort_values("ts").groupby("plant_id"):
        open_at = last = None
        for ts, bad in zip(g["ts"], g["active_failures"]):
            if bad and open_at is None:
                open_at = ts
            if not bad and open_at is not None:
                want.append([plant, open_at, ts])
                open_at = None
            last = ts
        if open_at is not None:
            want.append([plant, open_at, last])
    assert got == want


@pytest.mark.parametrize("size", SIZES)
def test_system_impact(spark, size):
    rng = random.Random(3)
    fails = [("P%d" % rng.randrange(2), rng.randrange(400), rng.choice("ABC"), rng.choice(["LOW", "MEDIUM", "HIGH", "CRITICAL", "odd"])) for _ in range(150)]
    fails = [(p, s, s + rng.randrange(0, 60), c, v) for p, s, c, v in fails]
    points = [("P%d" % (i % 2), i) for i in range(0, 460, 3)]
    f = spark.createDataFrame(fails, "plant_id string, s long, e long, component_id string, severity string").selectExpr(
        "plant_id", "timestamp_seconds(s) as start_ts", "timestamp_seconds(e) as end_ts", "component_id", "severity"
    )
    p = spark.createDataFrame(points, "plant_id string, id long").selectExpr("plant_id", "id", "timestamp_seconds(id) as ts")
    got = {r["id"]: r for r in fl.system_impact(p, f, max_rows=size).collect()}
    assert len(got) == len(points)
    for plant, t in points:
        live = [x for x in fails if x[0] == plant and x[1] <= t < x[2]]
        row = got[t]
        assert row["active_failures"] == len(live)
        assert row["components_affected"] == len({x[3] for x in live})
        assert row["critical_active"] == sum(x[4] == "CRITICAL" for x in live)
        assert abs(row["stress"] - min(1.0, sum(fl.STRESS_WEIGHTS.get(x[4], 0.05) for x in live))) < 1e-9
        assert abs(row["performance_reduction"] - min(0.95, sum(fl.REDUCTION_WEIGHTS.get(x[4], 0.05) for x in live))) < 1e-9
    pairs = timeseries.interval_join(p, f).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in pairs} == {t: r["active_failures"] for t, r in got.items() if r["active_failures"]}


@pytest.mark.parametrize("size", SIZES)
def test_performance_multiplier_pairs_no_failures(spark, size):
    """Dense failures, some of a component without a name, against a plain product; a point meets a component's stretches, not its failures."""
    rng = random.Random(8)
    fails = [("P%d" % rng.randrange(2), rng.randrange(400), rng.choice(["A", "B", None]), rng.choice(["LOW", "MEDIUM", "HIGH", "CRITICAL", None])) for _ in range(150)]
    fails = [(p, s, s + rng.randrange(0, 9 if v == "CRITICAL" else 60), c, v) for p, s, c, v in fails] * 20
    fails += [("P0", 600, 700, "A", "LOW"), ("P0", 620, 640, "A", "HIGH"), ("P0", 640, 650, "A", "HIGH")]
    f = spark.createDataFrame(fails, "plant_id string, s long, e long, component_id string, severity string").selectExpr(
        "plant_id", "timestamp_seconds(s) as start_ts", "timestamp_seconds(e) as end_ts", "component_id", "severity"
    )
    p = spark.range(0, 720, 3).selectExpr("concat('P', id % 2) as plant_id", "id", "timestamp_seconds(id) as ts")
    got = fl.performance_multiplier(p, f, ["id"], max_rows=size)
    want = {}
    for t in range(0, 720, 3):
        for plant, start, end, part, severity in fails:
            if plant == f"P{t % 2}" and start <= t < end:
                want[t, part] = want.get((t, part), 1.0) * fl.PERFORMANCE_FACTORS.get(severity, 0.9)
    rows = {(r["id"], r["component_id"]): r["multiplier"] for r in got.collect()}
    assert rows.keys() == want.keys() and len(rows) == got.count()
    assert all(abs(rows[k] - want[k]) < 1e-9 for k in want) and 0 < rows[630, "A"] < 0.9
    asked = []
    met = timeseries.interval_join
    fl.interval_join = lambda l, r, *a: asked.append(met(l, r, *a)) or asked[-1]
    try:
        fl.performance_multiplier(p, f, ["id"], max_rows=size)
    finally:
        fl.interval_join = met
    assert asked[0].count() == len(want)


@pytest.mark.parametrize("size", SIZES)
def test_asof(spark, size):
    """Nearest match with ties, equal times on the right, and a one-second cell."""
    rng = random.Random(11)
    left = [(rng.choice("PQ"), i, rng.randrange(3000)) for i in range(300)]
    right = [(rng.choice("PQ"), i, rng.randrange(3000)) for i in range(200)]
    l = spark.createDataFrame(left, "plant_id string, id long, t long").selectExpr("plant_id", "id", "timestamp_seconds(t) as ts")
    r = spark.createDataFrame(right, "plant_id string, rid long, t long").selectExpr("plant_id", "rid", "timestamp_seconds(t) as ts")
    got = timeseries.asof_nearest(l, r, 20, right_order=["rid"], max_rows=size).toPandas().set_index("id")["rid"].sort_index()
    lp = pd.DataFrame(left, columns=["plant_id", "id", "t"]).sort_values(["t", "id"])
    rp = pd.DataFrame(right, columns=["plant_id", "rid", "t"]).sort_values(["t", "rid"])
    want = pd.merge_asof(lp, rp, on="t", by="plant_id", direction="nearest", tolerance=20).set_index("id")["rid"].sort_index()
    pd.testing.assert_series_equal(got.astype(float), want.astype(float), check_names=False)
    across = timeseries.asof_nearest(l.drop("plant_id"), r.drop("plant_id"), 20, by=(), right_order=["rid"], max_rows=size).toPandas().set_index("id")["rid"].sort_index()
    free = pd.merge_asof(lp[["t", "id"]], rp[["t", "rid"]], on="t", direction="nearest", tolerance=20).set_index("id")["rid"].sort_index()
    pd.testing.assert_series_equal(across.astype(float), free.astype(float), check_names=False)


def test_a_long_interval_adds_two_rows(spark):
    short = spark.range(2_000).selectExpr("'P' as plant_id", "id as failure_id", "timestamp_seconds(id * 90) as start_ts", "timestamp_seconds(id * 90 + 60) as end_ts")
    year = spark.createDataFrame([("P", -1, 100, 100 + 365 * 86_400)], "plant_id string, failure_id long, a long, b long").selectExpr("plant_id", "failure_id", "timestamp_seconds(a) as start_ts", "timestamp_seconds(b) as end_ts")
    both = short.unionByName(year)
    level = timeseries.dyadic_level("start_ts", "end_ts")
    assert both.select(level.alias("l")).distinct().count() == 2
    points = spark.range(500).selectExpr("'P' as plant_id", "id", "timestamp_seconds(id * 37) as ts")
    joined = timeseries.interval_join(points, both)
    got = {(r["id"], r["failure_id"]) for r in joined.select("id", "failure_id").collect()}
    want = {(p, f) for p in range(500) for f in [p * 37 // 90] if p * 37 < f * 90 + 60} | {(p, -1) for p in range(500) if p * 37 >= 100}
    assert got == want
    listed = both.withColumn("w", F.pow(F.lit(2.0), level)).selectExpr("floor((unix_micros(end_ts) - 1) / w) - floor(unix_micros(start_ts) / w) + 1 as cells")
    assert listed.agg(F.max("cells")).first()[0] <= 2


def test_wide_rows_are_cut_sooner(spark, monkeypatch):
    """Keys whose bytes are too many for a task are worked on in pieces, with the values of the whole key."""
    rows = spark.range(400).selectExpr("'P' as plant_id", "timestamp_seconds(id * 60) as ts", "if(id % 7 = 3, id, null) as v", *[f"id * {i} as w{i}" for i in range(20)])
    assert skew.group_rows(rows) < skew.group_rows(rows.select("plant_id", "ts")) and skew.group_rows(rows, 9) == 9
    whole = {r["ts"]: r["v"] for r in timeseries.fill_gaps(rows, ["plant_id"], ["v"]).collect()}
    monkeypatch.setattr(skew, "MAX_GROUP_BYTES", 50 * skew.row_bytes(rows.schema))
    cut = timeseries.fill_gaps(rows, ["plant_id"], ["v"])
    assert "_chunk" in cut._jdf.queryExecution().analyzed().toString()
    assert {r["ts"]: r["v"] for r in cut.collect()} == whole
    part = splits.chronological_split(rows, ["plant_id"])
    assert "_start" in part._jdf.queryExecution().analyzed().toString() and part.filter("split = 'train'").count() == 320


@pytest.mark.parametrize("size", [None, 1, 40, 4_000])
def test_interval_join_deals_pairs(spark, size):
    """Dense and hot cells give the same pairs however few of them a task may try."""
    rng = random.Random(5)
    fails = [(rng.choice("PQ"), i, rng.randrange(900), rng.choice([0, 1, 20, 300])) for i in range(150)] + [("P", 200 + i, 500, 10) for i in range(40)]
    pts = [(rng.choice("PQ"), i, rng.randrange(1_200)) for i in range(300)] + [("P", 400 + i, 505) for i in range(40)] + [(None, 900, 5), ("P", 901, None)]
    f = spark.createDataFrame(fails, "plant_id string, failure_id long, s long, n long").selectExpr("plant_id", "failure_id", "timestamp_seconds(s) as start_ts", "timestamp_seconds(s + n) as end_ts")
    p = spark.createDataFrame(pts, "plant_id string, id long, t long").selectExpr("plant_id", "id", "timestamp_seconds(t) as ts")
    joined = timeseries.interval_join(p, f, max_pairs=size)
    assert set(joined.columns) == {*p.columns, *f.columns}
    got = sorted((r["id"], r["failure_id"]) for r in joined.collect())
    assert got == sorted((i, k) for q, i, t in pts for w, k, s, n in fails if q == w and t is not None and s <= t < s + n)
    assert timeseries.interval_join(p, f.limit(0), max_pairs=size).count() == 0
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert ("_p" in plan.replace("_pairs", "")) == (size in (1, 40)) and ("RepartitionByExpression" in plan) == (size is not None)


def test_failures_active_at_converts_no_time_of_a_pair(spark):
    """A conversion above the join would be done once for every row of the result."""
    from sunloom.workload import QUERIES

    plan = QUERIES["failures_active_at"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "as timestamp_ntz" not in plan[: plan.index("Join Inner")]
