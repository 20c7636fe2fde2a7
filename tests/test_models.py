"""Model steps: rows, ranges and repeatable results on the small tables."""

import pytest
from conftest import SMALL
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from sunloom import models
from sunloom.functions.quality import anomaly_label
from sunloom.operators import metrics, splits, timeseries
from sunloom.workload.relations import INVERTER_KEY, Relations


@pytest.fixture(scope="module")
def rel(spark):
    return Relations(spark, SMALL)


def test_forecaster(rel):
    rows = rel.inverter_s.select("id", *INVERTER_KEY, "ts", "ac_power_kw")
    parts = splits.chronological_split(rows, INVERTER_KEY)
    model = models.fit_forecaster(parts.filter("split = 'train'"), max_iter=3, max_depth=3)
    scores = models.evaluate_forecaster(model, parts.filter("split = 'test'"))
    assert scores.count() == rows.select(*INVERTER_KEY).distinct().count()
    assert scores.filter("mae is null or mae < 0").isEmpty()
    last = rows.groupBy(*INVERTER_KEY).agg(F.max("ts").alias("last_ts"))
    grid = timeseries.forecast_grid(last)
    out = models.forecast_rows(model, grid, "run-1")
    assert out.count() == 192 * last.count() and out.filter("predicted_ac_power_kw < 0").isEmpty()
    again = models.fit_forecaster(parts.filter("split = 'train'"), max_iter=3, max_depth=3)
    assert models.evaluate_forecaster(again, parts.filter("split = 'test'")).orderBy(*INVERTER_KEY).collect() == scores.orderBy(*INVERTER_KEY).collect()


def test_forecaster_fits_distinct_inputs(rel, spark, monkeypatch):
    """The model of rows with equal inputs as one instance is that of the single rows, and copies of the rows add no instance."""
    rows = rel.inverter_s.select(*INVERTER_KEY, "ts", "ac_power_kw").dropna()
    seen = []
    fit = GBTRegressor._fit
    monkeypatch.setattr(GBTRegressor, "_fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    model = models.fit_forecaster(rows, max_iter=4, max_depth=3)
    often = models.fit_forecaster(rows.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("_"), max_iter=4, max_depth=3)
    assert seen[0] == seen[1] == rows.select("inverter_id", F.date_trunc("hour", "ts")).distinct().count() < rows.count()
    plain = GBTRegressor(labelCol="ac_power_kw", predictionCol="predicted", maxIter=4, maxDepth=3, stepSize=0.1, seed=42)
    single = plain.fit(PipelineModel(model.stages[:-1]).transform(models.calendar_inputs(rows)))
    both = single.transform(model.transform(models.calendar_inputs(rows)).withColumnRenamed("predicted", "p"))
    assert both.agg(F.max(F.abs(F.col("p") - F.col("predicted")))).first()[0] < 1e-6
    assert often.stages[-1].totalNumNodes == model.stages[-1].totalNumNodes


def test_search(rel):
    rows = rel.inverter_s.select("id", *INVERTER_KEY, "ts", "ac_power_kw")
    best = models.search_forecaster(rows, {"max_depth": [2, 3], "max_iter": [2]}, folds=2)
    assert best.count() == 2 and best.first()["mae_mean"] <= best.collect()[1]["mae_mean"]


def test_anomaly_model(rel, tmp_path, spark):
    rows = rel.inverter_s.withColumn("is_anomaly", anomaly_label()).dropna(subset=["ac_power_kw", "inverter_temp_c"])
    parts = splits.normal_only_split(rows, INVERTER_KEY)
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    model = models.fit_anomaly_model(train, k=3, q=0.9)
    counts = models.evaluate_anomaly_model(model, test, by=[]).first()
    assert counts.tp + counts.fp + counts.tn + counts.fn == test.count()
    errors = model.errors(train).select("reconstruction_error")
    assert errors.filter("reconstruction_error is null or reconstruction_error < 0").isEmpty()
    # all axes reproduce the row
    full = models.fit_anomaly_model(train, k=len(models.ANOMALY_COLUMNS))
    assert full.errors(train).agg(F.max("reconstruction_error")).first()[0] < 1e-9
    flagged = model.score(train).filter("is_anomaly = 1").count() / train.count()
    assert flagged < 0.2
    out = model.predictions(test, "r1")
    assert set(out.columns) == {"plant_id", "inverter_id", "ts", "model_run_id", "reconstruction_error", "threshold", "is_anomaly"}
    search = models.search_anomaly_model(train, test, [2, 3], [0.9])
    assert search.count() == 2
    models.save_run(models.evaluate_anomaly_model(model, test), out, model.stats, str(tmp_path), "r1")
    assert spark.read.parquet(str(tmp_path / "model_metrics")).filter("run_id = 'r1'").count() > 0


def test_fingerprint_ignores_order(rel):
    rows = rel.inverter_s.select("id", "ts", "ac_power_kw")
    a = metrics.fingerprint(rows).first()
    assert a == metrics.fingerprint(rows.repartition(5).select("ts", "ac_power_kw", "id")).first()
    assert a["fingerprint"] != metrics.fingerprint(rows.withColumn("id", F.col("id") + 1)).first()["fingerprint"]
