"""Forecast and anomaly models on MLlib, with the tables around them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.functions.quality import clip_nonneg
from sunloom.functions.temporal import CALENDAR_COLUMNS, calendar_features, cyclic_features
from sunloom.operators import metrics, splits

KEY = ["plant_id", "inverter_id"]

#: inputs of the anomaly model; the failure counter is the label's source and left out
ANOMALY_COLUMNS = [
    "state", "inverter_temp_c", "ac_power_kw", "ac_freq_hz", "dc_power_kw", "dc_voltage_v", "dc_current_a", "healthy_strings", "failed_strings",
    "amb_temp_c", "module_temp_c", "wind_speed_ms", "humidity_percent", "poa_irradiance_wm2",
]


def calendar_inputs(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Columns known for any future time, so that no measurement leaks in."""
    return cyclic_features(calendar_features(df, ts))


def fit_forecaster(
    train: DataFrame, target: str = "ac_power_kw", pooled: bool = True, max_iter: int = 50, max_depth: int = 5, step: float = 0.1, seed: int = 42
) -> PipelineModel:
    """Boosted trees on the calendar inputs.

    The pooled model takes the inverter as an input and is fit once over all rows;
    for one inverter pass its rows with ``pooled=False``. Rows with equal inputs are one
    instance, weighed by their number, with their mean as label: for the squared error
    splits and leaves are those of the single rows, and a tree's passes are over the
    distinct inputs (hours of the calendar times inverters) instead of the rows.
    """
    inputs = list(CALENDAR_COLUMNS)
    rows = calendar_inputs(train).dropna(subset=[target])
    stages = []
    if pooled:
        stages.append(StringIndexer(inputCol="inverter_id", outputCol="inverter_no", handleInvalid="keep").fit(rows))
        inputs.append("inverter_no")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    # the other calendar columns follow from these
    same = ["hour", "day_of_week", "day_of_month", "month", *(["inverter_id"] if pooled else [])]
    rest = [F.first(c).alias(c) for c in CALENDAR_COLUMNS if c not in same]
    counted = rows.groupBy(*same).agg(*rest, F.avg(F.col(target).cast("double")).alias("_label"), F.count(F.lit(1)).cast("double").alias("_weight"))
    trees = GBTRegressor(
        labelCol="_label", weightCol="_weight", featuresCol="features", predictionCol="predicted", maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=seed
    )
    ready = PipelineModel(stages).transform(counted)
    return PipelineModel([*stages, trees.fit(ready)])


def predict_power(model: PipelineModel, rows: DataFrame, name: str = "predicted") -> DataFrame:
    """Predicted power, at least zero."""
    out = model.transform(calendar_inputs(rows))
    return out.withColumn(name, clip_nonneg("predicted")).select(*rows.columns, name)


def evaluate_forecaster(model: PipelineModel, test: DataFrame, target: str = "ac_power_kw", by: Sequence[str] = tuple(KEY)) -> DataFrame:
    scored = predict_power(model, test.dropna(subset=[target]))
    return metrics.regression_metrics(scored, list(by), target, "predicted")


def search_forecaster(rows: DataFrame, grid: dict[str, Sequence], folds: int = 3, target: str = "ac_power_kw", seed: int = 42) -> DataFrame:
    """Mean and spread of the fold MAE for every combination, best first.

    Each fold trains on the rows before its block. The search is a loop over the
    combinations; every fit and score in it is a Spark job over all rows.
    """
    labelled = splits.time_series_folds(rows, KEY, folds).persist()
    results = []
    names = sorted(grid)
    for number, values in enumerate(product(*[grid[n] for n in names])):
        params = dict(zip(names, values))
        for f in range(1, folds + 1):
            train, test = splits.fold_sets(labelled, f)
            model = fit_forecaster(train, target, seed=seed, **params)
            mae = evaluate_forecaster(model, test, target, []).first()["mae"]
            results.append((number, str(params), f, float(mae) if mae is not None else None))
    labelled.unpersist()
    scores = rows.sparkSession.createDataFrame(results, "number int, params string, fold int, mae double")
    return metrics.fold_summary(scores, ["number", "params"], "mae").orderBy("mae_mean", "number")


def forecast_rows(model: PipelineModel, grid: DataFrame, run_id: str) -> DataFrame:
    """Rows of the forecast table for a grid of future times."""
    out = predict_power(model, grid, "predicted_ac_power_kw")
    return out.select("plant_id", "inverter_id", "ts", F.lit(run_id).alias("model_run_id"), "predicted_ac_power_kw")


@dataclass
class AnomalyModel:
    """Scaling of each inverter, shared principal axes, and an error limit per inverter."""

    columns: list[str]
    by: list[str]
    stats: DataFrame
    axes: list[list[float]]
    thresholds: DataFrame

    def errors(self, rows: DataFrame) -> DataFrame:
        return with_reconstruction_error(rows, self.stats, self.axes, self.columns, self.by)

    def score(self, rows: DataFrame) -> DataFrame:
        return metrics.score_threshold(self.errors(rows), self.thresholds, self.by)

    def predictions(self, rows: DataFrame, run_id: str) -> DataFrame:
        """Rows of the anomaly table."""
        return self.score(rows).select(
            "plant_id", "inverter_id", "ts", F.lit(run_id).alias("model_run_id"), "reconstruction_error", "threshold", "is_anomaly"
        ).dropna(subset=["threshold"])


def with_reconstruction_error(rows: DataFrame, stats: DataFrame, axes: list[list[float]], columns: list[str], by: Sequence[str]) -> DataFrame:
    """Mean squared distance of a scaled row from its projection on the axes.

    ``axes`` holds one list of loadings per input column.
    """
    tagged = rows.withColumns({f"_x{i}": F.col(c).cast("double") for i, c in enumerate(columns)})
    names = [f"_x{i}" for i in range(len(columns))]
    renamed = stats.select(*by, *[F.col(f"{c}_{s}").alias(f"_x{i}_{s}") for i, c in enumerate(columns) for s in ("mean", "std")])
    scaled = metrics.standardize(tagged, renamed, by, names)
    k = len(axes[0])
    projected = scaled.withColumns({f"_z{j}": sum((F.col(n) * a[j] for n, a in zip(names, axes)), F.lit(0.0)) for j in range(k)})
    back = [sum((F.col(f"_z{j}") * a[j] for j in range(k)), F.lit(0.0)) for a in axes]
    error = sum(((F.col(n) - b) * (F.col(n) - b) for n, b in zip(names, back)), F.lit(0.0)) / len(names)
    return projected.withColumn("reconstruction_error", error).drop(*names, *[f"_z{j}" for j in range(k)])


def fit_anomaly_model(normal: DataFrame, columns: Sequence[str] = tuple(ANOMALY_COLUMNS), k: int = 5, q: float = 0.995, by: Sequence[str] = tuple(KEY)) -> AnomalyModel:
    """Fit on normal rows: scaling per inverter, axes over all, limit per inverter.

    The axes are a matrix of inputs by ``k`` numbers, the only thing that leaves
    the executors.
    """
    columns, by = [c for c in columns if c in normal.columns], list(by)
    stats = metrics.scaler_stats(normal, by, columns)
    scaled = metrics.standardize(normal.withColumns({c: F.col(c).cast("double") for c in columns}), stats, by, columns)
    packed = VectorAssembler(inputCols=columns, outputCol="features").transform(scaled)
    fitted = PCA(k=min(k, len(columns)), inputCol="features", outputCol="projected").fit(packed)
    axes = [[float(x) for x in row] for row in fitted.pc.toArray()]
    errors = with_reconstruction_error(normal, stats, axes, columns, by)
    return AnomalyModel(columns, by, stats, axes, metrics.error_threshold(errors, by, "reconstruction_error", q))


def evaluate_anomaly_model(model: AnomalyModel, test: DataFrame, label: str = "is_anomaly", by: Sequence[str] = tuple(KEY)) -> DataFrame:
    scored = model.score(test.withColumnRenamed(label, "y_true")).withColumnRenamed("is_anomaly", "y_pred")
    return metrics.confusion_metrics(scored, list(by), error="reconstruction_error")


def search_anomaly_model(train: DataFrame, check: DataFrame, ks: Sequence[int], qs: Sequence[float], columns: Sequence[str] = tuple(ANOMALY_COLUMNS)) -> DataFrame:
    """F1 of every number of axes and quantile on rows that hold anomalies."""
    results = []
    for number, (k, q) in enumerate(product(ks, qs)):
        model = fit_anomaly_model(train, columns, k, q)
        f1 = evaluate_anomaly_model(model, check, by=[]).first()["f1"]
        results.append((number, k, q, float(f1), "COMPLETE"))
    scores = train.sparkSession.createDataFrame(results, "number int, k int, q double, f1 double, state string")
    return scores.orderBy(F.desc("f1"), "number")


def save_run(run: DataFrame, predictions: DataFrame, scaler: DataFrame, root: str, run_id: str) -> None:
    """Store metrics, test predictions and scaling of a run as tables."""
    for name, df in (("model_metrics", run), ("test_predictions", predictions), ("scaler_stats", scaler)):
        df.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(f"{root}/{name}")
