"""Evaluation metrics, thresholds, scaling and model selection tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.plans import skew


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_metrics(df: DataFrame, by: Sequence[str] = (), truth: str = "y_true", guess: str = "y_pred", error: str | None = None) -> DataFrame:
    """Confusion counts, precision, recall and F1; undefined ones are zero.

    With ``error``, the mean error of each true class is added.
    """
    t, g = F.col(truth) == 1, F.col(guess) == 1
    cols = [
        F.count_if(t & g).alias("tp"), F.count_if(~t & ~g).alias("tn"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn")
    ]
    if error:
        for name, side in (("normal", ~t), ("anomaly", t)):
            cols.append(F.coalesce(F.avg(F.when(side, F.col(error))), F.lit(0.0)).alias(f"error_{name}"))
    counts = df.groupBy(*by).agg(*cols)
    tp = F.col("tp")
    scored = counts.withColumns({"precision": ratio_or_zero(tp, tp + F.col("fp")), "recall": ratio_or_zero(tp, tp + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", ratio_or_zero(2 * p * r, p + r))


def regression_metrics(df: DataFrame, by: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, MSE, RMSE, and MAPE in percent over rows with a non-zero actual value."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(e, y))) * 100).alias("mape"), F.count(F.lit(1)).alias("rows"),
    )


def mae_by_hour(df: DataFrame, ts: str = "ts", actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    return df.groupBy(F.hour(ts).alias("hour")).agg(F.avg(F.abs(e)).alias("mae"), F.count(F.lit(1)).alias("rows"))


def residual_stats(df: DataFrame, by: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(
        F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.min(e).alias("least"), F.max(e).alias("greatest")
    )


def fold_summary(scores: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Mean and population deviation of a metric over folds."""
    return scores.groupBy(*by).agg(F.avg(metric).alias(f"{metric}_mean"), F.stddev_pop(metric).alias(f"{metric}_std"))


def error_threshold(df: DataFrame, by: Sequence[str], error: str, q: float = 0.99) -> DataFrame:
    """Quantile of the training errors of each key."""
    return skew.quantiles(df, by, [error], [q]).select(*by, F.col(error)[0].alias("threshold"))


def scaler_stats(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean and sample deviation per measure; a deviation of zero becomes 1."""
    out = []
    for c in cols:
        sd = F.stddev_samp(c)
        out += [F.avg(c).alias(f"{c}_mean"), F.when(sd == 0, 1.0).otherwise(sd).alias(f"{c}_std")]
    return df.groupBy(*by).agg(*out)


def standardize(df: DataFrame, stats: DataFrame, by: Sequence[str], cols: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """Columns as ``(x - mean) / std`` of their key; what is not finite becomes ``fill``."""
    joined = df.join(skew.lookup(stats), list(by), "left")
    scaled = {c: F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_std")) for c in cols}
    if fill is not None:
        scaled = {c: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(fill) for c, x in scaled.items()}
    return joined.withColumns(scaled).select(*df.columns)


def mean_square(cols: Sequence[str]) -> Column:
    """Mean of the squared columns of a row."""
    return sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)) / len(cols)


def score_threshold(df: DataFrame, thresholds: DataFrame, by: Sequence[str], error: str = "reconstruction_error") -> DataFrame:
    """Mark rows whose error exceeds the threshold of their key."""
    joined = df.join(skew.lookup(thresholds), list(by), "left")
    return joined.withColumn("is_anomaly", F.coalesce(F.col(error) > F.col("threshold"), F.lit(False)).cast("int"))


def fleet_best(scores: DataFrame, metric: str, lowest: bool, key: str = "inverter_id") -> DataFrame:
    """Mean metric of the fleet and the inverter with the best one."""
    order = F.struct(F.col(metric) if lowest else -F.col(metric), F.col(key))
    return scores.agg(
        F.avg(metric).alias(f"mean_{metric}"), F.min_by(key, order).alias("best_inverter"),
        (F.min(metric) if lowest else F.max(metric)).alias(f"best_{metric}"), F.count(F.lit(1)).alias("inverters"),
    )


def best_run(runs: DataFrame, metric: str, lowest: bool, by: Sequence[str] = ("inverter_id",), run: str = "run_id") -> DataFrame:
    """Best finished run per inverter, as an aggregate over the runs."""
    rest = [c for c in runs.columns if c not in by]
    order = F.struct(F.col(metric) if lowest else -F.col(metric), F.col(run))
    done = runs.filter((F.col("status") == "FINISHED") & F.col(metric).isNotNull())
    return done.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*")


def top_trials(trials: DataFrame, n: int = 5, value: str = "value", trial: str = "number") -> DataFrame:
    return trials.filter("state = 'COMPLETE'").orderBy(value, trial).limit(n)


def top_features(importances: DataFrame, n: int = 20) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)


def best_model_per_metric(scores: DataFrame, metrics: Sequence[str], model: str = "model") -> DataFrame:
    best = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_{m}").alias("model")) for m in metrics])
    one = scores.agg(*[F.min_by(model, F.struct(m, model)).alias(f"_{m}") for m in metrics])
    return one.select(F.explode(best).alias("b")).select("b.*")


def fingerprint(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Row count, time range and a content hash that does not depend on row order.

    Columns are hashed in name order; the sum of the row hashes is exact.
    """
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.sum(row).cast("string").alias("fingerprint")
    )


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key; Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
