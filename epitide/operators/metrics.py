"""Forecast and classification metrics as grouped aggregates."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running_sums


def regression_metrics(df: DataFrame, keys: Sequence[str], actual: str = "actual", prediction: str = "prediction",
                       baseline: str | None = "baseline_prediction", skill: str = "mse_skill",
                       extra: Sequence[Column] = (), where: Column | None = None) -> DataFrame:
    """MAE, RMSE, R2, correlation and, with a baseline, its RMSE and the skill against it.

    where restricts the metrics to some rows, so that extra aggregates over all rows come from the same pass.
    """
    a, p = F.col(actual), F.col(prediction)
    if where is not None:
        a, p = F.when(where, a), F.when(where, p)
    err = a - p
    total = F.var_pop(a) * F.count(a)
    aggs = [
        (F.count(F.lit(1)) if where is None else F.count_if(where)).alias("n_predictions"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.max(F.abs(err)).alias("max_abs_error"),
        F.when(total > 0, 1 - F.sum(err * err) / total).alias("r2"),
        F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(p) > 0),
               F.covar_pop(a, p) / (F.stddev_pop(a) * F.stddev_pop(p))).alias("correlation"),  # corr() fails on constants
    ]
    if baseline:
        base = a - F.col(baseline)
        mse, base_mse = F.avg(err * err), F.avg(base * base)
        aggs += [
            F.avg(F.abs(base)).alias("mean_abs_baseline_error"),
            F.sqrt(base_mse).alias("baseline_rmse"),
            F.when(base_mse > 0, 1 - mse / base_mse).alias(skill),
        ]
    return df.groupBy(*keys).agg(*aggs, *extra)


def classification_metrics(df: DataFrame, keys: Sequence[str], label: str, probability: str,
                           threshold: float = 0.5) -> DataFrame:
    """Brier score, precision, recall, F1, average precision and ROC AUC per group.

    Rows are counted per distinct score first, so ties cost nothing; the running sums over scores are taken in ranges, so a group
    may have any number of them. The ranking measures are NULL when a group has one class.
    """
    keys = list(keys)
    y, p = F.col(label).cast("double"), F.col(probability)
    hit = (p >= threshold).cast("double")
    per_score = df.groupBy(*keys, p.alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_pos"),
        F.sum((p - y) * (p - y)).alias("_sq"),
        F.sum(hit * y).alias("_tp"), F.sum(hit * (1 - y)).alias("_fp"), F.sum((1 - hit) * y).alias("_fn"))
    ranked = running_sums(per_score, keys, F.col("_p").desc(), ["_n", "_pos"]).withColumnsRenamed({"_n_upto": "_cn", "_pos_upto": "_cp"})
    neg = F.col("_n") - F.col("_pos")
    above = F.col("_cp") - F.col("_pos")
    sums = ranked.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum("_pos").alias("n_positive"), F.sum("_sq").alias("_sq"),
        F.sum("_tp").alias("_tp"), F.sum("_fp").alias("_fp"), F.sum("_fn").alias("_fn"),
        F.sum(F.col("_pos") * F.col("_cp") / F.col("_cn")).alias("_ap"),
        F.sum(neg * (above + F.col("_pos") / 2)).alias("_auc"))
    negatives = F.col("n") - F.col("n_positive")
    both = (F.col("n_positive") > 0) & (negatives > 0)
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    return sums.select(
        *keys, "n", F.col("n_positive").cast("long").alias("n_positive"), (F.col("_sq") / F.col("n")).alias("brier"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0).alias("recall"),
        F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"),
        F.when(both, F.col("_ap") / F.col("n_positive")).alias("average_precision"),
        F.when(both, F.col("_auc") / (F.col("n_positive") * negatives)).alias("roc_auc"))


def interval_metrics(df: DataFrame, keys: Sequence[str], actual: str, prediction: str, lower: str, upper: str,
                     prefix: str = "") -> DataFrame:
    """Coverage and mean width of an interval, and the MAE of its centre."""
    a = F.col(actual)
    return df.groupBy(*keys).agg(
        F.avg(F.abs(a - F.col(prediction))).alias(f"{prefix}mae"),
        F.avg(a.between(F.col(lower), F.col(upper)).cast("double")).alias(f"{prefix}interval_coverage"),
        F.avg(F.col(upper) - F.col(lower)).alias(f"{prefix}interval_width"))


def ensemble_summary(df: DataFrame, keys: Sequence[str], value: str, level: float) -> DataFrame:
    """Mean and central interval over ensemble members; the number of members is a setting, so percentile() is safe."""
    tail = (1.0 - level) / 2.0
    return df.groupBy(*keys).agg(
        F.avg(value).alias("prediction"),
        F.percentile(value, F.lit(tail)).alias("lower"), F.percentile(value, F.lit(1.0 - tail)).alias("upper"))
