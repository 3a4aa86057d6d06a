"""Train/test least squares of every predictor against every target."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.frames import lag_text
from ..operators.metrics import regression_metrics
from ..operators.pairs import PAIR, fit_inputs, fit_line, line_at, pair_frame, pair_grid
from ..operators.splits import chronological_split, train_zscore


def pair_fits(series: DataFrame, freq: str = "W", lags: Sequence[int] = (0, 1, 2, 3, 4), train_fraction: float = 0.8,
              min_test: int = 4, aggregation: str = "mean", candidates: DataFrame | None = None) -> DataFrame:
    """Rows of all pairs with split, train-scaled values, fitted value and residual.

    Everything is keyed by pair, so lagging, splitting, scaling and fitting share one shuffle.
    """
    lags = list(lags)
    names = [f"x_lag{k}" for k in lags]
    frame = chronological_split(pair_frame(series, freq, lags, aggregation, candidates=candidates), PAIR, "period", train_fraction, min_test)
    frame = frame.where(F.col("split").isNotNull())
    w = Window.partitionBy(*PAIR)
    train = F.col("split") == "train"
    scaled = train_zscore(frame, PAIR, ["y", *names]).withColumn(
        "y_train_mean", F.avg(F.when(train, F.col("y"))).over(w)).withColumn(
        "y_train_std", F.stddev_samp(F.when(train, F.col("y"))).over(w))
    scaled = scaled.withColumn("y_train_std", F.when(F.col("y_train_std") > 0, F.col("y_train_std")).otherwise(1.0))
    zs = [F.col(f"{n}_z") for n in names]
    sums = scaled.groupBy(*PAIR).agg(fit_inputs(zs, F.col("y_z"), where=train).alias("_sums"))
    fits = sums.select(*PAIR, fit_line(F.col("_sums"), len(lags), 0.0).alias("_fit"))
    rows = scaled.join(fits, PAIR).withColumn("prediction", line_at(F.col("_fit"), zs))
    return rows.withColumn("residual", F.col("y_z") - F.col("prediction")).drop("_fit")


def pair_scores(rows: DataFrame, freq: str, lags: Sequence[int]) -> DataFrame:
    """Held-out metrics per pair on the training z scale; the baseline is the training mean, zero."""
    spans = [
        F.max("n_rows").alias("n_complete"), F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
        *[f(F.when(F.col("split") == s, F.col("period"))).alias(f"{s}_{end}")
          for s in ("train", "test") for end, f in (("start", F.min), ("end", F.max))]]
    scores = regression_metrics(rows.withColumn("_zero", F.lit(0.0)), PAIR, "y_z", "prediction", "_zero",
                                "mse_skill_vs_train_mean", spans, F.col("split") == "test").drop(
        "n_predictions", "max_abs_error", "mean_abs_baseline_error")
    return scores.withColumn("freq", F.lit(freq)).withColumn("lags", F.lit(lag_text(lags)))


def pairwise_matrix(series: DataFrame, freq: str = "W", lags: Sequence[int] = (0, 1, 2, 3, 4),
                    train_fraction: float = 0.8, min_test: int = 4, aggregation: str = "mean",
                    rows: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """One result row per pair with metadata; pairs with fewer than three complete rows are error rows."""
    rows = pair_fits(series, freq, lags, train_fraction, min_test, aggregation, candidates) if rows is None else rows
    scored = pair_scores(rows, freq, lags)
    ok = F.col("n_complete").isNotNull()
    return (pair_grid(series, candidates).join(scored, PAIR, "left")
            .withColumn("status", F.when(ok, "ok").otherwise("error"))
            .withColumn("error", F.when(ok, "").otherwise("fewer than 3 overlapping complete rows")))
