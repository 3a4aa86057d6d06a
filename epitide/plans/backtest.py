"""Expanding-origin ridge backtest of all pairs, without refitting.

A ridge fit on z-scored columns depends on the training rows only through sums, so one pass of running
sums per pair gives the fit at every origin. Only the quantiles of what came before and, with several lags, the small solve
leave the JVM.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions.numeric import normal_sf, past_quantiles
from ..operators.frames import lag_text, ordered, positive_lags
from ..operators.metrics import regression_metrics
from ..operators.pairs import PAIR, fit_inputs, fit_line, line_at, pair_frame, pair_grid
from ..schema import BacktestConfig

MODEL = "ridge_expanding_origin"

# The log-scale variant: columns scaled by population deviation, outcome not scaled, from the 21st row on.
LOG_SCALE = BacktestConfig(initial_train_fraction=0.0, min_train_size=20, x_scale="population", scale_y=False)


def log_series(series: DataFrame, freq: str = "W") -> DataFrame:
    """log1p of the period means of predictors and the period sums of outcomes, in canonical form."""
    rolled = series.groupBy("series_id", "role", "dataset_family", "series_name", "source_file",
                            S.period("date", freq).alias("date")).agg(
        F.avg("value").alias("_mean"), F.sum("value").alias("_sum"))
    value = S.log1p_clipped(F.when(F.col("role") == "predicted", F.col("_sum")).otherwise(F.col("_mean")))
    return rolled.withColumn("value", value).drop("_mean", "_sum").dropna(subset=["date", "value"])


def with_past_quantile(rows: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """Adds the q-quantile of the values before each row of its key. Rows that are partitioned by key already stay where they are."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("period")
        return table.append_column(name, pa.array(past_quantiles(table[value].to_numpy(), q), from_pandas=True))
    return rows.groupBy(*keys).applyInArrow(add, schema)


def origin_fits(frame: DataFrame, keys: list[str], xs: list[str], y: str, cfg: BacktestConfig) -> DataFrame:
    """Predictions of every period from the rows strictly before it, for each key.

    Adds n_complete, n_train, train_start, train_end, prediction, sigma, baseline_prediction,
    last_observed_target and spike_threshold; keeps the periods from the starting origin on.
    """
    every = Window.partitionBy(*keys)
    order = ordered(keys, ["period"])
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    centred = frame.select(
        "*", F.count(F.lit(1)).over(every).alias("n_complete"), (F.row_number().over(order) - 1).alias("n_train"),
        F.first(y).over(so_far).alias("_y0"), *[F.first(x).over(so_far).alias(f"_x0_{i}") for i, x in enumerate(xs)])
    cx = [F.col(x) - F.col(f"_x0_{i}") for i, x in enumerate(xs)]
    summed = centred.select(
        "*", fit_inputs(cx, F.col(y) - F.col("_y0"), past).alias("_sums"),
        F.avg(y).over(past).alias("baseline_prediction"),
        F.first("period").over(past).alias("train_start"), F.lag("period", 1).over(order).alias("train_end"),
        F.lag(y, 1).over(order).alias("last_observed_target"))
    summed = with_past_quantile(summed, keys, y, cfg.spike_quantile, "spike_threshold")
    n = F.col("n_complete")
    start = F.least(F.greatest(F.lit(cfg.min_train_size), F.floor(n * F.lit(cfg.initial_train_fraction))), n - 1)
    origins = summed.where((n >= max(3, cfg.min_train_size + 1)) & (F.col("n_train") >= start))
    fitted = origins.withColumn("_fit", fit_line(F.col("_sums"), len(xs), cfg.alpha, cfg.x_scale, cfg.scale_y))
    return (fitted.withColumn("prediction", line_at(F.col("_fit"), cx) + F.col("_y0"))
            .withColumn("sigma", F.col("_fit.sigma"))
            .drop("_fit", "_sums", "_y0", *[f"_x0_{i}" for i in range(len(xs))]))


def score_spikes(predictions: DataFrame, actual: str = "actual") -> DataFrame:
    """Probability that the outcome reaches the threshold, its score out of 100, and whether it did."""
    z = (F.col("spike_threshold") - F.col("prediction")) / F.col("sigma")
    return (predictions.withColumn("spike_probability", normal_sf(z))
            .withColumn("spike_score", 100.0 * F.col("spike_probability"))
            .withColumn("actual_spike", F.col(actual) >= F.col("spike_threshold")))


def pair_predictions(series: DataFrame, cfg: BacktestConfig = BacktestConfig(), spikes: bool = True, candidates: DataFrame | None = None) -> DataFrame:
    """One row per pair, or candidate pair, and predicted period."""
    lags = positive_lags(cfg.lags)
    frame = pair_frame(series, cfg.freq, lags, cfg.aggregation, candidates=candidates)
    rows = origin_fits(frame, PAIR, [f"x_lag{k}" for k in lags], "y", cfg).withColumnRenamed("y", "actual")
    rows = (rows.withColumn("residual", F.col("actual") - F.col("prediction"))
            .withColumn("abs_error", F.abs(F.col("residual")))
            .withColumn("lags", F.lit(lag_text(lags))).withColumn("model", F.lit(MODEL))
            .withColumn("ridge_alpha", F.lit(float(cfg.alpha))))
    rows = score_spikes(rows) if spikes else rows
    return rows.drop(*[f"x_lag{k}" for k in lags])


def leaking_rows(predictions: DataFrame) -> DataFrame:
    """Rows whose training window is not strictly before the predicted period; must be empty."""
    return predictions.where(~(F.col("train_end") < F.col("period")))


def pair_metrics(predictions: DataFrame, cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    """One row per pair: held-out metrics and the fields of the latest prediction."""
    latest = F.max_by(F.struct("prediction", "actual", "spike_threshold", "spike_score", "actual_spike"), "period")
    rows = regression_metrics(predictions, PAIR, skill="mse_skill_vs_rolling_train_mean", extra=[
        F.max("n_complete").alias("n_complete"), F.min("period").alias("first_prediction_period"),
        F.max("period").alias("last_prediction_period"), latest.alias("_latest")])
    return rows.select(
        "*", F.lit(cfg.freq).alias("freq"), F.lit(lag_text(positive_lags(cfg.lags))).alias("lags"),
        F.lit(MODEL).alias("model"), F.lit(float(cfg.alpha)).alias("ridge_alpha"),
        F.lit(cfg.min_train_size).alias("min_train_size"),
        F.lit(float(cfg.initial_train_fraction)).alias("initial_train_fraction"),
        *[F.col(f"_latest.{c}").alias(f"latest_{c}") for c in
          ("prediction", "actual", "spike_threshold", "spike_score", "actual_spike")]).drop("_latest")


def backtest_matrix(series: DataFrame, cfg: BacktestConfig = BacktestConfig(),
                    predictions: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """pair_metrics for every pair of the grid, or the candidates; pairs with too few complete rows become error rows."""
    predictions = pair_predictions(series, cfg, candidates=candidates) if predictions is None else predictions
    scored = pair_metrics(predictions, cfg)
    ok = F.col("n_predictions").isNotNull()
    need = max(3, cfg.min_train_size + 1)
    return (pair_grid(series, candidates).join(scored, PAIR, "left")
            .withColumn("status", F.when(ok, "ok").otherwise("error"))
            .withColumn("error", F.when(ok, "").otherwise(f"fewer than {need} complete lagged rows")))


# The leaderboards, the column each ranks by, and whether large values come first.
LEADERBOARDS = (
    ("best_rmse", "rmse", False),
    ("worst_rmse", "rmse", True),
    ("best_skill", "mse_skill_vs_rolling_train_mean", True),
    ("worst_abs_error", "max_abs_error", True),
    ("highest_spike_score", "latest_spike_score", True),
)


def leaderboards(results: DataFrame, size: int = 10, boards=LEADERBOARDS) -> DataFrame:
    """The top rows of each board as one long table (ranking, rank, pair, value).

    One pass over the results: row_number() <= size is cut to size rows per task before the shuffle.
    """
    entries = F.array(*[
        F.struct(F.lit(name).alias("ranking"), F.col(column).alias("value"),
                 (-F.col(column) if descending else F.col(column)).alias("_key"))
        for name, column, descending in boards])
    rows = results.where(F.col("status") == "ok").select(*PAIR, F.explode(entries).alias("_e")).select(*PAIR, "_e.*")
    place = Window.partitionBy("ranking").orderBy(F.col("_key").asc_nulls_last(), *PAIR)
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= size).drop("_key")
