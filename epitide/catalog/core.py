"""Pair analyses: the expanding-origin backtest and the train/test matrix."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.pairs import PAIR
from ..operators.rollup import series_catalogue
from ..plans import backtest, pairwise
from ..plans.forecast import leading_candidates
from ..schema import BacktestConfig
from .inputs import R, canonical, pair_sql, rounded, weekly_series

ONE_LAG = BacktestConfig(lags=(1,))
TWO_LAGS = BacktestConfig(lags=(1, 2))
FOUR_LAGS = BacktestConfig()

PREDICTED = ["n_complete", "n_train", "train_start", "train_end"]
ROUNDED = ["prediction", "sigma", "baseline_prediction", "last_observed_target", "spike_threshold"]


def rolling(cfg):
    def run(spark, sf):
        rows = backtest.pair_predictions(canonical(spark, sf), cfg)
        return rows.select(*PAIR, "period", *PREDICTED, R("actual", 4).alias("actual"),
                           *rounded(ROUNDED, 4), R("spike_score", 4).alias("spike_score"),
                           "actual_spike")
    return run


def matrix(cfg):
    return lambda spark, sf: backtest.backtest_matrix(weekly_series(spark, sf), cfg)


def candidate_matrix(spark, sf):
    """Backtest of the pairs whose predictor runs past its target's end, no others."""
    series = weekly_series(spark, sf)
    candidates = leading_candidates(series_catalogue(canonical(spark, sf)))
    rows = backtest.backtest_matrix(series, ONE_LAG, candidates=candidates)
    return rows.select(*PAIR, "predictor_name", "target_name", "status", "n_complete", "n_predictions", *rounded(METRICS, 4))


def log_scale(spark, sf):
    from dataclasses import replace
    rows = backtest.pair_predictions(backtest.log_series(canonical(spark, sf)), replace(backtest.LOG_SCALE, lags=(1,)))
    return rows.select(*PAIR, "period", "n_train", "train_end", *rounded(
        ("actual", "prediction", "sigma", "baseline_prediction", "spike_threshold"), 6), R("spike_score", 4).alias("spike_score"), "actual_spike")


METRICS = ["mae", "rmse", "max_abs_error", "mean_abs_baseline_error", "baseline_rmse",
           "mse_skill_vs_rolling_train_mean", "r2", "correlation"]


def rolling_metrics(cfg):
    def run(spark, sf):
        rows = matrix(cfg)(spark, sf)
        return rows.select(
            *PAIR, "predictor_family", "predictor_name", "target_family", "target_name", "status", "error", "n_complete",
            "n_predictions", "first_prediction_period", "last_prediction_period",
            *rounded(METRICS, 4), R("latest_prediction", 4).alias("latest_prediction"),
            R("latest_spike_score", 4).alias("latest_spike_score"), "latest_actual_spike")
    return run


def leaderboard(spark, sf):
    return backtest.leaderboards(matrix(ONE_LAG)(spark, sf)).select(
        "ranking", "rank", *PAIR, R("value", 4).alias("value"))


def leakage_check(spark, sf):
    rows = backtest.pair_predictions(canonical(spark, sf), ONE_LAG, spikes=False)
    return rows.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~(F.col("train_end") < F.col("period"))).alias("n_leaking"))


def rolling_interval(spark, sf):
    from ..functions.numeric import normal_quantile
    from ..operators.metrics import interval_metrics
    z = normal_quantile(0.9)
    rows = backtest.pair_predictions(canonical(spark, sf), ONE_LAG, spikes=False).withColumn(
        "lower", F.col("prediction") - z * F.col("sigma")).withColumn("upper", F.col("prediction") + z * F.col("sigma"))
    out = interval_metrics(rows, PAIR, "actual", "prediction", "lower", "upper")
    return out.select(*PAIR, *rounded(("mae", "interval_coverage", "interval_width"), 4))


def ols(lags):
    def run(spark, sf):
        rows = pairwise.pair_fits(canonical(spark, sf), lags=lags)
        return rows.select(*PAIR, "period", "split", R("y_z", 5).alias("y_z"),
                           R("prediction", 5).alias("prediction"), R("residual", 5).alias("residual"))
    return run


def ols_matrix(lags):
    def run(spark, sf):
        rows = pairwise.pairwise_matrix(weekly_series(spark, sf), lags=lags)
        return rows.select(
            *PAIR, "predictor_family", "target_family", "status", "error", "n_complete", "n_train", "n_test",
            "train_start", "train_end", "test_start", "test_end",
            *rounded(("mae", "rmse", "r2", "correlation", "baseline_rmse",
                                               "mse_skill_vs_train_mean"), 4))
    return run


QUERIES = {
    "rolling_ridge_lag1": rolling(ONE_LAG),
    "rolling_ridge_lag1_2": rolling(TWO_LAGS),
    "rolling_ridge": rolling(FOUR_LAGS),
    "rolling_ridge_log_scale": log_scale,
    "rolling_ridge_metrics": rolling_metrics(ONE_LAG),
    "rolling_ridge_matrix": rolling_metrics(FOUR_LAGS),
    "candidate_metrics": candidate_matrix,
    "pair_leaderboard": leaderboard,
    "leakage_check": leakage_check,
    "rolling_interval": rolling_interval,
    "pairwise_ols_lag1": ols((1,)),
    "pairwise_ols_lag0_1": ols((0, 1)),
    "pairwise_ols_matrix_lag1": ols_matrix((1,)),
    "pairwise_ols": ols_matrix((0, 1, 2, 3, 4)),
}

# erfc by its all-positive series, good to about 1e-12 for the scores seen here
NORMAL_SF = """
  CASE WHEN z IS NULL THEN NULL ELSE 0.5 * (1 - sign(z) * exp(-z*z/2) * list_sum(list_transform(range(0, 120),
    lambda i: CASE WHEN z = 0 THEN 0 ELSE exp((2*i+1) * ln(abs(z)/sqrt(2.0)) - lgamma(i + 1.5)) END))) END"""

FIRST_ORIGIN = """least(greatest(12, CAST(floor(n_complete * CAST(0.6 AS DOUBLE)) AS BIGINT)), n_complete - 1)"""


def eliminated(source, k, result="solved"):
    """CTEs that turn columns g{i}_{j} (matrix) and c{i} (right side) of `source` into columns b{i}, one pivot at a time."""
    steps, last = [], source
    for p in range(k):
        cells = [f"{cell} - g{i}_{p} / g{p}_{p} * {over} AS {cell}" for i in range(k) if i != p
                 for cell, over in [(f"g{i}_{j}", f"g{p}_{j}") for j in range(p + 1, k)] + [(f"c{i}", f"c{p}")]]
        steps.append(f"{result}{p} AS (SELECT * REPLACE ({', '.join(cells)}) FROM {last})" if cells else f"{result}{p} AS (SELECT * FROM {last})")
        last = f"{result}{p}"
    solution = ", ".join(f"c{i} / g{i}_{i} AS b{i}" for i in range(k))
    return ", ".join(steps) + f", {result} AS (SELECT *, {solution} FROM {last})"


def rolling_ctes(lags):
    """origins(..., prediction, sigma) from running means, deviations and correlations."""
    k = len(lags)
    x = [f"x_lag{j}" for j in lags]
    both = [(i, j) for i in range(k) for j in range(i + 1, k)]
    stats = ", ".join(
        [f"avg({c}) OVER past AS m{i}, stddev_samp({c}) OVER past AS s{i}, corr({c}, y) OVER past AS r{i}" for i, c in enumerate(x)]
        + [f"corr({x[i]}, {x[j]}) OVER past AS q{i}_{j}" for i, j in both])
    # ((n - 1) Q + I) b = (n - 1) r, Q the correlations of the lags
    system = ", ".join(
        [f"(n_train - 1) * {'1.0' if i == j else f'q{min(i, j)}_{max(i, j)}'} + {1.0 if i == j else 0.0} AS g{i}_{j}" for i in range(k) for j in range(k)]
        + [f"(n_train - 1) * r{i} AS c{i}" for i in range(k)])
    fit = "(" + " + ".join(f"b{i} * (x{i} - m{i}) / s{i}" for i in range(k)) + ")"
    rest = "1" + "".join(f" - 2 * b{i} * r{i} + b{i} * b{i}" for i in range(k)) + "".join(f" + 2 * b{i} * b{j} * q{i}_{j}" for i, j in both)
    cols = ", ".join(f"{c} AS x{i}" for i, c in enumerate(x))
    return "WITH " + pair_sql(lags) + f""",
walk AS (
  SELECT predictor_id, target_id, period, y, {cols},
         count(*) OVER (PARTITION BY predictor_id, target_id) AS n_complete,
         row_number() OVER o - 1 AS n_train,
         first_value(period) OVER past AS train_start, lag(period) OVER o AS train_end,
         lag(y) OVER o AS last_observed_target, avg(y) OVER past AS baseline, stddev_samp(y) OVER past AS sy,
         quantile_cont(y, 0.9) OVER past AS threshold, {stats}
  FROM pairs
  WINDOW o AS (PARTITION BY predictor_id, target_id ORDER BY period),
         past AS (PARTITION BY predictor_id, target_id ORDER BY period
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), systems AS (
  SELECT *, {system} FROM walk WHERE n_complete >= 13 AND n_train >= {FIRST_ORIGIN}
), {eliminated("systems", k)}, origins AS (
  SELECT *, baseline + sy * {fit} AS prediction, sy * sqrt(greatest({rest}, 0)) AS sigma FROM solved
), scored AS (
  SELECT *, (threshold - prediction) / sigma AS z FROM origins
), final AS (
  SELECT *, 100 * {NORMAL_SF} AS score, y >= threshold AS hit FROM scored
)"""


def log_scale_sql():
    """The one-lag walk on log1p values: population scale, outcome unscaled, from the 21st complete row."""
    sql = rolling_ctes((1,))
    for old, new in (
        ("period, avg(value) AS value\n", "period, ln(1 + greatest(CASE WHEN max(role) = 'predicted' THEN sum(value) ELSE avg(value) END, 0)) AS value\n"),
        ("(n_train - 1) * 1.0 + 1.0 AS g0_0", "n_train + 1.0 AS g0_0"), ("(n_train - 1) * r0 AS c0", "n_train * r0 AS c0"),
        ("n_complete >= 13", "n_complete >= 21"), (FIRST_ORIGIN, "least(20, n_complete - 1)")):
        assert old in sql
        sql = sql.replace(old, new)
    return sql + """
SELECT predictor_id, target_id, period, n_train, train_end, rnd(y, 6) AS actual, rnd(prediction, 6) AS prediction, rnd(sigma, 6) AS sigma,
       rnd(baseline, 6) AS baseline_prediction, rnd(threshold, 6) AS spike_threshold, rnd(score, 4) AS spike_score, hit AS actual_spike FROM final"""


def rolling_sql(lags):
    return rolling_ctes(lags) + """
SELECT predictor_id, target_id, period, n_complete, n_train, train_start, train_end, rnd(y, 4) AS actual,
       rnd(prediction, 4) AS prediction, rnd(sigma, 4) AS sigma, rnd(baseline, 4) AS baseline_prediction,
       rnd(last_observed_target, 4) AS last_observed_target, rnd(threshold, 4) AS spike_threshold,
       rnd(score, 4) AS spike_score, hit AS actual_spike
FROM final"""


METRICS_CTE = """, metrics AS (
  SELECT predictor_id, target_id, max(n_complete) AS n_complete, count(*) AS n_predictions,
         min(period) AS first_prediction_period, max(period) AS last_prediction_period,
         avg(abs(y - prediction)) AS mae, sqrt(avg((y - prediction)**2)) AS rmse,
         max(abs(y - prediction)) AS max_abs_error, avg(abs(y - baseline)) AS mean_abs_baseline_error,
         sqrt(avg((y - baseline)**2)) AS baseline_rmse,
         1 - avg((y - prediction)**2) / avg((y - baseline)**2) AS skill,
         1 - sum((y - prediction)**2) / (var_pop(y) * count(*)) AS r2, corr(y, prediction) AS correlation,
         max_by(prediction, period) AS latest_prediction, max_by(score, period) AS latest_spike_score,
         max_by(hit, period) AS latest_actual_spike
  FROM final GROUP BY ALL
)"""


def ols_ctes(lags):
    x = [f"x_lag{j}" for j in lags]
    train = "FILTER (WHERE split = 'train') OVER g"
    stats = ", ".join(f"avg({c}) {train} AS m{i}, stddev_samp({c}) {train} AS s{i}" for i, c in enumerate(x))
    zs = ", ".join(f"(x{i} - m{i}) / CASE WHEN s{i} > 0 THEN s{i} ELSE 1 END AS z{i}" for i in range(len(x)))
    cols = ", ".join(f"{c} AS x{i}, {c}" for i, c in enumerate(x))
    k = len(x)
    agg = ", ".join([f"sum(z{i} * z{j}) AS g{i}_{j}" for i in range(k) for j in range(k)] + [f"sum(z{i} * y_z) AS c{i}" for i in range(k)])
    fit = " + ".join(f"b{i} * z{i}" for i in range(k))
    return "WITH " + pair_sql(lags) + f""",
counted AS (
  SELECT *, count(*) OVER g AS n, row_number() OVER (PARTITION BY predictor_id, target_id ORDER BY period) AS i
  FROM pairs WINDOW g AS (PARTITION BY predictor_id, target_id)
), cut AS (
  SELECT *, CASE WHEN i <= greatest(1, CASE WHEN n <= 4 THEN n - 1
                   ELSE least(CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT), n - 4) END)
                 THEN 'train' ELSE 'test' END AS split
  FROM counted WHERE n >= 3
), stats AS (
  SELECT predictor_id, target_id, period, n, split, y, {cols}, avg(y) {train} AS my, stddev_samp(y) {train} AS sy, {stats}
  FROM cut WINDOW g AS (PARTITION BY predictor_id, target_id)
), zed AS (
  SELECT predictor_id, target_id, period, n, split, (y - my) / CASE WHEN sy > 0 THEN sy ELSE 1 END AS y_z, {zs}
  FROM stats
), sums AS (
  SELECT predictor_id, target_id, {agg} FROM zed WHERE split = 'train' GROUP BY ALL
), {eliminated("sums", k, "fits")}, fitted AS (
  SELECT zed.*, {fit} AS prediction FROM zed JOIN fits USING (predictor_id, target_id)
)"""


def ols_sql(lags):
    return ols_ctes(lags) + """
SELECT predictor_id, target_id, period, split, rnd(y_z, 5) AS y_z, rnd(prediction, 5) AS prediction,
       rnd(y_z - prediction, 5) AS residual
FROM fitted"""


def metrics_sql(lags):
    return rolling_ctes(lags) + METRICS_CTE + """
SELECT predictor_id, target_id, split_part(predictor_id, '::', 1) AS predictor_family,
       split_part(predictor_id, '::', 2) AS predictor_name, split_part(target_id, '::', 1) AS target_family,
       split_part(target_id, '::', 2) AS target_name, 'ok' AS status, '' AS error, n_complete, n_predictions,
       first_prediction_period, last_prediction_period, rnd(mae, 4) AS mae, rnd(rmse, 4) AS rmse,
       rnd(max_abs_error, 4) AS max_abs_error, rnd(mean_abs_baseline_error, 4) AS mean_abs_baseline_error,
       rnd(baseline_rmse, 4) AS baseline_rmse, rnd(skill, 4) AS mse_skill_vs_rolling_train_mean,
       rnd(r2, 4) AS r2, rnd(correlation, 4) AS correlation, rnd(latest_prediction, 4) AS latest_prediction,
       rnd(latest_spike_score, 4) AS latest_spike_score, latest_actual_spike
FROM metrics"""


def ols_matrix_sql(lags):
    return ols_ctes(lags) + """
SELECT predictor_id, target_id, split_part(predictor_id, '::', 1) AS predictor_family,
       split_part(target_id, '::', 1) AS target_family, 'ok' AS status, '' AS error, max(n) AS n_complete,
       CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS n_train,
       CAST(count(*) FILTER (WHERE split = 'test') AS BIGINT) AS n_test,
       min(period) FILTER (WHERE split = 'train') AS train_start, max(period) FILTER (WHERE split = 'train') AS train_end,
       min(period) FILTER (WHERE split = 'test') AS test_start, max(period) FILTER (WHERE split = 'test') AS test_end,
       rnd(avg(abs(y_z - prediction)) FILTER (WHERE split = 'test'), 4) AS mae,
       rnd(sqrt(avg((y_z - prediction)**2) FILTER (WHERE split = 'test')), 4) AS rmse,
       rnd(1 - sum((y_z - prediction)**2) FILTER (WHERE split = 'test')
               / (var_pop(y_z) FILTER (WHERE split = 'test') * count(*) FILTER (WHERE split = 'test')), 4) AS r2,
       rnd(corr(y_z, prediction) FILTER (WHERE split = 'test'), 4) AS correlation,
       rnd(sqrt(avg(y_z**2) FILTER (WHERE split = 'test')), 4) AS baseline_rmse,
       rnd(1 - avg((y_z - prediction)**2) FILTER (WHERE split = 'test')
               / avg(y_z**2) FILTER (WHERE split = 'test'), 4) AS mse_skill_vs_train_mean
FROM fitted GROUP BY ALL"""


ORACLES = {
    "rolling_ridge_lag1": rolling_sql((1,)),
    "rolling_ridge_lag1_2": rolling_sql((1, 2)),
    "rolling_ridge_log_scale": log_scale_sql(),
    "rolling_ridge": rolling_sql((1, 2, 3, 4)),
    "rolling_ridge_metrics": metrics_sql((1,)),
    "rolling_ridge_matrix": metrics_sql((1, 2, 3, 4)),
    "candidate_metrics": rolling_ctes((1,)) + METRICS_CTE + """, ends AS (SELECT series_id, max(date) AS e FROM canonical GROUP BY series_id)
SELECT predictor_id, target_id, split_part(predictor_id, '::', 2) AS predictor_name, split_part(target_id, '::', 2) AS target_name, 'ok' AS status,
       n_complete, n_predictions, rnd(mae, 4) AS mae, rnd(rmse, 4) AS rmse, rnd(max_abs_error, 4) AS max_abs_error,
       rnd(mean_abs_baseline_error, 4) AS mean_abs_baseline_error, rnd(baseline_rmse, 4) AS baseline_rmse,
       rnd(skill, 4) AS mse_skill_vs_rolling_train_mean, rnd(r2, 4) AS r2, rnd(correlation, 4) AS correlation
FROM metrics JOIN ends p ON p.series_id = predictor_id JOIN ends t ON t.series_id = target_id AND t.e < p.e""",
    "pair_leaderboard": rolling_ctes((1,)) + METRICS_CTE + """, boards AS (
  SELECT 'best_rmse' AS ranking, predictor_id, target_id, rmse AS value, rmse AS key FROM metrics UNION ALL
  SELECT 'worst_rmse', predictor_id, target_id, rmse, -rmse FROM metrics UNION ALL
  SELECT 'best_skill', predictor_id, target_id, skill, -skill FROM metrics UNION ALL
  SELECT 'worst_abs_error', predictor_id, target_id, max_abs_error, -max_abs_error FROM metrics UNION ALL
  SELECT 'highest_spike_score', predictor_id, target_id, latest_spike_score, -latest_spike_score FROM metrics
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY ranking ORDER BY key, predictor_id, target_id) AS INTEGER) AS rank
  FROM boards
)
SELECT ranking, rank, predictor_id, target_id, rnd(value, 4) AS value FROM ranked WHERE rank <= 10""",
    "leakage_check": rolling_ctes((1,)) + """
SELECT predictor_id, target_id, count(*) AS n_rows,
       CAST(count(*) FILTER (WHERE NOT train_end < period) AS BIGINT) AS n_leaking
FROM final GROUP BY ALL""",
    "rolling_interval": rolling_ctes((1,)) + """
SELECT predictor_id, target_id, rnd(avg(abs(y - prediction)), 4) AS mae,
       rnd(avg(CASE WHEN y BETWEEN prediction - 1.2815515655446004 * sigma
                              AND prediction + 1.2815515655446004 * sigma THEN 1.0::DOUBLE ELSE 0 END), 4) AS interval_coverage,
       rnd(avg(2 * 1.2815515655446004 * sigma), 4) AS interval_width
FROM final GROUP BY ALL""",
    "pairwise_ols_lag1": ols_sql((1,)),
    "pairwise_ols_lag0_1": ols_sql((0, 1)),
    "pairwise_ols_matrix_lag1": ols_matrix_sql((1,)),
    "pairwise_ols": ols_matrix_sql((0, 1, 2, 3, 4)),
}
