"""Forecasts past the last observation, for many targets at once."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import normal_quantile, ridge_cv
from ..functions.scalars import step_period
from ..operators.frames import ordered, positive_lags
from ..operators.metrics import ensemble_summary
from ..operators.pairs import PAIR, fit_inputs, fit_line, lag_columns, line_at, meet, sides
from ..operators.rollup import period_grid, roll_up, rolled_series
from ..schema import BacktestConfig, PanelConfig
from ..operators.ranks import NUMBER, fan_out, numbered
from ..session import stage
from .backtest import pair_predictions

OUTPUT = ["period", "actual", "prediction", "lower", "upper", "is_forecast"]


def leading_candidates(catalogue: DataFrame) -> DataFrame:
    """Predictive series that end after a target does: a join on an inequality between two columns of the catalogue (one row per series).

    Targets are numbered by their end. Those that end before a predictor does are the first ones, up to a number that follows
    from the counts of targets by end date, which the calendar bounds; the predictor fans out to exactly these numbers.
    """
    x = catalogue.where(F.col("role") == "predictive").select(
        F.col("series_id").alias("predictor_id"), F.col("date_max").alias("predictor_end"))
    y = catalogue.where((F.col("role") == "predicted") & F.col("date_max").isNotNull()).select(
        F.col("series_id").alias("target_id"), F.col("date_max").alias("target_end"))
    places = numbered(y, F.struct("target_end", "target_id"))
    ends = places.groupBy("target_end").agg(F.max(NUMBER).alias("upto")).agg(F.collect_list(F.struct("target_end", "upto"))).scalar()
    before = F.array_max(F.transform(F.filter("_ends", lambda e: e["target_end"] < F.col("predictor_end")), lambda e: e["upto"]))
    return fan_out(x.withColumn("_ends", ends).withColumn("_before", before).drop("_ends"), places, F.col("_before")).drop("_before")


def future_rows(x: DataFrame, ends: DataFrame, names: list[str], horizon: int) -> DataFrame:
    """First `horizon` complete predictor rows after each target's end. ends has pairs and target_end."""
    ahead = x.join(ends, "predictor_id").where(F.col("period") > F.col("target_end")).dropna(subset=names)
    step = F.row_number().over(ordered(PAIR, ["period"]))
    return ahead.withColumn("step", step).where(F.col("step") <= horizon)


def requested_pairs(series: DataFrame, requests: DataFrame) -> DataFrame:
    """The series that the requested pairs need."""
    ids = requests.select(F.explode(F.array("predictor_id", "target_id")).alias("series_id")).where(
        F.col("series_id").isNotNull()).distinct()
    return series.join(ids, "series_id", "left_semi")


def leading_forecast(series: DataFrame, horizon: int, requests: DataFrame | None = None,
                     cfg: BacktestConfig = BacktestConfig(), level: float = 0.80,
                     history: bool = True) -> DataFrame:
    """Forecast rows of every pair (or the requested ones) whose predictor runs past the target's end.

    Lags are taken before the join here: the fit uses every paired row at once, and one set of sums per pair
    is all it needs. With history, the backtest's predictions come first, without an interval.
    """
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    lags = positive_lags(cfg.lags)
    names = [f"x_lag{k}" for k in lags]
    if requests is not None:
        series = requested_pairs(series, requests)
    x, y = sides(series, cfg.freq, cfg.aggregation)
    x = x.select("predictor_id", "period", *lag_columns("x", lags, ordered(["predictor_id"], ["period"])))
    joined = meet(x, y)
    if requests is not None:
        joined = joined.join(requests.select(*PAIR).distinct(), PAIR, "left_semi")
    full = F.col(names[0]).isNotNull()
    for n in names[1:]:
        full = full & F.col(n).isNotNull()
    origin = joined.groupBy("target_id").agg(F.min_by("y", "period").alias("_y0"))
    x0 = x.groupBy("predictor_id").agg(*[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("period"))).alias(f"_0{n}") for n in names])
    centred = joined.join(origin, "target_id").join(x0, "predictor_id")
    cx = [F.col(n) - F.col(f"_0{n}") for n in names]
    fits = centred.groupBy(*PAIR, "_y0", *[f"_0{n}" for n in names]).agg(
        fit_inputs(cx, F.col("y") - F.col("_y0"), where=full).alias("_sums"), F.count_if(full).alias("n_paired"),
        F.count(F.lit(1)).alias("n_joined"))
    # The backtest lags after the join, which costs a pair its first max(lags) rows: it needs that many more.
    enough = max(3, cfg.min_train_size + 1)
    fits = fits.where((F.col("n_paired") >= enough) & (F.col("n_joined") - max(lags) >= enough)).withColumn(
        "_fit", fit_line(F.col("_sums"), len(lags), cfg.alpha, cfg.x_scale, cfg.scale_y)).drop("_sums")
    ends = y.groupBy("target_id").agg(F.max("period").alias("target_end"))
    ahead = future_rows(x, fits.select(*PAIR).join(ends, "target_id"), names, horizon)
    z = normal_quantile(0.5 + level / 2.0)
    value = line_at(F.col("_fit"), cx) + F.col("_y0")
    out = ahead.join(fits, PAIR).select(
        *PAIR, "period", F.lit(None).cast("double").alias("actual"), value.alias("prediction"),
        (value - F.lit(z) * F.col("_fit.sigma")).alias("lower"), (value + F.lit(z) * F.col("_fit.sigma")).alias("upper"),
        F.lit(True).alias("is_forecast"))
    if not history:
        return out
    out = stage(out, "leading")  # a few rows per pair, read twice
    missing = F.lit(None).cast("double")
    past = pair_predictions(series, cfg, spikes=False).join(out.select(*PAIR).distinct(), PAIR, "left_semi").select(
        *PAIR, "period", "actual", "prediction", missing.alias("lower"), missing.alias("upper"), F.lit(False).alias("is_forecast"))
    return past.unionByName(out)


# ---- autoregressive -----------------------------------------------------------------

def ar_rows(series: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """(target_id, period, target, x array of own lags, row_index, n_rows): complete rows on the shared grid."""
    lags = positive_lags(cfg.lags)
    grid = period_grid(roll_up(series, cfg.freq, cfg.aggregation)).where(F.col("role") == "predicted")
    w = ordered(["series_id"], ["period"])
    rows = grid.select(F.col("series_id").alias("target_id"), "period", F.col("value").alias("target"),
                       *[F.lag("value", k).over(w).alias(f"_l{k}") for k in lags]).dropna()
    by = ordered(["target_id"], ["period"])
    return rows.select("target_id", "period", "target", F.array(*[f"_l{k}" for k in lags]).alias("x"),
                       F.row_number().over(by).alias("row_index"),
                       F.count(F.lit(1)).over(Window.partitionBy("target_id")).alias("n_rows"))


def bootstrap(rows: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """Rows with weights per replicate: n draws with replacement out of the n rows of each key.

    Draw i of replicate r picks row hash(key, r, i) mod n, so samples do not depend on partitioning.
    """
    draws = rows.select(*keys, "row_index", "n_rows", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    pick = F.pmod(F.xxhash64(*keys, "replicate", "row_index", F.lit(seed)), F.col("n_rows")) + 1
    weights = draws.groupBy(*keys, "replicate", pick.cast("int").alias("row_index")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"))
    return weights.join(rows, [*keys, "row_index"])


def _walk(lags: list[int], horizon: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_index")
        intercept, slope = ridge_cv(np.stack(pdf["x"].to_numpy()), pdf["target"].to_numpy(), pdf["weight"].to_numpy())
        values = list(pdf["recent"].iloc[0])
        path = []
        for _ in range(horizon):
            path.append(intercept + sum(b * values[-k] for b, k in zip(slope, lags)))
            values.append(path[-1])
        return pd.DataFrame({"target_id": pdf["target_id"].iloc[0], "replicate": pdf["replicate"].iloc[0],
                             "step": range(1, horizon + 1), "value": path})
    return fit


def ar_forecast(series: DataFrame, horizon: int, cfg: PanelConfig = PanelConfig(), level: float = 0.80,
                replicates: int = 25, seed: int = 42, min_train: int = 12, targets: DataFrame | None = None) -> DataFrame:
    """Recursive forecasts of every target from its own lags, with a bootstrap interval, after its history.

    One task fits one replicate of one target: a group is at most one row per period.
    """
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    lags = positive_lags(cfg.lags)
    rows = ar_rows(series, cfg).where(F.col("n_rows") >= min_train)
    history = roll_up(series.where(F.col("role") == "predicted"), cfg.freq, cfg.aggregation).select(
        F.col("series_id").alias("target_id"), "period", F.col("value").alias("actual"))
    if targets is not None:
        rows, history = (d.join(targets.select("target_id").distinct(), "target_id", "left_semi") for d in (rows, history))
    place = F.row_number().over(Window.partitionBy("target_id").orderBy(F.col("period").desc()))
    recent = history.withColumn("_r", place).where(F.col("_r") <= max(lags)).groupBy("target_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("period", "actual"))), lambda e: e["actual"]).alias("recent"),
        F.max("period").alias("last_period"))
    sample = bootstrap(rows, ["target_id"], replicates, seed).join(recent, "target_id")
    paths = sample.groupBy("target_id", "replicate").applyInPandas(
        _walk(lags, horizon), "target_id string, replicate int, step int, value double")
    bands = ensemble_summary(paths, ["target_id", "step"], "value", level).join(recent, "target_id")
    missing = F.lit(None).cast("double")
    ahead = bands.select("target_id", step_period("last_period", "step", cfg.freq).alias("period"), missing.alias("actual"),
                         "prediction", "lower", "upper", F.lit(True).alias("is_forecast"))
    past = history.join(rows.select("target_id").distinct(), "target_id", "left_semi").select(
        "target_id", "period", "actual", missing.alias("prediction"), missing.alias("lower"), missing.alias("upper"),
        F.lit(False).alias("is_forecast"))
    return past.unionByName(ahead)


def forecast_targets(series: DataFrame, requests: DataFrame, horizon: int, cfg: PanelConfig = PanelConfig(),
                     level: float = 0.80, replicates: int = 25, seed: int = 42) -> DataFrame:
    """Forecasts for requests (target_id, predictor_id or NULL): the leading indicator where it works, else the
    target's own history, with the strategy and the reason for falling back."""
    series = rolled_series(series, cfg.freq, cfg.aggregation)
    wanted = requests.select("target_id", "predictor_id")
    asked = wanted.where(F.col("predictor_id").isNotNull())
    back = BacktestConfig(freq=cfg.freq, lags=cfg.lags, aggregation=cfg.aggregation)
    led = stage(leading_forecast(series, horizon, asked, back, level), "leading")  # read three times below
    worked = led.where("is_forecast").select(*PAIR).distinct().withColumn("_ok", F.lit(True))
    plan = wanted.join(worked, PAIR, "left")
    fallback = plan.where(F.col("_ok").isNull()).select("target_id", F.col("predictor_id").alias("requested_predictor_id"))
    own = ar_forecast(series, horizon, cfg, level, replicates, seed, targets=fallback)
    reason = F.when(F.col("requested_predictor_id").isNotNull(),
                    "the predictor has too little shared history or no rows after the target's last period")
    first = led.select(
        "target_id", F.lit("leading_indicator").alias("strategy"), "predictor_id",
        F.lit(None).cast("string").alias("requested_predictor_id"), F.lit(None).cast("string").alias("fallback_reason"), *OUTPUT)
    second = own.join(fallback, "target_id").select(
        "target_id", F.lit("autoregressive").alias("strategy"), F.lit(None).cast("string").alias("predictor_id"),
        "requested_predictor_id", reason.alias("fallback_reason"), *OUTPUT)
    return first.unionByName(second)
