"""Supervised panels: lag features, spike labels, direct-forecast features, lookback windows, calendars.

All of these run on rolled-up series, so the calendar bounds the rows of one series; tables stay long
(series, period, feature) until a model needs them wide.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import PanelConfig, SpikeConfig
from .frames import ordered, positive_lags, replicated, salted
from .rollup import period_grid, roll_up

SALTS = 16


def lag_rows(grid: DataFrame, lags: Sequence[int]) -> DataFrame:
    """(series_id, role, period, feature, lag, value): every lag of every series on the shared period grid."""
    w = ordered(["series_id"], ["period"])
    wide = grid.select("series_id", "role", "period", *[
        (F.lag("value", k).over(w) if k else F.col("value")).alias(f"_lag{k}") for k in lags])
    cells = F.array(*[F.struct(F.lit(int(k)).alias("lag"), F.col(f"_lag{k}").alias("value")) for k in lags])
    return (wide.select("series_id", "role", "period", F.explode(cells).alias("c"))
            .select("series_id", "role", "period", S.feature_name("series_id", "c.lag").alias("feature"),
                    "c.lag", "c.value"))


def target_features(series: DataFrame, cfg: PanelConfig = PanelConfig(), own_lags: bool = False) -> DataFrame:
    """Long panel of all targets: (target_id, period, target, feature, value), values NULL where missing.

    Every target meets every predictive feature on the periods it was observed: that is the panel. The
    join key is the period, salted by feature. own_lags adds each target's own lags as features.
    """
    rolled = roll_up(series, cfg.freq, cfg.aggregation)
    grid = period_grid(rolled)
    lags = positive_lags(cfg.lags) if own_lags else list(cfg.lags)
    rows = lag_rows(grid, lags).select("series_id", "role", "period", "feature", "value")
    targets = rolled.where(F.col("role") == "predicted").select(
        F.col("series_id").alias("target_id"), "period", F.col("value").alias("target"))
    shared = salted(rows.where(F.col("role") == "predictive"), "feature", SALTS).drop("role", "series_id")
    panel = replicated(targets, SALTS).join(shared, ["period", "_salt"]).select(
        "target_id", "period", "target", "feature", "value")
    if own_lags:
        own = rows.where(F.col("role") == "predicted").select(
            F.col("series_id").alias("target_id"), "period", "feature", "value")
        panel = panel.unionByName(targets.join(own, ["target_id", "period"]).select(
            "target_id", "period", "target", "feature", "value"))
    return panel


def feature_coverage(panel: DataFrame, keys: Sequence[str] = ("target_id", "feature")) -> DataFrame:
    """Share of a feature's rows that are filled."""
    return panel.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_filled"),
        (F.count("value") / F.count(F.lit(1))).alias("coverage"))


def dense_features(panel: DataFrame, minimum: float = 0.2, keys: Sequence[str] = ("target_id", "feature")) -> DataFrame:
    """Rows of the features filled often enough: coverage is aggregated, then a semi-join."""
    keep = feature_coverage(panel, keys).where(F.col("coverage") >= minimum).select(*keys)
    return panel.join(keep, list(keys), "left_semi")


def lag_panel(series: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    return dense_features(target_features(series, cfg), cfg.min_coverage)


def widen(panel: DataFrame, index: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long panel to one column per feature, for a model fit."""
    return panel.groupBy(*index).pivot("feature", list(features)).agg(F.first("value"))


# ---- spike labels -------------------------------------------------------------

def spike_rows(series: DataFrame, cfg: SpikeConfig = SpikeConfig()) -> DataFrame:
    """Per target, horizon and period: smoothed value, peak of the next `horizon` periods and their end.

    All horizons are computed on one sort; rows whose future is incomplete are dropped.
    """
    rolled = roll_up(series, cfg.freq, cfg.aggregation)
    grid = period_grid(rolled).where(F.col("role") == "predicted").select(
        F.col("series_id").alias("target_id"), "period", F.col("value").alias("target_value"))
    w = ordered(["target_id"], ["period"])
    smooth = grid.withColumn("target_smoothed", F.avg("target_value").over(w.rowsBetween(-(cfg.smoothing - 1), 0)))
    futures = F.array(*[
        F.struct(F.lit(int(h)).alias("horizon"),
                 F.max("target_smoothed").over(w.rowsBetween(1, h)).alias("future_peak"),
                 F.lead("period", h).over(w).alias("future_window_end")) for h in cfg.horizons])
    return (smooth.withColumn("_f", futures).select("target_id", "period", "target_value", "target_smoothed",
                                                    F.explode("_f").alias("_f"))
            .select("target_id", "_f.horizon", "period", "target_value", "target_smoothed", "_f.future_peak",
                    "_f.future_window_end")
            .dropna(subset=["future_peak", "future_window_end"]))


def label_spikes(split: DataFrame, cfg: SpikeConfig = SpikeConfig(),
                 keys: Sequence[str] = ("target_id", "horizon")) -> DataFrame:
    """Threshold and scale from the training rows only, then spike, severity score and band.

    percentile() is exact; a key holds at most one row per period.
    """
    w = Window.partitionBy(*keys)
    x = F.when(F.col("split") == "train", F.col("target_smoothed"))
    iqr = F.percentile(x, F.lit(0.75)).over(w) - F.percentile(x, F.lit(0.25)).over(w)
    sd = F.stddev_samp(x).over(w)
    scaled = split.select(
        "*", F.percentile(x, F.lit(cfg.threshold_quantile)).over(w).alias("spike_threshold"),
        F.when(iqr > 0, iqr).when(sd > 0, sd).otherwise(1.0).alias("severity_scale"))
    score = F.greatest(F.lit(0.0), (F.col("future_peak") - F.col("spike_threshold")) / F.col("severity_scale"))
    return (scaled.withColumn("spike", (F.col("future_peak") >= F.col("spike_threshold")).cast("int"))
            .withColumn("severity_score", score)
            .withColumn("severity_band", S.severity_band("severity_score", cfg.cutpoints)))


# ---- direct forecast ------------------------------------------------------------

def direct_features(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], target: str, horizon: int = 14,
                    lags: Sequence[int] = (1, 3, 7, 14), windows: Sequence[int] = (7, 14)) -> DataFrame:
    """Target `horizon` rows ahead with, per column, today's value, lags and past-only means.

    A past-only mean needs all its rows. One select, so one sort serves every column.
    """
    w = ordered(keys, [order])
    added: list[Column] = [F.lead(target, horizon).over(w).alias("y_raw"),
                           F.log1p(F.lead(target, horizon).over(w)).alias("y")]
    for c in columns:
        added.append(F.col(c).alias(f"{c}_t"))
        added += [F.lag(c, k).over(w).alias(f"{c}_lag{k}") for k in lags]
        for size in windows:
            past = w.rowsBetween(-size, -1)
            added.append(F.when(F.count(c).over(past) == size, F.avg(c).over(past)).alias(f"{c}_roll{size}"))
    return df.select("*", *added)


def forward_fill(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Missing values take the last one seen before them."""
    w = ordered(keys, [order]).rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.last(c, ignorenulls=True).over(w) for c in columns}
    return df.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def lookback_windows(df: DataFrame, keys: Sequence[str], order: str, features: Sequence[str], target: str,
                     lookback: int, horizon: int, train_to: float = 0.70, valid_to: float = 0.85) -> DataFrame:
    """Samples of the last `lookback` feature rows with the target `horizon` rows after the newest one.

    The split goes by the row of the label. Rows of a key are bounded by the calendar.
    """
    w = ordered(keys, [order])
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = df.select(
        *keys, F.col(order), F.row_number().over(w).alias("_i"), n.alias("_n"),
        F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(
            w.rowsBetween(-(lookback - 1), 0)).alias("x"),
        F.lead(target, horizon).over(w).alias("label"), F.lead(order, horizon).over(w).alias("label_at"))
    label_row = F.col("_i") + horizon
    split = (F.when(label_row <= F.floor(F.col("_n") * F.lit(train_to)), "train")
             .when(label_row <= F.floor(F.col("_n") * F.lit(valid_to)), "valid").otherwise("test"))
    return rows.where((F.col("_i") >= lookback) & (label_row <= F.col("_n"))).select(
        *keys, F.col(order).alias("window_end"), "x", "label", "label_at", split.alias("split"))


# ---- calendars --------------------------------------------------------------------

def daily_spine(bounds: DataFrame, start: str = "start", end: str = "end", name: str = "date") -> DataFrame:
    """One row per day between the bounds of each row."""
    rest = [c for c in bounds.columns if c not in (start, end)]
    days = F.sequence(F.col(start).cast("date"), F.col(end).cast("date"), F.expr("interval 1 day"))
    return bounds.select(*rest, F.explode(days).alias(name))


def season_columns(df: DataFrame, date: str = "date") -> DataFrame:
    """ISO week and its sine and cosine on a 52-week year."""
    week = F.weekofyear(date)
    angle = F.lit(6.283185307179586) * week / F.lit(52)
    return df.select("*", week.alias("week_of_year"), F.sin(angle).alias("sin_week"), F.cos(angle).alias("cos_week"))


def future_periods(last: DataFrame, period: str, horizon: int, freq: str = "W") -> DataFrame:
    """The next `horizon` periods after each row's last one, with their step."""
    return last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "period", S.step_period(period, "step", freq))


def month_dummies(df: DataFrame, date: str, keys: Sequence[str] = (), prefix: str = "month") -> tuple[DataFrame, list[str]]:
    """0/1 columns for the months seen, first one dropped; which months occur is asked of the data (at most twelve)."""
    months = sorted(r[0] for r in df.select(F.month(date)).where(F.col(date).isNotNull()).distinct().collect())
    names = [f"{prefix}_{m}" for m in months[1:]]
    return df.select("*", *[(F.month(date) == m).cast("double").alias(n) for m, n in zip(months[1:], names)]), names


# ---- model input ------------------------------------------------------------------

def attach_features(rows: DataFrame, grid: DataFrame, lags: Sequence[int], own: bool = True) -> DataFrame:
    """rows (target_id, period, ...) with every predictive lag feature, and with the target's own lags."""
    lagged = lag_rows(grid, positive_lags(lags))
    shared = salted(lagged.where(F.col("role") == "predictive").select("period", "feature", "value"), "feature", SALTS)
    out = replicated(rows, SALTS).join(shared, ["period", "_salt"]).drop("_salt")
    if own:
        mine = lagged.where(F.col("role") == "predicted").select(
            F.col("series_id").alias("target_id"), "period", "feature", "value")
        out = out.unionByName(rows.join(mine, ["target_id", "period"]).select(*out.columns))
    return out


def impute_and_scale(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """x: the value, or the training median where missing, scaled by training mean and deviation.

    Features without any training value are dropped. A (key, feature) group holds one row per period.
    """
    w = Window.partitionBy(*keys, "feature")
    train = F.col("split") == "train"
    filled = panel.select("*", F.coalesce("value", F.percentile(F.when(train, F.col("value")), F.lit(0.5)).over(w)).alias("_f"))
    stats = filled.select("*", F.count(F.when(train, F.col("value"))).over(w).alias("_n"),
                        F.avg(F.when(train, F.col("_f"))).over(w).alias("_m"),
                        F.stddev_pop(F.when(train, F.col("_f"))).over(w).alias("_s"))
    return stats.where(F.col("_n") > 0).select(
        *panel.columns, ((F.col("_f") - F.col("_m")) / S.train_scale("_s")).alias("x"))


def pack(panel: DataFrame, index: Sequence[str], raw: bool = False) -> DataFrame:
    """One row per index with x as an array in the order of the feature names; raw adds the values as they were, NULL where missing."""
    cells = F.sort_array(F.collect_list(F.struct("feature", "x", *(["value"] if raw else []))))
    return panel.groupBy(*index).agg(cells.alias("_c")).select(
        *index, F.transform("_c", lambda c: c["x"]).alias("x"), *([F.transform("_c", lambda c: c["value"]).alias("raw")] if raw else []))
