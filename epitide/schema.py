"""Table schemas and run settings."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_S, _D = T.StringType(), T.DoubleType()

CANONICAL = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("value", _D, False),
    T.StructField("series_id", _S),
    T.StructField("role", _S),
    T.StructField("dataset_family", _S),
    T.StructField("series_name", _S),
    T.StructField("source_file", _S),
])

SITE_LONG = T.StructType([
    T.StructField("country", _S),
    T.StructField("source", _S),
    T.StructField("pathogen", _S),
    T.StructField("date", T.DateType()),
    T.StructField("site_id", _S),
    T.StructField("site_name", _S),
    T.StructField("geography_level", _S),
    T.StructField("region", _S),
    T.StructField("value", _D),
    T.StructField("value_unit", _S),
    T.StructField("population", _D),
    T.StructField("normalised_value", _D),
    T.StructField("normalised_unit", _S),
    T.StructField("source_file", _S),
])

SIGNALS = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("value", _D),
    T.StructField("source", _S),
    T.StructField("pathogen", _S),
    T.StructField("role", _S),
    T.StructField("signal_type", _S),
    T.StructField("metric", _S),
    T.StructField("geography_name", _S),
    T.StructField("geography_code", _S),
])

REGISTRY = T.StructType([
    T.StructField(n, _S)
    for n in ("name", "pathogen", "description", "role", "url", "catalog_slug", "google_trends_term",
              "google_trends_geo", "google_trends_timeframe", "google_trends_local_file")
])

ROLES = ("predictive", "predicted")


@dataclass(frozen=True)
class PanelConfig:
    """How series are rolled up, lagged and pruned before modelling."""

    freq: str = "W"
    lags: tuple[int, ...] = (1, 2, 3, 4)
    aggregation: str = "mean"
    min_coverage: float = 0.2


@dataclass(frozen=True)
class BacktestConfig:
    """Expanding-origin backtest of every predictor against every target."""

    freq: str = "W"
    lags: tuple[int, ...] = (1, 2, 3, 4)
    aggregation: str = "mean"
    initial_train_fraction: float = 0.6
    min_train_size: int = 12
    alpha: float = 1.0
    spike_quantile: float = 0.9
    x_scale: str = "sample"
    scale_y: bool = True


@dataclass(frozen=True)
class SpikeConfig:
    """Spike labels, severity scale and the models fitted on them."""

    freq: str = "W"
    lags: tuple[int, ...] = (1, 2, 3, 4, 6, 8, 12)
    horizons: tuple[int, ...] = (1, 2, 3, 4)
    aggregation: str = "mean"
    min_coverage: float = 0.2
    smoothing: int = 3
    threshold_quantile: float = 0.85
    cutpoints: tuple[float, float, float] = (0.25, 1.0, 2.0)
    interval_level: float = 0.80
    decision_threshold: float = 0.50
    hidden: tuple[int, ...] = (64, 32)
    max_iter: int = 100
    n_bootstrap: int = 25
    min_train_rows: int = 24
    min_test_rows: int = 4
    train_fraction: float = 0.8
