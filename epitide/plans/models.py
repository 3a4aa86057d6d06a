"""Model comparison per target: all targets and models in one plan.

The panel of all targets is built, imputed and scaled once and packed, one row for each target and period. A task fits one model of one
target, or some of the trees of a forest; a target has at most one row per period, so the calendar bounds what a task holds.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linear import LINES
from ..functions.trees import TreeShape, boost, forest
from ..operators.features import dense_features, impute_and_scale, pack, target_features
from ..operators.metrics import regression_metrics
from ..operators.rollup import rolled_series
from ..operators.splits import chronological_split
from ..schema import PanelConfig
from ..session import stage

# Display names of the models.
MODEL_NAMES = {
    "Ordinary least squares": "ols",
    "Ridge (cross-validated)": "ridge",
    "Elastic net (cross-validated)": "elastic_net",
    "Random forest": "random_forest",
    "Histogram gradient boosting": "hist_gradient_boosting",
}

PART_TREES = 25  # trees of a forest that one task grows
BOOSTED = TreeShape(leaves=31, least_rows=20, square=1.0)
LINE = "target_id string, model string, penalty double, mix double, intercept double, slopes array<double>, error string"
VALUE = "target_id string, model string, period date, prediction double, weight double, error string"


def model_rows(series: DataFrame, cfg: PanelConfig = PanelConfig(), train_fraction: float = 0.8, min_test: int = 4,
               predictors: Sequence[str] | None = None, targets: Sequence[str] | None = None) -> DataFrame:
    """(target_id, period, target, split, x, raw) of all targets: split first, then scaled by training rows; raw is neither filled nor scaled."""
    if predictors is not None:
        series = series.where((F.col("role") == "predicted") | F.col("series_id").isin(list(predictors)))
    panel = dense_features(target_features(rolled_series(series, cfg.freq, cfg.aggregation), cfg), cfg.min_coverage)
    if targets is not None:
        panel = panel.where(F.col("target_id").isin(list(targets)))
    periods = panel.select("target_id", "period").distinct()
    split = chronological_split(periods, ["target_id"], "period", train_fraction, min_test).where(F.col("split").isNotNull())
    scaled = impute_and_scale(panel.join(split.drop("n_rows", "row_index"), ["target_id", "period"]), ["target_id"])
    return pack(scaled, ["target_id", "period", "target", "split"], raw=True)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long lists as a matrix; NULL becomes NaN."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def chosen_text(column: pa.ChunkedArray, value: str) -> np.ndarray:
    return np.array([v == value for v in column.to_pylist()])


def by_group(rows: DataFrame, keys: Sequence[str], ddl: str, fit: Callable[[dict, pa.Table], dict]) -> DataFrame:
    """One fit for each group: fit(keys, rows by period) gives columns. A fit that fails is one row with its error."""
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(key, table):
        given = dict(zip(keys, (k.as_py() for k in key), strict=True))
        try:
            columns = fit(given, table.sort_by("period"))
            n = len(next(iter(columns.values())))
            columns |= {"error": [None] * n}
        except Exception as exc:
            columns, n = {"error": [repr(exc)]}, 1
        empty = [None] * n
        return pa.table({c: pa.array(columns.get(c, [given[c]] * n if c in given else empty), type=KINDS[t]) for c, t in
                         (part.split(maxsplit=1) for part in ddl.split(", "))}).select(names)
    return rows.groupBy(*keys).applyInArrow(run, ddl)


KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "date": pa.date32(), "array<double>": pa.list_(pa.float64())}


def with_models(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return rows.withColumn("model", F.explode(F.array(*[F.lit(n) for n in names])))


def linear_fits(rows: DataFrame, models: Sequence[str] = tuple(LINES)) -> DataFrame:
    """One line per target and model, fitted on the training rows: penalty and mix that were chosen, intercept and slopes by feature order."""
    def fit(key, table):
        line = LINES[key["model"]](matrix(table["x"]), table["target"].to_numpy())
        return {"penalty": [line["penalty"]], "mix": [line["mix"]], "intercept": [line["intercept"]], "slopes": [line["slopes"].tolist()]}
    return by_group(with_models(rows.where(F.col("split") == "train").select("target_id", "period", "target", "x"), models), ["target_id", "model"], LINE, fit)


def at_line(x: str | Column = "x") -> Column:
    """Value of the line of a row at its features."""
    return F.col("intercept") + F.aggregate(F.zip_with(x, "slopes", lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)


def tree_values(rows: DataFrame, models: Sequence[str], trees: int, rounds: int, seed: int) -> DataFrame:
    """Predictions of the test rows. A forest is grown in parts, each weighing as many trees as it has; boosting takes missing values as they are."""
    parts = {"random_forest": -(-trees // PART_TREES), "hist_gradient_boosting": 1}
    tasks = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(p).alias("part")) for m in models for p in range(parts[m])])

    def fit(key, table):
        train = chosen_text(table["split"], "train")
        rng = np.random.default_rng([seed, zlib.crc32(key["target_id"].encode()), key["part"]])
        y = table["target"].to_numpy()[train]
        if key["model"] == "random_forest":
            x, weight = matrix(table["x"]), min(PART_TREES, trees - PART_TREES * key["part"])
            values = forest(x[train], y, x[~train], weight, rng)
        else:
            x, weight = matrix(table["raw"]), 1
            values, _, _ = boost(x[train], y, x[~train], rounds, 0.1, BOOSTED, rng)
        return {"period": table["period"].filter(pa.array(~train)).combine_chunks(), "prediction": values, "weight": np.full(len(values), float(weight))}
    tasked = rows.withColumn("task", F.explode(tasks)).select("target_id", "period", "target", "split", "x", "raw", "task.model", "task.part")
    return by_group(tasked, ["target_id", "model", "part"], VALUE, fit)


def evaluate_models(rows: DataFrame, models: Sequence[str] = tuple(MODEL_NAMES.values()), trees: int = 300, rounds: int = 200,
                    seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(results, predictions) of every model on every target of the packed rows; a fit that fails is a row with status error."""
    unknown = set(models) - set(MODEL_NAMES.values())
    if unknown:
        raise ValueError(f"unknown models: {sorted(unknown)}")
    rows = stage(rows, "model-rows")
    test = rows.where(F.col("split") == "test")
    lines, grown = [m for m in models if m in LINES], [m for m in models if m not in LINES]
    values, errors = [], []
    if lines:
        fits = stage(linear_fits(rows, lines), "model-lines")
        values.append(test.join(fits.where("error IS NULL"), "target_id").select("target_id", "model", "period", at_line().alias("prediction")))
        errors.append(fits.where("error IS NOT NULL").select("target_id", "model", "error"))
    if grown:
        parts = stage(tree_values(rows, grown, trees, rounds, seed), "model-trees")
        values.append(parts.where("error IS NULL").groupBy("target_id", "model", "period").agg(
            (F.sum(F.col("prediction") * F.col("weight")) / F.sum("weight")).alias("prediction")))
        errors.append(parts.where("error IS NOT NULL").groupBy("target_id", "model").agg(F.max("error").alias("error")))
    spans = rows.groupBy("target_id").agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"),
        F.max(F.size("x")).alias("n_features"), F.avg(F.when(F.col("split") == "train", F.col("target"))).alias("baseline_prediction"),
        *[f(F.when(F.col("split") == s, F.col("period"))).alias(f"{s}_{end}")
          for s in ("train", "test") for end, f in (("start", F.min), ("end", F.max))])
    found, failed = values[0], errors[0]
    for more, bad in zip(values[1:], errors[1:], strict=True):
        found, failed = found.unionByName(more), failed.unionByName(bad)
    whole = found.join(failed.select("target_id", "model"), ["target_id", "model"], "left_anti")
    predictions = whole.join(test.select("target_id", "period", F.col("target").alias("actual")), ["target_id", "period"]).join(
        spans.select("target_id", "baseline_prediction"), "target_id").select(
        "target_id", "model", "period", "actual", "prediction", "baseline_prediction", (F.col("actual") - F.col("prediction")).alias("residual"))
    scores = regression_metrics(predictions, ["target_id", "model"], skill="mse_skill_vs_train_mean").withColumns({"status": F.lit("ok"), "error": F.lit("")})
    results = scores.unionByName(failed.withColumn("status", F.lit("error")), allowMissingColumns=True).join(spans.drop("baseline_prediction"), "target_id")
    return results, predictions


def fit_models(series: DataFrame, targets: Sequence[str] | None = None, cfg: PanelConfig = PanelConfig(),
               models: Sequence[str] | None = None, predictors: Sequence[str] | None = None, **sizes):
    """(results, predictions) for some or all targets, models and predictors."""
    return evaluate_models(model_rows(series, cfg, predictors=predictors, targets=targets), models or tuple(MODEL_NAMES.values()), **sizes)


def ranked(results: DataFrame, size: int = 20) -> DataFrame:
    """Best results by skill."""
    return results.where(F.col("status") == "ok").orderBy(
        F.col("mse_skill_vs_train_mean").desc_nulls_last(), "target_id", "model").limit(size)
