"""Spike early warning: labels, a classifier per target and horizon, and a severity ensemble with intervals."""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.networks import predict
from ..functions.networks import train as train_network
from ..operators import features as X
from ..operators.metrics import classification_metrics, ensemble_summary, interval_metrics
from ..operators.rollup import period_grid, roll_up, rolled_series
from ..operators.splits import chronological_split, purge_crossing_labels
from ..schema import SpikeConfig
from ..session import stage
from .models import by_group, chosen_text, matrix

KEYS = ["target_id", "horizon"]
PART = 5  # members of the severity ensemble that one task trains
VALUE = "target_id string, horizon int, period date, member int, value double, classifier string, error string"


def labelled(series: DataFrame, cfg: SpikeConfig = SpikeConfig()) -> DataFrame:
    """Split, purged and labelled rows of every target and horizon."""
    rows = X.spike_rows(series, cfg)
    split = chronological_split(rows, KEYS, "period", cfg.train_fraction, cfg.min_test_rows)
    purged = purge_crossing_labels(split.where(F.col("split").isNotNull()), KEYS).drop("n_rows", "row_index")
    return X.label_spikes(purged, cfg)


def spike_inputs(series: DataFrame, labels: DataFrame, cfg: SpikeConfig = SpikeConfig()) -> DataFrame:
    """Labelled rows with x, the imputed and scaled features in one array."""
    grid = period_grid(roll_up(series, cfg.freq, cfg.aggregation))
    index = [*KEYS, "period", "split", "spike", "severity_score"]
    panel = X.attach_features(labels.select(*index), grid, cfg.lags)
    dense = X.dense_features(panel, cfg.min_coverage, (*KEYS, "feature"))
    return X.pack(X.impute_and_scale(dense, KEYS), index)


def run_gate(inputs: DataFrame, cfg: SpikeConfig) -> DataFrame:
    """One row per target and horizon: sizes, classes seen, and whether it can be fitted."""
    train = F.col("split") == "train"
    sizes = inputs.groupBy(*KEYS).agg(
        F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"), F.max(F.size("x")).alias("n_features"),
        F.avg(F.when(train, F.col("spike"))).alias("train_spike_rate"), F.avg(F.when(~train, F.col("spike"))).alias("test_spike_rate"),
        *[f(F.when(F.col("split") == s, F.col("period"))).alias(f"{s}_{end}")
          for s in ("train", "test") for end, f in (("start", F.min), ("end", F.max))])
    small = (F.col("n_train") < cfg.min_train_rows) | (F.col("n_test") < cfg.min_test_rows)
    return sizes.withColumn("status", F.when(small, "skipped").otherwise("ok")).withColumn(
        "error", F.when(small, F.format_string("Too few rows after split: train=%d, test=%d", "n_train", "n_test")).otherwise(""))


def network_values(inputs: DataFrame, cfg: SpikeConfig = SpikeConfig(), seed: int = 42) -> DataFrame:
    """(target_id, horizon, period, member, value, classifier) of the test rows: member 0 is the chance of a spike, the others severities.

    A task trains the classifier or PART members of the severity ensemble of one target and horizon on its rows, at most one per
    period; members are trained on rows drawn with replacement. With one class in training the chance is its rate.
    """
    parts = 1 + -(-cfg.n_bootstrap // PART)
    tasked = inputs.select(*KEYS, "period", "split", "spike", "severity_score", "x").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def fit(key, table):
        train = chosen_text(table["split"], "train")
        x = matrix(table["x"])
        periods, kind = table["period"].filter(pa.array(~train)).to_pylist(), None
        label, score = (table[c].to_numpy().astype(float)[train] for c in ("spike", "severity_score"))
        place = [seed, zlib.crc32(key["target_id"].encode()), key["horizon"]]
        members, values = [], []
        if key["part"] == 0:
            kind = "constant_single_class"
            chance = np.full(len(periods), label.mean())
            if 0 < label.mean() < 1:
                kind = "mlp_classifier"
                chance = predict(train_network(x[train], label, cfg.hidden, cfg.max_iter, np.random.default_rng([*place, 0]), True), x[~train], True)
            members, values = [0], [chance]
        else:
            for member in range((key["part"] - 1) * PART + 1, min(key["part"] * PART, cfg.n_bootstrap) + 1):
                rng = np.random.default_rng([*place, member])
                drawn = rng.integers(0, len(score), len(score))
                net = train_network(x[train][drawn], score[drawn], cfg.hidden, cfg.max_iter, rng, False)
                members.append(member)
                values.append(np.maximum(0.0, predict(net, x[~train], False)))
        n = len(periods)
        return {"period": periods * len(members), "member": np.repeat(members, n).astype(np.int32), "value": np.concatenate(values), "classifier": [kind] * n * len(members)}
    return by_group(tasked, [*KEYS, "part"], VALUE, fit)


def spike_experiment(series: DataFrame, cfg: SpikeConfig = SpikeConfig(), seed: int = 42,
                     targets: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, predictions) over all targets and horizons; keys with too few rows are skipped rows."""
    series = rolled_series(series, cfg.freq, cfg.aggregation)
    labels = labelled(series, cfg)
    if targets is not None:
        labels = labels.where(F.col("target_id").isin(list(targets)))
    inputs = stage(spike_inputs(series, labels, cfg), "spike-inputs")
    gate = run_gate(inputs, cfg)
    ready = gate.where(F.col("status") == "ok")
    usable = inputs.join(ready.select(*KEYS), KEYS, "left_semi")
    values = stage(network_values(usable, cfg, seed), "spike-values")
    chances = values.where("member = 0").select(*KEYS, "period", S.clip01("value").alias("spike_probability"), "classifier")
    bands = ensemble_summary(values.where("member > 0"), [*KEYS, "period"], "value", cfg.interval_level).select(
        *KEYS, "period", F.col("prediction").alias("predicted_severity_score"),
        F.col("lower").alias("severity_score_lower"), F.col("upper").alias("severity_score_upper"))
    failed = values.where("error IS NOT NULL").groupBy(*KEYS).agg(F.max("error").alias("_failed"))
    gate = gate.join(failed, KEYS, "left").withColumns({
        "status": F.when(F.col("_failed").isNotNull(), "error").otherwise(F.col("status")), "error": F.coalesce("_failed", "error")}).drop("_failed")
    test = labels.where(F.col("split") == "test").join(chances, [*KEYS, "period"]).join(bands, [*KEYS, "period"])
    predictions = test.select(
        "*", (F.col("spike_probability") >= cfg.decision_threshold).cast("int").alias("predicted_spike"),
        S.severity_band("predicted_severity_score", cfg.cutpoints).alias("predicted_severity_band"),
        S.severity_band("severity_score_lower", cfg.cutpoints).alias("severity_band_lower"),
        S.severity_band("severity_score_upper", cfg.cutpoints).alias("severity_band_upper"),
        F.lit(cfg.interval_level).alias("interval_level"))
    classes = classification_metrics(predictions, KEYS, "spike", "spike_probability", cfg.decision_threshold).drop("n", "n_positive")
    severity = interval_metrics(predictions, KEYS, "severity_score", "predicted_severity_score", "severity_score_lower",
                                "severity_score_upper", "severity_")
    fixed = predictions.groupBy(*KEYS).agg(F.max("spike_threshold").alias("spike_threshold"),
                                           F.max("severity_scale").alias("severity_scale"), F.max("classifier").alias("classifier"))
    results = (gate.join(classes, KEYS, "left").join(severity, KEYS, "left").join(fixed, KEYS, "left")
               .withColumn("severity_model", F.when(F.col("status") == "ok", f"bootstrap_mlp_regressor_{cfg.n_bootstrap}")))
    return results, predictions
