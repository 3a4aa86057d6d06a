"""Direct forecast of daily targets some days ahead with boosted trees: one target of a spine, or all of them in one plan."""
from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.trees import TreeShape, boost
from ..operators.features import direct_features
from ..operators.metrics import regression_metrics
from ..operators.profile import usable_features
from ..operators.splits import three_way_split
from ..session import stage
from .models import by_group, chosen_text, matrix

KEY = "_line"
# Shape of a tree, step and shares of rows and columns a tree sees.
SHAPE = TreeShape(depth=3, least_weight=5.0, square=2.0, absolute=0.1)
RATE, ROWS, COLUMNS, PATIENCE = 0.01, 0.8, 0.8, 100
FIT = "target_id string, period date, actual_log double, predicted_log double, rounds bigint, place bigint, importance double, error string"


def feature_blocks(spine: DataFrame, date: str, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The spine with _x, all features in one array, column after column: today's value, lags and past-only means; and the names of one block."""
    line = spine.withColumn(KEY, F.lit(1))
    wide = direct_features(line, [KEY], date, columns, columns[0], 1)
    made = [c for c in wide.columns if c not in line.columns and c not in ("y", "y_raw")]
    per = len(made) // len(columns)
    blocks = [[c, *made[i * per:(i + 1) * per]] for i, c in enumerate(columns)]
    names = [name for block in blocks for name in block]
    return wide.select(*spine.columns, F.array(*[F.col(n).cast("double") for n in names]).alias("_x")), names


def direct_panel(spine: DataFrame, date: str, targets: Sequence[str], base: Sequence[str] | None = None, horizon: int = 14) -> tuple[DataFrame, list[str]]:
    """(target_id, period, x, own, y, split) of every target, and the names of all features.

    A spine is one line of days; its features are made once, in one sort. x leaves out the columns of the target itself unless base names
    them: own is where they would begin, -1 if they are in.
    """
    columns = usable_features(spine.drop(date), base)
    if base is None and len(targets) == 1:
        columns = [c for c in columns if c != targets[0]]
    if not columns:
        raise ValueError("no usable feature columns")
    rows, names = feature_blocks(spine, date, columns)
    per = len(names) // len(columns)
    own = {t: columns.index(t) * per if base is None and t in columns else -1 for t in targets}
    ahead = F.explode(F.array(*[F.struct(F.lit(t).alias("target_id"), F.lit(own[t]).alias("own"), F.col(t).cast("double").alias("value")) for t in targets]))
    long = rows.select(F.col(date).alias("period"), "_x", ahead.alias("_t")).select("_t.target_id", "_t.own", "period", "_t.value", "_x")
    from ..operators.frames import ordered
    later = F.lead("value", horizon).over(ordered(["target_id"], ["period"]))
    inside = (F.col("own") >= 0)
    x = F.when(inside, F.filter("_x", lambda v, i: (i < F.col("own")) | (i >= F.col("own") + per))).otherwise(F.col("_x"))
    known = long.select("target_id", "own", "period", F.log1p(later).alias("y"), x.alias("x")).where(F.col("y").isNotNull())
    return three_way_split(known, ["target_id"], "period"), names


def boosted_targets(spine: DataFrame, date: str, targets: Sequence[str], base: Sequence[str] | None = None, horizon: int = 14,
                    rounds: int = 5000, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, metrics, importance) of all targets. Boosting stops when the validation block no longer improves.

    One task fits one target: a row per day. Missing features go the way that gains more. metrics holds a row with the error of a
    target that could not be fitted.
    """
    panel, names = direct_panel(spine, date, targets, base, horizon)

    def fit(key, table):
        x, y = matrix(table["x"]), table["y"].to_numpy()
        train, valid, test = (chosen_text(table["split"], s) for s in ("train", "valid", "test"))
        rng = np.random.default_rng([seed, zlib.crc32(key["target_id"].encode())])
        values, kept, weights = boost(x[train], y[train], x[test], rounds, RATE, SHAPE, rng, ROWS, COLUMNS, (x[valid], y[valid]), PATIENCE)
        n, m = int(test.sum()), x.shape[1]
        own, per = table["own"][0].as_py(), len(names) - m
        places = np.arange(m)
        places = np.where((own >= 0) & (places >= own), places + per, places)
        return {"period": table["period"].filter(pa.array(test)).to_pylist() + [None] * m, "actual_log": [*y[test], *[None] * m], "rounds": [kept] * (n + m),
                "predicted_log": [*values, *[None] * m], "place": [None] * n + places.tolist(), "importance": [None] * n + weights.tolist()}
    fits = stage(by_group(panel.where(F.col("split").isNotNull()), ["target_id"], FIT, fit), "direct-fits")
    predictions = fits.where("period IS NOT NULL").select(
        "target_id", F.col("period").alias(date), F.expm1("actual_log").alias("actual"), S.expm1_clipped("predicted_log").alias("predicted"))
    scores = regression_metrics(predictions, ["target_id"], "actual", "predicted", None).join(
        fits.where("period IS NOT NULL").groupBy("target_id").agg(F.max("rounds").alias("rounds")), "target_id").withColumn("error", F.lit(""))
    metrics = scores.unionByName(fits.where("error IS NOT NULL").select("target_id", "error"), allowMissingColumns=True)
    named = F.array(*[F.lit(n) for n in names])
    importance = fits.where("place IS NOT NULL").select("target_id", named[F.col("place").cast("int")].alias("feature"), "importance")
    return predictions, metrics, importance


def boosted_direct(spine: DataFrame, date: str, target: str, base: Sequence[str] | None = None, horizon: int = 14,
                   rounds: int = 5000, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """boosted_targets() of one target, without its name."""
    predictions, metrics, importance = boosted_targets(spine, date, [target], base, horizon, rounds, seed)
    return (predictions.drop("target_id"), metrics.withColumn("model", F.lit("boosted_trees")).drop("target_id"),
            importance.drop("target_id").orderBy(F.col("importance").desc(), "feature"))
