"""Every predictor against every target in one keyed plan.

The result of this family of operators is one block of rows per (predictor, target) pair, so pairs are part
of the answer. They come from an equi-join on the period; the predictor side is salted by series so that
one period (all series meet there) does not become one task. A table of candidate pairs narrows all of it.
"""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ridge_from_sums
from .frames import ordered, replicated, salted
from .ranks import NUMBER, fan_out, numbered
from .rollup import roll_up, series_metadata

PAIR = ["predictor_id", "target_id"]
SALTS = 16


def lag_columns(value: str, lags: Iterable[int], window, prefix: str | None = None) -> list[Column]:
    """Row-based lags; lag 0 is the value itself."""
    name = prefix or value
    return [(F.lag(value, k).over(window) if k else F.col(value)).alias(f"{name}_lag{k}") for k in lags]


def sides(series: DataFrame, freq: str, aggregation: str) -> tuple[DataFrame, DataFrame]:
    """Rolled-up predictors (predictor_id, period, x) and targets (target_id, period, y)."""
    x = roll_up(series.where(F.col("role") == "predictive"), freq, aggregation).select(
        F.col("series_id").alias("predictor_id"), "period", F.col("value").alias("x"))
    y = roll_up(series.where(F.col("role") == "predicted"), freq, aggregation).select(
        F.col("series_id").alias("target_id"), "period", F.col("value").alias("y"))
    return x, y


def meet(x: DataFrame, y: DataFrame, salts: int = SALTS) -> DataFrame:
    return salted(x, "predictor_id", salts).join(replicated(y, salts), ["period", "_salt"]).drop("_salt")


def pair_frame(series: DataFrame, freq: str = "W", lags: Sequence[int] = (1, 2, 3, 4), aggregation: str = "mean",
               lag_before_join: bool = False, salts: int = SALTS, candidates: DataFrame | None = None) -> DataFrame:
    """Complete rows (predictor_id, target_id, period, y, x_lag..) of all pairs, or of the candidate pairs.

    Lags count rows, not weeks. Taken after the join they skip periods the target lacks; taken before it
    they do not. candidates holds predictor_id and target_id: a predictor's rows then go to its own targets only.
    """
    x, y = sides(series, freq, aggregation)
    names = [f"x_lag{k}" for k in lags]

    def paired(rows: DataFrame) -> DataFrame:
        if candidates is None:
            return meet(rows, y, salts)
        wanted = candidates.select(*PAIR).distinct()
        return rows.join(wanted, "predictor_id").join(y, ["target_id", "period"])

    if lag_before_join:
        x = x.select("predictor_id", "period", *lag_columns("x", lags, ordered(["predictor_id"], ["period"])))
        frame = paired(x)
    else:
        frame = paired(x).select(*PAIR, "period", "y", *lag_columns("x", lags, ordered(PAIR, ["period"])))
    return frame.select(*PAIR, "period", "y", *names).dropna(subset=["y", *names])


def pair_grid(series: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """One row per predictor and target, or per candidate pair, with both sides' metadata: the row set of the result table.

    Without candidates the targets are numbered and every predictor fans out to the numbers.
    """
    meta = series_metadata(series)

    def side(role: str, key: str, label: str) -> DataFrame:
        return meta.where(F.col("role") == role).select(
            F.col("series_id").alias(key), F.col("dataset_family").alias(f"{label}_family"),
            F.col("series_name").alias(f"{label}_name"), F.col("source_file").alias(f"{label}_source_file"))

    left, right = side("predictive", "predictor_id", "predictor"), side("predicted", "target_id", "target")
    if candidates is not None:
        return left.join(candidates.select(*PAIR).distinct(), "predictor_id").join(right, "target_id").select(
            *left.columns, *right.columns)
    places = numbered(right, F.col("target_id"))
    return fan_out(left, places, places.agg(F.max(NUMBER)).scalar())


def fit_inputs(xs: Sequence[Column], y: Column, over=None, where: Column | None = None) -> Column:
    """What a linear fit needs to know about its rows, as an aggregate or, with a window, as running values.

    One column: means, deviations and covariance (corr() itself fails on a constant column). Several: sums of products (centre the columns first).
    where selects the rows that count.
    """
    def chosen(c: Column) -> Column:
        return c if where is None else F.when(where, c)

    def done(c: Column) -> Column:
        return c if over is None else c.over(over)

    xs = list(xs)
    n = done(F.count(chosen(y))).cast("double").alias("n")
    if len(xs) == 1:
        x = xs[0]
        return F.struct(
            n, done(F.avg(chosen(x))).alias("mx"), done(F.avg(chosen(y))).alias("my"),
            done(F.stddev_samp(chosen(x))).alias("sx"), done(F.stddev_samp(chosen(y))).alias("sy"),
            done(F.covar_samp(chosen(x), chosen(y))).alias("cxy"))
    return F.struct(
        n, F.array(*[done(F.sum(chosen(x))) for x in xs]).alias("sx"), done(F.sum(chosen(y))).alias("sy"),
        F.array(*[done(F.sum(chosen(a * b))) for i, a in enumerate(xs) for b in xs[i:]]).alias("sxx"),
        F.array(*[done(F.sum(chosen(x * y))) for x in xs]).alias("sxy"), done(F.sum(chosen(y * y))).alias("syy"))


def fit_line(inputs: Column, k: int, alpha: float, x_scale: str = "sample", scale_y: bool = True) -> Column:
    """struct(intercept, slopes, .., sigma) of a ridge fit (alpha 0: least squares) on z-scored columns.

    With one column the fit has a closed form; with more, a small solve runs in Arrow batches.
    """
    if k > 1:
        return ridge_from_sums(alpha, x_scale, scale_y)(inputs)
    n, sx, sy = inputs["n"], inputs["sx"], F.coalesce(inputs["sy"], F.lit(0.0))
    r = F.when((sx > 0) & (sy > 0), inputs["cxy"] / (sx * sy)).otherwise(0.0)
    weight = (n - 1) if x_scale == "sample" else n
    share = F.when(weight + alpha > 0, weight / (weight + alpha)).otherwise(0.0)
    slope = F.when(sx > 0, r * sy / sx * share).otherwise(0.0)
    left = sy * F.sqrt(F.greatest(1 - r * r * share * (2 - share), F.lit(0.0)))
    sigma = F.when((n > 2) & (left > 0), left).when(sy > 0, sy).otherwise(1.0)
    return F.when(n >= 1, F.struct((inputs["my"] - slope * inputs["mx"]).alias("intercept"),
                                   F.array(slope).alias("slopes"), sigma.alias("sigma")))


def line_at(fit: Column, xs: Sequence[Column]) -> Column:
    """Value of a fitted line at the given (equally centred) inputs."""
    value = fit["intercept"]
    for j, x in enumerate(xs):
        value = value + fit["slopes"][j] * x
    return value
