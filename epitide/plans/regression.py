"""Lagged regression frames and least squares with autocorrelation-robust errors, for many models at once."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions.numeric import normal_sf
from ..operators.features import month_dummies
from ..operators.frames import ordered
from ..operators.metrics import regression_metrics
from ..operators.splits import chronological_split
from ..session import stage

MODEL = "model_key"


def period_sums(df: DataFrame, freq: str, name: str, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Sum per key and period over all files; all-missing groups stay missing."""
    return df.groupBy(*keys, S.period("date", freq).alias("period")).agg(F.sum(value).alias(name))


def activity_frame(predictor: DataFrame, outcome: DataFrame, freq: str = "W", lags: Sequence[int] = (0, 1, 2, 3, 4),
                   x: str = "nhs_calls", y: str = "gp_admissions", keys: Sequence[str] = (),
                   complete: bool = False) -> DataFrame:
    """Summed predictor and outcome per period with z-scores and lags of the predictor's z.

    Without keys the frame is one time line, at most one row per period of the calendar.
    """
    keys = list(keys)
    frame = period_sums(predictor, freq, x, keys).join(period_sums(outcome, freq, y, keys), [*keys, "period"])
    if complete:
        frame = frame.dropna(subset=["period", x, y])
    by = keys or [F.lit(0)]
    group, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("period")
    frame = frame.select("*", *[S.zscore(c, F.avg(c).over(group), F.stddev_samp(c).over(group)).alias(f"z_{c}")
                                for c in (x, y)])
    return frame.select("*", *[(F.lag(f"z_{x}", k).over(w) if k else F.col(f"z_{x}")).alias(f"z_{x}_lag{k}") for k in lags])


def term_rows(terms: DataFrame, outcome: DataFrame, freq: str = "W", lags: Sequence[int] = (0, 1, 2, 3, 4),
              y: str = "gp_admissions") -> DataFrame:
    """Long term frame: (period, outcome, z outcome, term, count, z, z_lag..), one row per term and shared period.

    terms has date, search_term, count. Periods are those of the outcome on which any term was seen.
    """
    sums = terms.groupBy("search_term", S.period("date", freq).alias("period")).agg(F.sum("count").alias("count"))
    seen = sums.select("period").distinct()
    frame = period_sums(outcome, freq, y).join(seen, "period")
    every = Window.partitionBy(F.lit(0))
    frame = frame.withColumn(f"z_{y}", S.zscore(y, F.avg(y).over(every), F.stddev_samp(y).over(every)))
    days = frame.agg(F.collect_list(F.struct(*frame.columns))).scalar()  # one outcome row per period: the calendar bounds them
    grid = sums.select("search_term").distinct().select("search_term", F.inline(days))
    rows = grid.join(sums, ["search_term", "period"], "left").withColumn("term", S.predictor_token("search_term"))
    group, w = Window.partitionBy("search_term"), ordered(["search_term"], ["period"])
    rows = rows.withColumn("z", S.zscore("count", F.avg("count").over(group), F.stddev_samp("count").over(group)))
    return rows.select("*", *[(F.lag("z", k).over(w) if k else F.col("z")).alias(f"z_lag{k}") for k in lags])


def term_frame(rows: DataFrame, terms: Sequence[str], lags: Sequence[int], y: str = "gp_admissions") -> DataFrame:
    """The long term frame made wide: z_<term> and z_<term>_lag<k> columns."""
    aggs = [F.first("z").alias("")] + [F.first(f"z_lag{k}").alias(f"lag{k}") for k in lags]
    wide = rows.groupBy("period", y, f"z_{y}").pivot("term", list(terms)).agg(*aggs)
    return wide.toDF(*[c if c in ("period", y, f"z_{y}") else f"z_{c}".rstrip("_") for c in wide.columns])


# ---- least squares ------------------------------------------------------------------

def _outer(keys: list[str]):
    def partial(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            left, right = np.stack(pdf["left"].to_numpy()), np.stack(pdf["right"].to_numpy())
            rows = []
            for key, at in pdf.groupby(keys, dropna=False, sort=False).indices.items():
                rows.append((*(key if isinstance(key, tuple) else (key,)), (left[at].T @ right[at]).ravel()))
            yield pd.DataFrame(rows, columns=[*keys, "m"])
    return partial


def outer_sums(df: DataFrame, keys: Sequence[str], left, right, name: str) -> DataFrame:
    """Sum over rows of left x right' per key, as one flat array.

    Each Arrow batch adds up its own rows first, so the shuffle carries a few matrices per key and task.
    """
    keys = list(keys)
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", m array<double>"
    parts = df.select(*keys, left.alias("left"), right.alias("right")).mapInPandas(_outer(keys), schema)
    cells = parts.select(*keys, F.posexplode("m").alias("pos", "v")).groupBy(*keys, "pos").agg(F.sum("v").alias("v"))
    ordered_cells = F.sort_array(F.collect_list(F.struct("pos", "v")))
    return cells.groupBy(*keys).agg(F.transform(ordered_cells, lambda c: c["v"]).alias(name))


_BETA = T.StructType([T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("inverse", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_BETA)
def solve_normal(gram: pd.Series, rhs: pd.Series) -> pd.DataFrame:
    """Minimum-norm least-squares coefficients and the (pseudo-)inverse of X'X, one model per row."""
    out = []
    for g, b in zip(gram, rhs):
        p = len(b)
        inverse = np.linalg.pinv(np.reshape(g, (p, p)), rcond=1e-12, hermitian=True)
        out.append((inverse @ b, inverse.ravel()))
    return pd.DataFrame(out, columns=["beta", "inverse"])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def sandwich_errors(inverse: pd.Series, meat: pd.Series) -> pd.Series:
    """Standard errors from bread * (meat + meat') * bread."""
    out = []
    for b, m in zip(inverse, meat):
        p = int(round(len(b) ** 0.5))
        bread, half = np.reshape(b, (p, p)), np.reshape(m, (p, p))
        out.append(np.sqrt(np.maximum(np.diag(bread @ (half + half.T) @ bread), 0.0)))
    return pd.Series(out)


def one_model(order: str):
    """Key of the only model. Not a literal, so joins on it stay equi-joins."""
    return F.when(F.col(order).isNotNull(), F.lit("all"))


def design(df: DataFrame, predictors: Sequence[str], extra: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Adds x = [1, predictors, extra]; rows with a missing predictor are dropped."""
    names = [*predictors, *extra]
    whole = df.dropna(subset=names)
    return whole.withColumn("x", F.array(F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in names])), ["const", *names]


def dot(beta, x):
    return F.aggregate(F.zip_with(beta, x, lambda b, v: b * v), F.lit(0.0), lambda s, v: s + v)


def add_scaled(a, b, weight: float):
    return F.zip_with(a, b, lambda x, y: x + y * weight)


def least_squares(rows: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """One row per model: beta, inverse of X'X and the number of rows."""
    grams = outer_sums(rows, keys, F.col("x"), F.concat(F.col("x"), F.array(F.col(y))), "_m")
    p = F.round(F.sqrt(F.size("_m") + F.lit(0.25)) - 0.5).cast("int")  # the array holds p rows of p + 1 cells
    cell = F.transform(F.sequence(F.lit(0), F.col("_p") - 1), lambda i: F.slice(F.col("_m"), i * (F.col("_p") + 1) + 1, F.col("_p") + 1))
    split = grams.withColumn("_p", p).withColumn("_rows", cell)
    gram = F.flatten(F.transform("_rows", lambda r: F.slice(r, 1, F.size(r) - 1)))
    rhs = F.transform("_rows", lambda r: F.element_at(r, -1))
    fits = split.select(*keys, F.col("_m")[0].cast("long").alias("n_obs"), solve_normal(gram, rhs).alias("s"))
    return fits.select(*keys, "n_obs", F.col("s.beta").alias("beta"), F.col("s.inverse").alias("inverse"))


def fit_hac(df: DataFrame, y: str, predictors: Sequence[str], maxlags: int, order: str = "period",
            keys: Sequence[str] = (), seasonal: bool = True) -> DataFrame:
    """Coefficients with Newey-West errors (Bartlett weights, no small-sample factor): one row per model and term.

    Residuals times regressors are lagged by row in time order; one product u (u/2 + weighted lags)' and its
    transpose give the middle of the sandwich.
    """
    whole = df.dropna(subset=[y, *predictors])
    if not keys:
        whole, keys = whole.withColumn(MODEL, one_model(order)), [MODEL]
    keys = list(keys)
    dummies: list[str] = []
    if seasonal:
        whole, dummies = month_dummies(whole, order)
    rows, terms = design(whole, predictors, dummies)
    rows = stage(rows.select(*keys, order, y, "x"), "design")  # read by the fit, the residuals and their products
    fits = least_squares(rows, keys, y)
    scored = rows.join(fits, keys)
    resid = F.col(y) - dot(F.col("beta"), F.col("x"))
    u = scored.withColumn("_e", resid).select(
        *keys, order, y, "_e", F.transform("x", lambda v: v * F.col("_e")).alias("u"))
    w = ordered(keys, [order])
    lagged = u.select("*", *[F.lag("u", k).over(w).alias(f"_u{k}") for k in range(1, maxlags + 1)])
    right = F.transform("u", lambda v: v * 0.5)
    for k in range(1, maxlags + 1):
        right = add_scaled(right, F.coalesce(F.col(f"_u{k}"), F.transform("u", lambda v: v * 0.0)), 1.0 - k / (maxlags + 1.0))
    meat = outer_sums(lagged, keys, F.col("u"), right, "meat")
    quality = u.groupBy(*keys).agg(F.when(F.var_pop(y) > 0, 1 - F.sum(F.col("_e") ** 2) / (F.var_pop(y) * F.count(y))).alias("r2"))
    solved = fits.join(meat, keys).join(quality, keys).withColumn("_se", sandwich_errors("inverse", "meat"))
    cells = F.arrays_zip(F.array(*[F.lit(t) for t in terms]).alias("term"), F.col("beta").alias("coef"), F.col("_se").alias("std_err"))
    out = solved.select(*keys, "n_obs", "r2", F.inline(cells).alias("term", "coef", "std_err"))
    z = F.when(F.col("std_err") > 0, F.col("coef") / F.col("std_err"))
    return out.withColumn("z", z).withColumn("p_value", 2 * normal_sf(F.abs(F.col("z"))))


def fit_train_test(df: DataFrame, y: str, predictors: Sequence[str], train_fraction: float = 0.8, min_test: int = 4,
                   order: str = "period", keys: Sequence[str] = (), seasonal: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, metrics): fit on the earlier rows of each model, predict the later ones; baseline the training mean.

    Month columns come from the training months; a month first met in the test rows has none.
    """
    whole = df.dropna(subset=[y, *predictors])
    if not keys:
        whole, keys = whole.withColumn(MODEL, one_model(order)), [MODEL]
    keys = list(keys)
    split = chronological_split(whole, keys, order, train_fraction, min_test).where(F.col("split").isNotNull())
    extra: list[str] = []
    if seasonal:
        _, extra = month_dummies(split.where(F.col("split") == "train"), order)
        split = split.select("*", *[(F.month(order) == int(n.rsplit("_", 1)[1])).cast("double").alias(n) for n in extra])
    rows, _ = design(split, predictors, extra)
    train = rows.where(F.col("split") == "train")
    fits = least_squares(train, keys, y).select(*keys, "beta")
    means = train.groupBy(*keys).agg(F.avg(y).alias("baseline_prediction"))
    out = rows.join(fits, keys).join(means, keys).withColumn("prediction", dot(F.col("beta"), F.col("x"))).drop("beta", "x")
    out = out.withColumn("residual", F.col(y) - F.col("prediction"))
    metrics = regression_metrics(out.where(F.col("split") == "test"), keys, y, skill="mse_skill_vs_train_mean")
    return out, metrics
