"""Fits against independent refits with numpy, and the properties of forecasts."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epitide.functions.numeric import past_quantiles, ridge_cv
from epitide.plans import backtest, direct, forecast, models, pairwise, regression, spikes
from epitide.schema import CANONICAL, BacktestConfig, PanelConfig, SpikeConfig

START = dt.date(2023, 1, 2)


def weeks(n):
    return [START + dt.timedelta(weeks=i) for i in range(n)]


def series(spark, **columns):
    rows = []
    for name, (role, values) in columns.items():
        rows += [(d, float(v), name, role, "fam", name, name + ".csv") for d, v in zip(weeks(len(values)), values) if v == v]
    return spark.createDataFrame(rows, CANONICAL)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=68)) + 50
    gap = x.copy()
    gap[[5, 17, 18]] = np.nan
    y = 2 * np.concatenate([[x[0]] * 2, x[:58]]) + rng.normal(0, 0.3, 60)
    flat = np.full(68, 3.0)
    short = np.arange(8.0)
    return {"x": x, "gap": gap, "y": y, "flat": flat, "short": short}, series(
        spark, x=("predictive", x), gap=("predictive", gap), flat=("predictive", flat), short=("predictive", short), y=("predicted", y))


def frame(x, y, lags):
    df = pd.DataFrame({"x": pd.Series(x), "y": pd.Series(y)}).dropna().reset_index()
    for k in lags:
        df[f"l{k}"] = df["x"].shift(k)
    return df.dropna().reset_index(drop=True)


def refit(train, test, cols, alpha, population=False, scale_y=True):
    ddof = 0 if population else 1
    m, s = train[cols].mean(), train[cols].std(ddof=ddof).replace(0, np.nan).fillna(1.0)
    my, sy = train["y"].mean(), train["y"].std() if scale_y else 1.0
    z, zy = ((train[cols] - m) / s).to_numpy(), ((train["y"] - my) / sy).to_numpy()
    b = np.linalg.lstsq(np.vstack([z, np.sqrt(alpha) * np.eye(len(cols))]), np.concatenate([zy, np.zeros(len(cols))]), rcond=None)[0]
    fitted = z @ b * sy + my
    return float(((test[cols] - m) / s).to_numpy() @ b * sy + my), float(np.std(train["y"] - fitted, ddof=1))


@pytest.mark.parametrize("lags", [(1,), (1, 2, 3, 4)])
@pytest.mark.parametrize("name", ["x", "gap", "flat"])
@pytest.mark.parametrize("population", [False, True])
def test_backtest_equals_refits(data, lags, name, population):
    raw, df = data
    cfg = BacktestConfig(lags=lags, x_scale="population" if population else "sample", scale_y=not population)
    got = backtest.pair_predictions(df.where(F.col("series_id").isin(name, "y")), cfg).orderBy("period").toPandas()
    f = frame(raw[name], raw["y"], lags)
    start = min(max(12, int(np.floor(len(f) * 0.6))), len(f) - 1)
    assert len(got) == len(f) - start
    cols = [f"l{k}" for k in lags]
    for i, row in zip(range(start, len(f)), got.itertuples()):
        p, s = refit(f.iloc[:i], f.iloc[i], cols, 1.0, population, not population)
        assert row.prediction == pytest.approx(p, rel=1e-9) and row.sigma == pytest.approx(s, rel=1e-7)
        assert row.spike_threshold == pytest.approx(f["y"].iloc[:i].quantile(0.9))
        assert row.baseline_prediction == pytest.approx(f["y"].iloc[:i].mean()) and row.train_end < row.period


def test_short_pairs_are_error_rows(data):
    _, df = data
    results = backtest.backtest_matrix(df).toPandas().set_index("predictor_id")
    assert len(results) == 4 and results.loc["short", "status"] == "error" and results.loc["x", "status"] == "ok"
    assert backtest.leaking_rows(backtest.pair_predictions(df, spikes=False)).isEmpty()
    board = backtest.leaderboards(backtest.backtest_matrix(df)).toPandas()
    assert set(board["ranking"]) == {b[0] for b in backtest.LEADERBOARDS} and (board.groupby("ranking")["rank"].max() == 3).all()


@pytest.mark.parametrize("lags", [(1,), (0, 1, 2, 3, 4)])
def test_pairwise_equals_least_squares(data, lags):
    raw, df = data
    got = pairwise.pair_fits(df, lags=lags).where("predictor_id = 'gap'").orderBy("period").toPandas()
    f = frame(raw["gap"], raw["y"], lags)
    cut = max(1, min(int(np.floor(len(f) * 0.8)), len(f) - 4))
    cols = [f"l{k}" for k in lags]
    tr = f.iloc[:cut]
    z, zy = (f[cols] - tr[cols].mean()) / tr[cols].std(), (f["y"] - tr["y"].mean()) / tr["y"].std()
    a = np.column_stack([np.ones(len(f)), z])
    b = np.linalg.lstsq(a[:cut], zy[:cut], rcond=None)[0]
    assert np.allclose(got["prediction"], a @ b, atol=1e-8) and (got["split"] == "train").sum() == cut
    matrix = pairwise.pairwise_matrix(df, lags=lags).toPandas().set_index("predictor_id")
    assert matrix.loc["flat", "status"] == "ok" and len(matrix) == 4


def test_hac_errors(spark, data):
    raw, df = data
    f = frame(raw["x"], raw["y"], (1, 2))
    pdf = pd.DataFrame({"period": weeks(len(f)), "y": f["y"], "a": f["l1"], "b": f["l2"]})
    got = regression.fit_hac(spark.createDataFrame(pdf), "y", ["a", "b"], 3).toPandas().set_index("term")
    months = pd.to_datetime(pdf["period"]).dt.month
    X = np.column_stack([np.ones(len(f)), pdf["a"], pdf["b"], *[(months == m).astype(float) for m in sorted(months.unique())[1:]]])
    beta = np.linalg.lstsq(X, pdf["y"], rcond=None)[0]
    u = X * (pdf["y"].to_numpy() - X @ beta)[:, None]
    meat = u.T @ u
    for k in range(1, 4):
        g = u[k:].T @ u[:-k]
        meat += (1 - k / 4) * (g + g.T)
    bread = np.linalg.inv(X.T @ X)
    se = np.sqrt(np.diag(bread @ meat @ bread))
    assert got.loc["a", "coef"] == pytest.approx(beta[1], rel=1e-6) and len(got) == X.shape[1]
    assert got.loc["a", "std_err"] == pytest.approx(se[1], rel=1e-5) and got.loc["const", "std_err"] == pytest.approx(se[0], rel=1e-5)


def test_train_test_metrics(spark, data):
    raw, _ = data
    f = frame(raw["x"], raw["y"], (1,))
    pdf = pd.DataFrame({"period": weeks(len(f)), "y": f["y"], "a": f["l1"]})
    rows, scores = regression.fit_train_test(spark.createDataFrame(pdf), "y", ["a"], seasonal=True)
    assert rows.count() == len(f) and scores.first()["rmse"] > 0


def test_leading_forecast(spark, data):
    raw, df = data
    out = forecast.leading_forecast(df, 4, cfg=BacktestConfig(lags=(1, 2)))
    ahead = out.where("is_forecast AND predictor_id = 'x'").orderBy("period").toPandas()
    assert len(ahead) == 4 and (ahead["lower"] <= ahead["prediction"]).all() and ahead["actual"].isna().all()
    x = pd.DataFrame({"x": raw["x"]})
    x["l1"], x["l2"] = x["x"].shift(1), x["x"].shift(2)
    x["y"] = pd.Series(raw["y"])
    train = x.dropna()
    for i, row in zip(range(60, 64), ahead.itertuples()):
        p, s = refit(train, x.iloc[i], ["l1", "l2"], 1.0)
        assert row.prediction == pytest.approx(p, rel=1e-9)
        assert row.upper - row.prediction == pytest.approx(1.2815515655446004 * s, rel=1e-6)


def test_strategies(spark, data):
    _, df = data
    ask = spark.createDataFrame([("y", "x")], "target_id string, predictor_id string")
    led = forecast.forecast_targets(df, ask, 4).toPandas()
    assert set(led["strategy"]) == {"leading_indicator"} and led["is_forecast"].sum() == 4
    for predictor in ("short", None):
        ask = spark.createDataFrame([("y", predictor)], "target_id string, predictor_id string")
        own = forecast.forecast_targets(df, ask, 4).toPandas()
        assert set(own["strategy"]) == {"autoregressive"} and own["is_forecast"].sum() == 4
        assert own["fallback_reason"].notna().all() == (predictor is not None)


def test_autoregressive_forecast(spark):
    rng = np.random.default_rng(2)
    df = series(spark, target_a=("predicted", np.linspace(5, 15, 60) + rng.normal(0, 0.05, 60)), p=("predictive", np.ones(60)))
    out = forecast.ar_forecast(df, 5).orderBy("period").toPandas()
    ahead = out[out["is_forecast"]]
    assert len(ahead) == 5 and ahead["period"].is_monotonic_increasing and ahead["actual"].isna().all()
    assert ((ahead["lower"] <= ahead["prediction"]) & (ahead["prediction"] <= ahead["upper"])).all()
    assert abs(ahead["prediction"].iloc[0] - 15.17) < 0.5 and len(out) == 65
    again = forecast.ar_forecast(df.repartition(7), 5).orderBy("period").toPandas()
    assert np.allclose(out["prediction"].dropna(), again["prediction"].dropna())
    with pytest.raises(ValueError):
        forecast.ar_forecast(df, 0)


def test_ridge_cv_counts_copies():
    rng = np.random.default_rng(3)
    x, y, w = rng.normal(size=(30, 3)), rng.normal(size=30), rng.integers(1, 4, 30).astype(float)
    repeated = np.repeat(np.arange(30), w.astype(int))
    a, b = ridge_cv(x, y, w), ridge_cv(x[repeated], y[repeated], np.ones(len(repeated)))
    assert a[0] == pytest.approx(b[0]) and np.allclose(a[1], b[1])
    # leave-one-out by brute force picks the same penalty
    alphas, best = (0.01, 1.0, 100.0), []
    z = (x - x.mean(0)) / x.std(0)
    for alpha in alphas:
        err = 0.0
        for i in range(30):
            keep = np.arange(30) != i
            zc, yc = z[keep] - z[keep].mean(0), y[keep] - y[keep].mean()
            beta = np.linalg.solve(zc.T @ zc + alpha * np.eye(3), zc.T @ yc)
            err += (y[i] - y[keep].mean() - (z[i] - z[keep].mean(0)) @ beta) ** 2
        best.append(err)
    picked = ridge_cv(x, y, np.ones(30), alphas)
    only = ridge_cv(x, y, np.ones(30), (alphas[int(np.argmin(best))],))
    assert np.allclose(picked[1], only[1])


def test_model_subset_and_predictors(spark, data):
    _, df = data
    one, _ = models.fit_models(df, models=["ols"], predictors=["x"])
    two, predictions = models.fit_models(df, models=["ols", "random_forest"], predictors=["x", "gap"], trees=5)
    one, two = one.toPandas(), two.toPandas()
    assert set(one["model"]) == {"ols"} and set(two["model"]) == {"ols", "random_forest"}
    assert one["n_features"].max() < two["n_features"].max() and predictions.count() == 2 * two["n_test"].max()
    assert one["mse_skill_vs_train_mean"].max() > 0.5
    assert set(models.LINES) < set(models.MODEL_NAMES.values())


def test_spike_experiment(spark, data):
    _, df = data
    cfg = SpikeConfig(horizons=(1, 2), lags=(1, 2), max_iter=10, n_bootstrap=5)
    results, predictions = spikes.spike_experiment(df, cfg)
    results, predictions = results.toPandas(), predictions.toPandas()
    assert set(results["horizon"]) == {1, 2} and set(results["status"]) == {"ok"}
    assert predictions["spike_probability"].between(0, 1).all() and (predictions["severity_score_lower"] >= 0).all()
    skipped, _ = spikes.spike_experiment(df, SpikeConfig(horizons=(1,), lags=(1,), min_train_rows=500))
    assert skipped.first()["status"] == "skipped"


def test_boosted_direct(spark):
    days = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=200).date})
    days["a"], days["const"] = np.sin(np.arange(200) / 9) + 2, 1.0
    days["target"] = np.roll(days["a"], 14) * 10
    predictions, metrics, importance = direct.boosted_direct(spark.createDataFrame(days), "date", "target", rounds=10)
    assert predictions.count() == 37 and metrics.first()["rmse"] > 0
    assert not any("const" in r["feature"] for r in importance.collect())


def test_boosted_targets_leave_out_their_own_columns(spark):
    days = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=220).date})
    days["a"], days["b"] = np.sin(np.arange(220) / 9) + 2, np.cos(np.arange(220) / 5) + 2
    days.loc[40:45, "b"] = np.nan
    spine = spark.createDataFrame(days)
    panel, names = direct.direct_panel(spine, "date", ["a", "b"])
    sizes = {r["target_id"]: r["n"] for r in panel.groupBy("target_id").agg(F.max(F.size("x")).alias("n")).collect()}
    assert sizes == {"a": len(names) // 2, "b": len(names) // 2}
    predictions, metrics, importance = direct.boosted_targets(spine, "date", ["a", "b"], rounds=20)
    used = {(r["target_id"], r["feature"][0]) for r in importance.collect()}
    assert used == {("a", "b"), ("b", "a")} and {r["target_id"] for r in metrics.where("error = ''").collect()} == {"a", "b"}
    assert {r["target_id"]: r["count"] for r in predictions.groupBy("target_id").count().collect()} == {"a": 41, "b": 40}


def test_failing_fit_is_an_error_row(spark, data):
    _, df = data
    rows = models.model_rows(df)
    uneven = F.slice("x", 1, F.when(F.month("period") == 3, 2).otherwise(4))
    broken = rows.unionByName(rows.withColumn("target_id", F.lit("broken")).withColumn("x", uneven))
    results, predictions = models.evaluate_models(broken, ["ols", "random_forest"], trees=5)
    status = {(r["target_id"], r["model"]): r["status"] for r in results.collect()}
    assert {k[0]: v for k, v in status.items()} == {"y": "ok", "broken": "error"} and len(status) == 4
    assert {r["target_id"] for r in predictions.select("target_id").distinct().collect()} == {"y"}


def test_models_agree_with_plain_fits(spark, data):
    _, df = data
    rows = models.model_rows(df).orderBy("period").toPandas()
    train = rows["split"] == "train"
    x, y = np.stack(rows["x"].to_numpy()), rows["target"].to_numpy()
    _, predictions = models.fit_models(df, models=["ols", "elastic_net"])
    got = predictions.orderBy("model", "period").toPandas()
    from epitide.functions import linear
    for name in ("ols", "elastic_net"):
        line = linear.LINES[name](x[train], y[train])
        assert np.allclose(got[got["model"] == name]["prediction"], line["intercept"] + x[~train] @ line["slopes"])
    assert np.allclose(x[train].mean(0), 0) and not np.isnan(x).any() and got["baseline_prediction"].iloc[0] == pytest.approx(y[train].mean())


def test_unknown_model_is_refused(data):
    with pytest.raises(ValueError, match="unknown"):
        models.fit_models(data[1], models=["nothing"])


def test_candidate_pairs(spark, data):
    _, df = data
    wanted = spark.createDataFrame([("x", "y"), ("short", "y"), ("x", "y"), ("absent", "y")], "predictor_id string, target_id string")
    cfg = BacktestConfig(lags=(1,))
    some = backtest.backtest_matrix(df, cfg, candidates=wanted).toPandas().set_index("predictor_id")
    every = backtest.backtest_matrix(df, cfg).toPandas().set_index("predictor_id")
    assert set(some.index) == {"x", "short"} and set(every.index) == {"x", "gap", "flat", "short"}
    assert some.loc["x", "rmse"] == pytest.approx(every.loc["x", "rmse"]) and some.loc["short", "status"] == "error"
    assert list(some.columns) == list(every.columns)
    fits = pairwise.pairwise_matrix(df, lags=(1,), candidates=wanted)
    assert {r["predictor_id"] for r in fits.collect()} == {"x", "short"}
    assert backtest.backtest_matrix(df.where("role = 'predictive'"), cfg).isEmpty()


def test_leading_candidates_of_equal_ends(spark):
    D = dt.date
    ends = {"p1": ("predictive", D(2024, 3, 1)), "p2": ("predictive", D(2024, 2, 1)), "p3": ("predictive", None), "t1": ("predicted", D(2024, 2, 1)),
            "t2": ("predicted", D(2024, 2, 1)), "t3": ("predicted", D(2024, 1, 1)), "t4": ("predicted", D(2024, 3, 1)), "t5": ("predicted", None)}
    catalogue = spark.createDataFrame([(k, r, e) for k, (r, e) in ends.items()], "series_id string, role string, date_max date")
    got = {(r["predictor_id"], r["target_id"]) for r in forecast.leading_candidates(catalogue).collect()}
    assert got == {("p1", "t1"), ("p1", "t2"), ("p1", "t3"), ("p2", "t3")}
    assert forecast.leading_candidates(catalogue.where("role = 'predictive'")).isEmpty()


@pytest.mark.parametrize("q", [0.0, 0.3, 0.9, 1.0])
def test_past_quantiles(q):
    rng = np.random.default_rng(2)
    for values in (np.round(rng.normal(size=200), 1), np.zeros(5), np.array([3.0]), np.zeros(0), np.arange(50.0)[::-1]):
        got = past_quantiles(values, q)
        assert len(got) == len(values) and (not len(got) or np.isnan(got[0]))
        assert np.allclose(got[1:], [np.quantile(values[:i], q) for i in range(1, len(values))])


def test_past_quantiles_of_twenty_years_of_days():
    import time
    values, begun = np.random.default_rng(0).normal(size=7300), time.perf_counter()
    assert past_quantiles(values, 0.9)[-1] == pytest.approx(np.quantile(values[:-1], 0.9)) and time.perf_counter() - begun < 5
