"""Model fits at their full sizes, and the SQL of the linear ones: no SQL reproduces a forest or a network."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.rollup import roll_up, wide_panel
from ..plans import direct, models, spikes
from .inputs import R, canonical, rounded
from .panels import GRID_SQL, SPLIT_SQL


def model_zoo(spark, sf):
    results, _ = models.fit_models(canonical(spark, sf))
    return results.select("target_id", "model", "status", "n_train", "n_test", "n_features", "mae", "rmse", "r2",
                          "correlation", "baseline_rmse", "mse_skill_vs_train_mean")


def line_terms(spark, sf, model):
    fits = models.linear_fits(models.model_rows(canonical(spark, sf)), [model])
    terms = fits.select("target_id", "penalty", "intercept", F.posexplode("slopes").alias("place", "slope"))
    return terms.select("target_id", F.col("place").cast("long").alias("place"), *rounded(("penalty",), 6), *rounded(("intercept", "slope"), 2))


def ols_panel(spark, sf):
    return line_terms(spark, sf, "ols")


def ridge_panel(spark, sf):
    return line_terms(spark, sf, "ridge")


def line_scores(spark, sf):
    """Errors of least squares and ridge on the test rows, and of the training mean."""
    results, _ = models.fit_models(canonical(spark, sf), models=["ols", "ridge"])
    return results.select("target_id", "model", "status", "n_train", "n_test", "n_features", *rounded(("mae", "rmse", "baseline_rmse"), 2),
                          R("mse_skill_vs_train_mean", 4).alias("mse_skill_vs_train_mean"))


def spike_experiment(spark, sf):
    return spikes.spike_experiment(canonical(spark, sf))[0]


def day_spine(spark, sf):
    """Days by series, all of them."""
    return wide_panel(roll_up(canonical(spark, sf), "D"))


def boosted(spark, sf):
    spine = day_spine(spark, sf)
    predictions, _, _ = direct.boosted_targets(spine, "period", [c for c in spine.columns if c != "period"])
    return predictions


QUERIES = {
    "model_zoo": model_zoo,
    "ols_panel": ols_panel,
    "ridge_panel": ridge_panel,
    "linear_scores": line_scores,
    "spike_experiment": spike_experiment,
    "boosted_direct": boosted,
}

# Filled and scaled panel, sums of products, and their elimination beside the unit matrix for every penalty: w are the slopes, inv the inverse.
SOLVED_SQL = "WITH RECURSIVE " + GRID_SQL + """,
lagged AS (""" + " UNION ALL ".join(
    f"""SELECT period, replace(series_id, '::', '__') || '__lag{k}' AS feature,
        lag(value, {k}) OVER (PARTITION BY series_id ORDER BY period) AS value FROM grid WHERE role = 'predictive'"""
    for k in (1, 2, 3, 4)) + f"""),
panel AS (SELECT w.series_id AS target_id, w.period, w.value AS target, l.feature, l.value
          FROM weekly w JOIN lagged l USING (period) WHERE w.role = 'predicted'),
kept AS (SELECT target_id, feature FROM panel GROUP BY ALL HAVING count(value) >= 0.2 * count(*)),
dense AS (SELECT panel.* FROM panel JOIN kept USING (target_id, feature)),
periods AS (SELECT *, count(*) OVER (PARTITION BY target_id) AS n, row_number() OVER (PARTITION BY target_id ORDER BY period) AS i
            FROM (SELECT DISTINCT target_id, period, target FROM dense)),
split AS (SELECT target_id, period, target, {SPLIT_SQL} AS train FROM periods WHERE n >= 3),
filled AS (SELECT target_id, period, train, s.target, feature,
                  coalesce(value, quantile_cont(value, 0.5) FILTER (WHERE train) OVER g) AS v, count(value) FILTER (WHERE train) OVER g AS seen
           FROM dense JOIN split s USING (target_id, period) WINDOW g AS (PARTITION BY target_id, feature)),
scaled AS (SELECT *, avg(v) FILTER (WHERE train) OVER g AS m, stddev_pop(v) FILTER (WHERE train) OVER g AS sd
           FROM filled WHERE seen > 0 WINDOW g AS (PARTITION BY target_id, feature)),
cells AS (SELECT target_id, period, train, target, (v - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS x,
                 dense_rank() OVER (PARTITION BY target_id ORDER BY feature) AS j FROM scaled),
centre AS (SELECT target_id, avg(target) AS centre, count(*) AS n FROM split WHERE train GROUP BY target_id),
points AS (SELECT target_id, period, train, target, target - any_value(centre) AS e, any_value(centre) AS centre, any_value(n) AS n, list(x ORDER BY j) AS x
           FROM cells JOIN centre USING (target_id) GROUP BY target_id, period, train, target),
gram AS (SELECT a.target_id, a.j AS i, b.j AS j, sum(a.x * b.x) AS g FROM cells a JOIN cells b USING (target_id, period) WHERE a.train GROUP BY ALL),
rhs AS (SELECT target_id, j AS i, sum(cells.x * points.e) AS r FROM cells JOIN points USING (target_id, period) WHERE cells.train GROUP BY ALL),
lines AS (SELECT target_id, i, list(g ORDER BY j) AS g FROM gram GROUP BY ALL),
penalties AS (SELECT 0.0::DOUBLE AS alpha UNION ALL SELECT power(10.0::DOUBLE, -4 + 8 * k / 24.0::DOUBLE) FROM range(25) t(k)),
elim AS (
  SELECT target_id, alpha, 1::BIGINT AS k, list(list_concat(
           list_transform(g, lambda v, c: v + CASE WHEN c = i THEN alpha ELSE 0.0 END), [r],
           list_transform(g, lambda v, c: CASE WHEN c = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) ORDER BY i) AS m
  FROM lines JOIN rhs USING (target_id, i) CROSS JOIN penalties GROUP BY target_id, alpha
  UNION ALL
  SELECT target_id, alpha, k + 1, list_transform(m, lambda q, i: CASE WHEN i = k THEN list_transform(q, lambda v: v / q[k])
           ELSE list_transform(q, lambda v, c: v - q[k] * m[k][c] / m[k][k]) END)
  FROM elim WHERE k <= len(m)),
solved AS (SELECT target_id, alpha, list_transform(m, lambda q: q[len(m) + 1]) AS w, list_transform(m, lambda q: q[len(m) + 2:]) AS inv
           FROM elim WHERE k = len(m) + 1),
apart AS (SELECT target_id, alpha, avg(power((e - list_dot_product(x, w))
                 / (1 - 1.0 / n - list_dot_product(x, list_transform(inv, lambda q: list_dot_product(q, x)))), 2)) AS loss
          FROM points JOIN solved USING (target_id) WHERE train AND alpha > 0 GROUP BY ALL),
chosen AS (SELECT target_id, 'ols' AS model, 0.0::DOUBLE AS alpha FROM centre
           UNION ALL SELECT target_id, 'ridge', arg_min(alpha, loss) FROM apart GROUP BY target_id),
fits AS (SELECT target_id, model, alpha, w, centre FROM chosen JOIN solved USING (target_id, alpha) JOIN centre USING (target_id))"""


def terms_sql(model: str) -> str:
    return SOLVED_SQL + f"""
SELECT target_id, unnest(range(0, len(w))) AS place, rnd(alpha, 6) AS penalty, rnd(centre, 2) AS intercept, unnest(list_transform(w, lambda v: v)) AS raw
FROM fits WHERE model = '{model}'"""


ORACLES = {
    **{f"{m}_panel": f"SELECT target_id, place, penalty, intercept, rnd(raw, 2) AS slope FROM ({terms_sql(m)})" for m in ("ols", "ridge")},
    "linear_scores": SOLVED_SQL + """,
errors AS (SELECT f.target_id, f.model, p.target - (f.centre + list_dot_product(p.x, f.w)) AS e, p.target - f.centre AS base, len(p.x) AS p, p.n
           FROM fits f JOIN points p USING (target_id) WHERE NOT p.train)
SELECT target_id, model, 'ok' AS status, any_value(n) AS n_train, count(*) AS n_test, CAST(any_value(p) AS INTEGER) AS n_features, rnd(avg(abs(e)), 2) AS mae,
       rnd(sqrt(avg(e * e)), 2) AS rmse, rnd(sqrt(avg(base * base)), 2) AS baseline_rmse,
       rnd(1 - avg(e * e) / avg(base * base), 4) AS mse_skill_vs_train_mean
FROM errors GROUP BY target_id, model""",
}
