"""Lag panels, splits, regression frames, spike labels, spines and classification metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, metrics, profile, reshape, rollup, splits
from ..operators.pairs import PAIR, pair_frame
from ..plans import regression
from ..schema import PanelConfig, SpikeConfig
from ..sources.tables import SpineSource, build_spine, spine_rows
from .inputs import (CANONICAL_SQL, R, WEEKLY_SQL, canonical, event_series, lineitem_series, orders_series, pair_sql,
                     rounded, table, weekly_series)


def weekly(spark, sf):
    return rollup.roll_up(canonical(spark, sf))


def lag_panel(spark, sf):
    panel = features.lag_panel(weekly_series(spark, sf), PanelConfig(lags=(1, 2, 3, 4)))
    return panel.select("target_id", "period", "feature", *rounded(("target", "value"), 4))


def sparse_features(spark, sf):
    series = rollup.rolled_series(canonical(spark, sf).unionByName(event_series(spark, sf)))
    cfg = PanelConfig(lags=(1, 2))
    panel = features.target_features(series, cfg, own_lags=True)
    kept = features.dense_features(panel, 0.2)
    return kept.groupBy("target_id", "feature").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_filled"))


def ar_panel(spark, sf):
    from ..plans.forecast import ar_rows
    rows = ar_rows(weekly_series(spark, sf), PanelConfig(lags=(1, 3)))
    return rows.select("target_id", "period", R("target", 4).alias("target"), R(F.col("x")[0], 4).alias("lag1"),
                       R(F.col("x")[1], 4).alias("lag3"), "row_index", "n_rows")


def calls_frame(spark, sf):
    out = regression.activity_frame(lineitem_series(spark, sf), orders_series(spark, sf), "W", (0, 1, 2))
    return out.select("period", *rounded(("nhs_calls", "gp_admissions"), 2),
                      *rounded(("z_nhs_calls", "z_gp_admissions", "z_nhs_calls_lag0", "z_nhs_calls_lag1", "z_nhs_calls_lag2"), 6))


def clinical_frame(spark, sf):
    out = regression.activity_frame(lineitem_series(spark, sf), orders_series(spark, sf), "M", (0, 1, 2, 3),
                                    "nhs111_calls", "admissions", complete=True)
    return out.select("period", *rounded(("z_nhs111_calls", "z_admissions", "z_nhs111_calls_lag1", "z_nhs111_calls_lag3"), 6))


def terms(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"), F.concat(F.lit("Term "), F.col("l_returnflag")).alias("search_term"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("count"))


def term_frame_long(spark, sf):
    out = regression.term_rows(terms(spark, sf), orders_series(spark, sf), "W", (0, 1, 2))
    return out.select("period", "term", *rounded(("gp_admissions",), 2), *rounded(
        ("count", "z_gp_admissions", "z", "z_lag0", "z_lag1", "z_lag2"), 6))


def term_frame_wide(spark, sf):
    rows = regression.term_rows(terms(spark, sf), orders_series(spark, sf), "W", (1,))
    wide = regression.term_frame(rows, ["term_a", "term_n", "term_r"], (1,))
    return wide.select("period", *rounded(profile.lagged_columns(wide.columns, (1,)), 6), R("z_term_a", 6).alias("z_term_a"))


def complete_cases(spark, sf):
    wide = regression.term_frame(regression.term_rows(terms(spark, sf), orders_series(spark, sf), "W", (0, 4)),
                                 ["term_a", "term_n", "term_r"], (0, 4))
    return profile.complete_cases(wide, [], "z_gp_admissions", profile.lagged_columns(wide.columns, (0, 4)))


def chronological(spark, sf):
    out = splits.chronological_split(weekly(spark, sf), ["series_id"], "period")
    return out.select("series_id", "period", "n_rows", "row_index", "split")


def three_way(spark, sf):
    out = splits.three_way_split(weekly(spark, sf), ["series_id"], "period")
    both = splits.block_split(out.withColumnRenamed("split", "split_70_10_20").drop("n_rows", "row_index"), ["series_id"], "period")
    return both.select("series_id", "period", "split_70_10_20", F.col("split").alias("split_70_15_15"))


def train_zscore(spark, sf):
    out = splits.train_zscore(splits.chronological_split(weekly(spark, sf), ["series_id"]), ["series_id"], ["value"])
    return out.select("series_id", "period", "split", R("value_z", 6).alias("value_z"))


SPIKES = SpikeConfig()
KEYS = ["target_id", "horizon"]


def spike_labels(spark, sf):
    rows = features.spike_rows(weekly_series(spark, sf), SPIKES)
    split = splits.purge_crossing_labels(splits.chronological_split(rows, KEYS, "period", 0.8, 4), KEYS)
    out = features.label_spikes(split, SPIKES)
    return out.select(*KEYS, "period", "split", "future_window_end", "spike", "severity_band", *rounded(
        ("target_value", "target_smoothed", "future_peak", "spike_threshold", "severity_scale", "severity_score"), 4))


def classification(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        "lang", "quality", (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("p"))
    out = metrics.classification_metrics(rows, ["lang"], "quality", "p")
    return out.select("lang", "n", "n_positive", *rounded(
        ("brier", "precision", "recall", "f1", "average_precision", "roc_auc"), 6))


def regression_metric_rows(spark, sf):
    """A price forecast per brand: the retail price as prediction of the extended price per unit."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        "p_brand", (F.col("l_extendedprice") / F.col("l_quantity")).alias("actual"),
        F.col("p_retailprice").alias("prediction"), F.lit(1000.0).alias("baseline_prediction"))
    out = metrics.regression_metrics(rows, ["p_brand"])
    return out.select("p_brand", "n_predictions", *rounded(
        ("mae", "rmse", "max_abs_error", "r2", "correlation", "mean_abs_baseline_error", "baseline_rmse", "mse_skill"), 4))


def ensemble(spark, sf):
    out = metrics.ensemble_summary(weekly(spark, sf), ["role", "period"], "value", 0.8)
    return out.select("role", "period", *rounded(("prediction", "lower", "upper"), 4))


SOURCES = (
    SpineSource("orders", "orders.parquet", "o_orderdate", "o_totalprice", output_name="order_price",
                filters={"o_orderstatus": "F", "no_such_column": "x"}),
    SpineSource("ev", "events.parquet", "ts", "value", series_column="event_type", keep=("view", "click", "error"),
                renames={"view": "ev_view", "click": "ev_click"}),
)


def spine(spark, sf):
    rows = spine_rows(table(spark, sf, "orders"), SOURCES[0], "o_orderkey").unionByName(
        spine_rows(table(spark, sf, "events"), SOURCES[1], "event_id"))
    wide = build_spine(rows, SOURCES, "1996-01-01", "2024-01-20", ["order_price", "ev_view", "ev_click", "ev__error"])
    ends = wide.agg(F.min("date").alias("start"), F.max("date").alias("end"))
    calendar = features.season_columns(features.daily_spine(ends))
    out = wide.join(calendar, "date", "left")
    return out.select(*wide.columns, "week_of_year", *rounded(("sin_week", "cos_week"), 6))


def calendar(spark, sf):
    ends = orders_series(spark, sf).groupBy("series_id").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return features.season_columns(features.daily_spine(ends)).select("series_id", "date", "week_of_year",
                                                                      *rounded(("sin_week", "cos_week"), 6))


def daily(spark, sf):
    """One row per priority and day of its span; days without orders have no value."""
    series = orders_series(spark, sf)
    ends = series.groupBy("series_id").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    means = series.groupBy("series_id", "date").agg(F.avg("value").alias("value"))
    return features.daily_spine(ends).join(means, ["series_id", "date"], "left")


def direct_features(spark, sf):
    out = features.direct_features(daily(spark, sf), ["series_id"], "date", ["value"], "value")
    names = ["value_t", "value_lag1", "value_lag3", "value_lag7", "value_lag14", "value_roll7", "value_roll14", "y_raw"]
    return out.select("series_id", "date", *rounded(names, 4), R("y", 6).alias("y"))


def forward_fill(spark, sf):
    out = features.forward_fill(daily(spark, sf), ["series_id"], "date", ["value"])
    return out.select("series_id", "date", R("value", 4).alias("value"))


def lookback(spark, sf):
    out = features.lookback_windows(weekly(spark, sf), ["series_id"], "period", ["value"], "value", 4, 2)
    return out.select("series_id", "window_end", *[R(F.col("x")[i][0], 4).alias(f"x{i}") for i in range(4)],
                      R("label", 4).alias("label"), "label_at", "split")


def future_periods(spark, sf):
    last = canonical(spark, sf).groupBy("series_id").agg(F.max("date").alias("last"))
    weeks = features.future_periods(last, "last", 3, "W").select("series_id", F.lit("W").alias("freq"), "step", "period")
    return weeks.unionByName(features.future_periods(last, "last", 3, "M").select("series_id", F.lit("M").alias("freq"), "step", "period"))


def first_pivot(spark, sf):
    rows = table(spark, sf, "events").select(F.col("ts").cast("date").alias("date"), "event_type", "value", "event_id")
    return reshape.first_pivot(rows, "date", "event_type", "value", "event_id")


def hac(spark, sf):
    frame = pair_frame(canonical(spark, sf), lags=(1,))
    out = regression.fit_hac(frame, "y", ["x_lag1"], 3, keys=PAIR, seasonal=False)
    return out.select(*PAIR, "term", "n_obs", *rounded(("r2", "coef", "std_err", "z", "p_value"), 4))


def hac_seasonal(spark, sf):
    frame = regression.activity_frame(lineitem_series(spark, sf), orders_series(spark, sf), "W", (0, 1, 2, 3, 4))
    out = regression.fit_hac(frame, "z_gp_admissions", [f"z_nhs_calls_lag{k}" for k in range(5)], 4)
    return out.select("term", "n_obs", *rounded(("r2", "coef", "std_err", "z", "p_value"), 4))


def train_test(spark, sf):
    frame = pair_frame(canonical(spark, sf), lags=(1,))
    _, scores = regression.fit_train_test(frame, "y", ["x_lag1"], keys=PAIR)
    return scores.select(*PAIR, "n_predictions", *rounded(("mae", "rmse", "r2", "correlation", "baseline_rmse",
                                                           "mse_skill_vs_train_mean"), 4))


QUERIES = {
    "lag_panel": lag_panel,
    "sparse_feature_filter": sparse_features,
    "autoregressive_panel": ar_panel,
    "calls_admissions_frame": calls_frame,
    "clinical_monthly_frame": clinical_frame,
    "term_frame_long": term_frame_long,
    "term_frame_wide": term_frame_wide,
    "complete_cases": complete_cases,
    "chronological_split": chronological,
    "three_way_split": three_way,
    "train_window_zscore": train_zscore,
    "spike_labels": spike_labels,
    "classification_metrics": classification,
    "regression_metrics": regression_metric_rows,
    "ensemble_summary": ensemble,
    "daily_spine": spine,
    "season_calendar": calendar,
    "direct_forecast_features": direct_features,
    "forward_fill": forward_fill,
    "lookback_windows": lookback,
    "future_periods": future_periods,
    "first_value_pivot": first_pivot,
    "hac_ols": hac,
    "hac_ols_seasonal": hac_seasonal,
    "train_test_ols": train_test,
}

GRID_SQL = WEEKLY_SQL + """,
grid AS (
  SELECT s.series_id, s.role, p.period, w.value
  FROM (SELECT DISTINCT series_id, role FROM weekly) s CROSS JOIN (SELECT DISTINCT period FROM weekly) p
  LEFT JOIN weekly w ON w.series_id = s.series_id AND w.period = p.period
)"""

SPLIT_SQL = """i <= greatest(1, CASE WHEN n <= 4 THEN n - 1
  ELSE least(CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT), n - 4) END)"""


def activity_sql(freq, x, y):
    return "WITH " + CANONICAL_SQL + f""",
px AS (SELECT CAST(date_trunc('{freq}', date) AS DATE) AS period, sum(value) AS {x} FROM canonical WHERE role = 'predictive' GROUP BY 1),
py AS (SELECT CAST(date_trunc('{freq}', date) AS DATE) AS period, sum(value) AS {y} FROM canonical WHERE role = 'predicted' GROUP BY 1),
f AS (SELECT period, {x}, {y}, ({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER () AS zx,
             ({y} - avg({y}) OVER ()) / stddev_samp({y}) OVER () AS zy FROM px JOIN py USING (period))"""


TERMS_SQL = "WITH " + CANONICAL_SQL + """,
sums AS (SELECT 'term_' || lower(l_returnflag) AS term, CAST(date_trunc('week', l_shipdate) AS DATE) AS period,
                sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS c FROM lineitem GROUP BY ALL),
o AS (SELECT CAST(date_trunc('week', date) AS DATE) AS period, sum(value) AS y FROM canonical WHERE role = 'predicted' GROUP BY 1),
f AS (SELECT period, y, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS zy FROM o
      WHERE period IN (SELECT period FROM sums)),
g AS (SELECT f.*, t.term, s.c FROM f CROSS JOIN (SELECT DISTINCT term FROM sums) t
      LEFT JOIN sums s ON s.term = t.term AND s.period = f.period),
z AS (SELECT *, (c - avg(c) OVER (PARTITION BY term)) / stddev_samp(c) OVER (PARTITION BY term) AS z FROM g)"""

DAILY_SQL = "WITH " + CANONICAL_SQL + """,
ends AS (SELECT series_id, min(date) AS a, max(date) AS b FROM canonical WHERE role = 'predicted' GROUP BY series_id),
days AS (SELECT series_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM ends),
means AS (SELECT series_id, date, avg(value) AS value FROM canonical WHERE role = 'predicted' GROUP BY ALL),
daily AS (SELECT days.series_id, days.date, means.value FROM days LEFT JOIN means USING (series_id, date))"""

SEASON = """weekofyear(date) AS week_of_year, rnd(sin(2 * pi() * weekofyear(date) / 52), 6) AS sin_week,
       rnd(cos(2 * pi() * weekofyear(date) / 52), 6) AS cos_week"""
SEASON = SEASON.replace("weekofyear(date) AS", "CAST(weekofyear(date) AS INTEGER) AS")

SPIKE_HORIZONS = " UNION ALL ".join(f"""
  SELECT target_id, {h} AS horizon, period, value AS target_value, s AS target_smoothed,
         max(s) OVER (PARTITION BY target_id ORDER BY period ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS future_peak,
         lead(period, {h}) OVER (PARTITION BY target_id ORDER BY period) AS future_window_end FROM smooth""" for h in (1, 2, 3, 4))

ORACLES = {
    "lag_panel": "WITH " + GRID_SQL + """,
lagged AS (""" + " UNION ALL ".join(
        f"""SELECT period, replace(series_id, '::', '__') || '__lag{k}' AS feature,
            lag(value, {k}) OVER (PARTITION BY series_id ORDER BY period) AS value FROM grid WHERE role = 'predictive'"""
        for k in (1, 2, 3, 4)) + """),
panel AS (SELECT w.series_id AS target_id, w.period, w.value AS target, l.feature, l.value
          FROM weekly w JOIN lagged l USING (period) WHERE w.role = 'predicted'),
kept AS (SELECT target_id, feature FROM panel GROUP BY ALL HAVING count(value) >= 0.2 * count(*))
SELECT target_id, period, feature, rnd(target, 4) AS target, rnd(panel.value, 4) AS value
FROM panel JOIN kept USING (target_id, feature)""",
    "sparse_feature_filter": "WITH " + CANONICAL_SQL + """,
more AS (SELECT date, value, series_id, role FROM canonical UNION ALL
         SELECT CAST(ts AS DATE), value, 'events::' || event_type, 'predictive' FROM events),
weekly AS (SELECT series_id, role, CAST(date_trunc('week', date) AS DATE) AS period, avg(value) AS value FROM more GROUP BY ALL),
grid AS (SELECT s.series_id, s.role, p.period, w.value
  FROM (SELECT DISTINCT series_id, role FROM weekly) s CROSS JOIN (SELECT DISTINCT period FROM weekly) p
  LEFT JOIN weekly w ON w.series_id = s.series_id AND w.period = p.period),
lagged AS (""" + " UNION ALL ".join(
        f"""SELECT series_id, role, period, replace(replace(series_id, '::', '__'), ' ', '_') || '__lag{k}' AS feature,
            lag(value, {k}) OVER (PARTITION BY series_id ORDER BY period) AS value FROM grid""" for k in (1, 2)) + """),
panel AS (SELECT w.series_id AS target_id, l.feature, l.value FROM weekly w JOIN lagged l
          ON w.period = l.period AND (l.role = 'predictive' OR l.series_id = w.series_id) WHERE w.role = 'predicted')
SELECT target_id, feature, count(*) AS n_rows, count(value) AS n_filled FROM panel GROUP BY ALL
HAVING count(value) >= 0.2 * count(*)""",
    "autoregressive_panel": "WITH " + GRID_SQL + """,
lagged AS (SELECT series_id AS target_id, period, value AS target, lag(value, 1) OVER w AS lag1, lag(value, 3) OVER w AS lag3
           FROM grid WHERE role = 'predicted' WINDOW w AS (PARTITION BY series_id ORDER BY period)),
full_rows AS (SELECT * FROM lagged WHERE target IS NOT NULL AND lag1 IS NOT NULL AND lag3 IS NOT NULL)
SELECT target_id, period, rnd(target, 4) AS target, rnd(lag1, 4) AS lag1, rnd(lag3, 4) AS lag3,
       CAST(row_number() OVER (PARTITION BY target_id ORDER BY period) AS INTEGER) AS row_index,
       count(*) OVER (PARTITION BY target_id) AS n_rows FROM full_rows""",
    "calls_admissions_frame": activity_sql("week", "nhs_calls", "gp_admissions") + """
SELECT period, rnd(nhs_calls, 2) AS nhs_calls, rnd(gp_admissions, 2) AS gp_admissions, rnd(zx, 6) AS z_nhs_calls,
       rnd(zy, 6) AS z_gp_admissions, rnd(zx, 6) AS z_nhs_calls_lag0, rnd(lag(zx, 1) OVER (ORDER BY period), 6) AS z_nhs_calls_lag1,
       rnd(lag(zx, 2) OVER (ORDER BY period), 6) AS z_nhs_calls_lag2 FROM f""",
    "clinical_monthly_frame": activity_sql("month", "nhs111_calls", "admissions") + """
SELECT period, rnd(zx, 6) AS z_nhs111_calls, rnd(zy, 6) AS z_admissions,
       rnd(lag(zx, 1) OVER (ORDER BY period), 6) AS z_nhs111_calls_lag1,
       rnd(lag(zx, 3) OVER (ORDER BY period), 6) AS z_nhs111_calls_lag3 FROM f""",
    "term_frame_long": TERMS_SQL + """
SELECT period, term, rnd(y, 2) AS gp_admissions, rnd(c, 6) AS count, rnd(zy, 6) AS z_gp_admissions, rnd(z, 6) AS z,
       rnd(z, 6) AS z_lag0, rnd(lag(z, 1) OVER w, 6) AS z_lag1, rnd(lag(z, 2) OVER w, 6) AS z_lag2
FROM z WINDOW w AS (PARTITION BY term ORDER BY period)""",
    "term_frame_wide": TERMS_SQL + """,
l AS (SELECT period, term, z, lag(z, 1) OVER (PARTITION BY term ORDER BY period) AS z1 FROM z)
SELECT period, """ + ", ".join(f"rnd(max(z1) FILTER (WHERE term = 'term_{t}'), 6) AS z_term_{t}_lag1" for t in "anr") + """,
       rnd(max(z) FILTER (WHERE term = 'term_a'), 6) AS z_term_a FROM l GROUP BY period""",
    "complete_cases": TERMS_SQL + """,
l AS (SELECT period, zy, z, lag(z, 4) OVER (PARTITION BY term ORDER BY period) AS z4 FROM z),
p AS (SELECT period, max(zy) AS zy, count(z) AS a, count(z4) AS b FROM l GROUP BY period)
SELECT count(*) FILTER (WHERE zy IS NOT NULL AND a = 3 AND b = 3) AS complete_rows, 6 AS n_predictors,
       count(*) FILTER (WHERE zy IS NOT NULL AND a = 3 AND b = 3) <= 8 AS too_few_rows FROM p""",
    "chronological_split": "WITH " + WEEKLY_SQL + f""",
c AS (SELECT series_id, period, count(*) OVER (PARTITION BY series_id) AS n,
             row_number() OVER (PARTITION BY series_id ORDER BY period) AS i FROM weekly)
SELECT series_id, period, n AS n_rows, CAST(i AS INTEGER) AS row_index,
       CASE WHEN n >= 3 THEN CASE WHEN {SPLIT_SQL} THEN 'train' ELSE 'test' END END AS split FROM c""",
    "three_way_split": "WITH " + WEEKLY_SQL + """,
c AS (SELECT series_id, period, count(*) OVER (PARTITION BY series_id) AS n,
             row_number() OVER (PARTITION BY series_id ORDER BY period) AS i FROM weekly),
d AS (SELECT *, greatest(1, floor(n * 0.2::DOUBLE)) AS t, greatest(1, floor(n * 0.1::DOUBLE)) AS v FROM c)
SELECT series_id, period, CASE WHEN n - t - v <= 0 THEN NULL WHEN i <= n - t - v THEN 'train' WHEN i <= n - t THEN 'valid' ELSE 'test' END AS split_70_10_20,
       CASE WHEN i <= floor(n * 0.70::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.85::DOUBLE) THEN 'valid' ELSE 'test' END AS split_70_15_15 FROM d""",
    "train_window_zscore": "WITH " + WEEKLY_SQL + f""",
c AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, row_number() OVER (PARTITION BY series_id ORDER BY period) AS i FROM weekly),
d AS (SELECT *, CASE WHEN {SPLIT_SQL} THEN 'train' ELSE 'test' END AS split FROM c),
e AS (SELECT *, avg(value) FILTER (WHERE split = 'train') OVER g AS m, stddev_samp(value) FILTER (WHERE split = 'train') OVER g AS s
      FROM d WINDOW g AS (PARTITION BY series_id))
SELECT series_id, period, split, rnd((value - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS value_z FROM e""",
    "spike_labels": "WITH " + GRID_SQL + f""",
smooth AS (SELECT series_id AS target_id, period, value, avg(value) OVER (PARTITION BY series_id ORDER BY period
             ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM grid WHERE role = 'predicted'),
futures AS ({SPIKE_HORIZONS}),
kept AS (SELECT *, count(*) OVER g AS n, row_number() OVER (PARTITION BY target_id, horizon ORDER BY period) AS i
         FROM futures WHERE future_peak IS NOT NULL AND future_window_end IS NOT NULL WINDOW g AS (PARTITION BY target_id, horizon)),
cut AS (SELECT *, CASE WHEN {SPLIT_SQL} THEN 'train' ELSE 'test' END AS split FROM kept),
ends AS (SELECT *, max(period) FILTER (WHERE split = 'train') OVER (PARTITION BY target_id, horizon) AS train_end FROM cut),
purged AS (SELECT * FROM ends WHERE split = 'test' OR future_window_end <= train_end),
stats AS (SELECT target_id, horizon, quantile_cont(target_smoothed, 0.85) AS threshold,
                 quantile_cont(target_smoothed, 0.75) - quantile_cont(target_smoothed, 0.25) AS iqr,
                 stddev_samp(target_smoothed) AS sd FROM purged WHERE split = 'train' GROUP BY ALL),
scored AS (SELECT purged.*, threshold, CASE WHEN iqr > 0 THEN iqr WHEN sd > 0 THEN sd ELSE 1 END AS scale
           FROM purged JOIN stats USING (target_id, horizon)),
final AS (SELECT *, greatest(0, (future_peak - threshold) / scale) AS score FROM scored)
SELECT target_id, horizon, period, split, future_window_end, CAST(future_peak >= threshold AS INTEGER) AS spike,
       CASE WHEN score >= 2 THEN 'severe' WHEN score >= 1 THEN 'moderate' WHEN score >= 0.25 THEN 'mild'
            WHEN score > 0 THEN 'borderline' ELSE 'none' END AS severity_band,
       rnd(target_value, 4) AS target_value, rnd(target_smoothed, 4) AS target_smoothed, rnd(future_peak, 4) AS future_peak,
       rnd(threshold, 4) AS spike_threshold, rnd(scale, 4) AS severity_scale, rnd(score, 4) AS severity_score FROM final""",
    "classification_metrics": """
WITH r AS (SELECT lang, CAST(quality AS DOUBLE) AS y, n_chars / (n_chars + 1500.0::DOUBLE) AS p FROM labels JOIN documents USING (doc_id)),
s AS (SELECT lang, p, count(*) AS n, sum(y) AS pos FROM r GROUP BY ALL),
c AS (SELECT *, sum(n) OVER d AS cn, sum(pos) OVER d AS cp FROM s WINDOW d AS (PARTITION BY lang ORDER BY p DESC)),
ap AS (SELECT lang, sum(pos * cp / cn) / nullif(sum(pos), 0) AS ap,
              sum((n - pos) * (cp - pos / 2)) / nullif(sum(pos) * sum(n - pos), 0) AS auc,
              sum(pos) > 0 AND sum(n - pos) > 0 AS both_classes FROM c GROUP BY lang),
b AS (SELECT lang, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive, avg((p - y)**2) AS brier,
             count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp,
             count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn FROM r GROUP BY lang)
SELECT lang, n, n_positive, rnd(brier, 6) AS brier, rnd(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       rnd(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, rnd(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
       rnd(CASE WHEN both_classes THEN ap END, 6) AS average_precision, rnd(CASE WHEN both_classes THEN auc END, 6) AS roc_auc
FROM b JOIN ap USING (lang)""",
    "regression_metrics": """
WITH r AS (SELECT p_brand, l_extendedprice / l_quantity AS a, p_retailprice AS p FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p_brand, count(*) AS n_predictions, rnd(avg(abs(a - p)), 4) AS mae, rnd(sqrt(avg((a - p)**2)), 4) AS rmse,
       rnd(max(abs(a - p)), 4) AS max_abs_error, rnd(1 - sum((a - p)**2) / (var_pop(a) * count(*)), 4) AS r2,
       rnd(corr(a, p), 4) AS correlation, rnd(avg(abs(a - 1000)), 4) AS mean_abs_baseline_error,
       rnd(sqrt(avg((a - 1000)**2)), 4) AS baseline_rmse, rnd(1 - avg((a - p)**2) / avg((a - 1000)**2), 4) AS mse_skill
FROM r GROUP BY p_brand""",
    "ensemble_summary": "WITH " + WEEKLY_SQL + """
SELECT role, period, rnd(avg(value), 4) AS prediction, rnd(quantile_cont(value, 0.1), 4) AS lower,
       rnd(quantile_cont(value, 0.9), 4) AS upper FROM weekly GROUP BY ALL""",
    "daily_spine": f"""
WITH rows_ AS (
  SELECT CAST(o_orderdate AS DATE) AS date, 'order_price' AS c, o_totalprice AS value, o_orderkey AS i FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT CAST(ts AS DATE), CASE event_type WHEN 'error' THEN 'ev__error' ELSE 'ev_' || event_type END, value, event_id
  FROM events WHERE event_type IN ('view', 'click', 'error')),
wide AS (SELECT date, min_by(value, i) FILTER (WHERE c = 'order_price') AS order_price,
                min_by(value, i) FILTER (WHERE c = 'ev_view') AS ev_view, min_by(value, i) FILTER (WHERE c = 'ev_click') AS ev_click,
                min_by(value, i) FILTER (WHERE c = 'ev__error') AS ev__error
         FROM rows_ WHERE date BETWEEN DATE '1996-01-01' AND DATE '2024-01-20' GROUP BY date)
SELECT *, {SEASON} FROM wide""",
    "season_calendar": "WITH " + CANONICAL_SQL + f""",
ends AS (SELECT series_id, min(date) AS a, max(date) AS b FROM canonical WHERE role = 'predicted' GROUP BY series_id),
days AS (SELECT series_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM ends)
SELECT series_id, date, {SEASON} FROM days""",
    "direct_forecast_features": DAILY_SQL + """
SELECT series_id, date, rnd(value, 4) AS value_t, """ + ", ".join(
        f"rnd(lag(value, {k}) OVER w, 4) AS value_lag{k}" for k in (1, 3, 7, 14)) + ", " + ", ".join(
        f"""rnd(CASE WHEN count(value) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) = {k}
        THEN avg(value) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) END, 4) AS value_roll{k}"""
        for k in (7, 14)) + """, rnd(lead(value, 14) OVER w, 4) AS y_raw, rnd(ln(1 + lead(value, 14) OVER w), 6) AS y
FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY date)""",
    "forward_fill": DAILY_SQL + """
SELECT series_id, date, rnd(last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS value FROM daily""",
    "lookback_windows": "WITH " + WEEKLY_SQL + """,
r AS (SELECT series_id, period, value, lag(value, 3) OVER w AS x0, lag(value, 2) OVER w AS x1, lag(value, 1) OVER w AS x2,
             lead(value, 2) OVER w AS label, lead(period, 2) OVER w AS label_at, row_number() OVER w AS i,
             count(*) OVER (PARTITION BY series_id) AS n FROM weekly WINDOW w AS (PARTITION BY series_id ORDER BY period))
SELECT series_id, period AS window_end, rnd(x0, 4) AS x0, rnd(x1, 4) AS x1, rnd(x2, 4) AS x2, rnd(value, 4) AS x3,
       rnd(label, 4) AS label, label_at, CASE WHEN i + 2 <= floor(n * 0.70::DOUBLE) THEN 'train'
         WHEN i + 2 <= floor(n * 0.85::DOUBLE) THEN 'valid' ELSE 'test' END AS split
FROM r WHERE i >= 4 AND i + 2 <= n""",
    "future_periods": "WITH " + CANONICAL_SQL + """,
e AS (SELECT series_id, max(date) AS last FROM canonical GROUP BY series_id),
s AS (SELECT *, unnest([1, 2, 3]) AS step FROM e)
SELECT series_id, 'W' AS freq, step, CAST(last + 7 * step AS DATE) AS period FROM s UNION ALL
SELECT series_id, 'M', step, CAST(date_trunc('month', last) + to_months(step) AS DATE) FROM s""",
    "first_value_pivot": "SELECT CAST(ts AS DATE) AS date, " + ", ".join(
        f'min_by(value, event_id) FILTER (WHERE event_type = \'{t}\') AS "{t}"' for t in ("click", "error", "purchase", "signup", "view")
    ) + " FROM events WHERE value IS NOT NULL GROUP BY 1",
    "hac_ols": "WITH " + pair_sql((1,)) + """,
s AS (SELECT predictor_id, target_id, count(*) AS n, sum(x_lag1) AS sx, sum(x_lag1 * x_lag1) AS sxx, regr_slope(y, x_lag1) AS b1,
             regr_intercept(y, x_lag1) AS b0, corr(y, x_lag1) ** 2 AS r2 FROM pairs GROUP BY ALL),
e AS (SELECT p.predictor_id, p.target_id, p.period, x_lag1 AS x, y - b0 - b1 * x_lag1 AS e FROM pairs p JOIN s USING (predictor_id, target_id)),
u AS (SELECT *, x * e AS v, """ + ", ".join(
        f"lag(e, {k}) OVER w AS e{k}, lag(x * e, {k}) OVER w AS v{k}" for k in (1, 2, 3)) + """
      FROM e WINDOW w AS (PARTITION BY predictor_id, target_id ORDER BY period)),
m AS (SELECT predictor_id, target_id, sum(e * e)""" + "".join(f" + 2 * {1 - k / 4} * sum(e * e{k})" for k in (1, 2, 3)) + """ AS s00,
             sum(e * v)""" + "".join(f" + {1 - k / 4} * sum(e * v{k} + v * e{k})" for k in (1, 2, 3)) + """ AS s01,
             sum(v * v)""" + "".join(f" + 2 * {1 - k / 4} * sum(v * v{k})" for k in (1, 2, 3)) + """ AS s11 FROM u GROUP BY ALL),
t AS (SELECT *, sxx / (n * sxx - sx * sx) AS i00, -sx / (n * sxx - sx * sx) AS i01, n / (n * sxx - sx * sx) AS i11
      FROM s JOIN m USING (predictor_id, target_id)),
r AS (
  SELECT predictor_id, target_id, 'const' AS term, n, r2, b0 AS b, sqrt(i00 * i00 * s00 + 2 * i00 * i01 * s01 + i01 * i01 * s11) AS se FROM t
  UNION ALL
  SELECT predictor_id, target_id, 'x_lag1', n, r2, b1, sqrt(i01 * i01 * s00 + 2 * i01 * i11 * s01 + i11 * i11 * s11) FROM t),
q AS (SELECT *, abs(b / se) AS z FROM r)
SELECT predictor_id, target_id, term, n AS n_obs, rnd(r2, 4) AS r2, rnd(b, 4) AS coef, rnd(se, 4) AS std_err, rnd(b / se, 4) AS z,
       rnd(CASE WHEN z > 8 THEN 0 ELSE 1 - exp(-z*z/2) * list_sum(list_transform(range(0, 160),
         lambda i: exp((2*i+1) * ln(z/sqrt(2.0)) - lgamma(i + 1.5)))) END, 4) AS p_value FROM q""",
    "hac_ols_seasonal": activity_sql("week", "nhs_calls", "gp_admissions").replace("WITH ", "WITH RECURSIVE ", 1) + """,
l AS (SELECT period, zy AS y, """ + ", ".join(f"lag(zx, {k}) OVER (ORDER BY period) AS l{k}" for k in range(5)) + """ FROM f),
c AS (SELECT * FROM l WHERE y IS NOT NULL AND """ + " AND ".join(f"l{k} IS NOT NULL" for k in range(5)) + """),
dummies AS (SELECT mo, row_number() OVER (ORDER BY mo) + 5 AS j FROM (SELECT DISTINCT month(period) AS mo FROM c)),
cells AS (
  SELECT period, y, 1 AS j, 'const' AS term, 1.0::DOUBLE AS x FROM c UNION ALL """ + " UNION ALL ".join(
        f"SELECT period, y, {k + 2}, 'z_nhs_calls_lag{k}', l{k} FROM c" for k in range(5)) + """ UNION ALL
  SELECT period, y, j, 'month_' || mo, CASE WHEN month(period) = mo THEN 1.0::DOUBLE ELSE 0 END FROM c CROSS JOIN dummies WHERE j > 6),
points AS (SELECT period, any_value(y) AS y, list(x ORDER BY j) AS x FROM cells GROUP BY period),
gram AS (SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS g FROM cells a JOIN cells b USING (period) GROUP BY ALL),
rhs AS (SELECT j AS i, any_value(term) AS term, sum(x * y) AS r FROM cells GROUP BY j),
lines AS (SELECT i, list(g ORDER BY j) AS g FROM gram GROUP BY i),
elim AS (
  SELECT 1::BIGINT AS k, list(list_concat(g, [r], list_transform(g, lambda v, c: CASE WHEN c = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) ORDER BY i) AS m
  FROM lines JOIN rhs USING (i)
  UNION ALL
  SELECT k + 1, list_transform(m, lambda q, i: CASE WHEN i = k THEN list_transform(q, lambda v: v / q[k])
           ELSE list_transform(q, lambda v, c: v - q[k] * m[k][c] / m[k][k]) END) FROM elim WHERE k <= len(m)),
fit AS (SELECT m, list_transform(m, lambda q: q[len(m) + 1]) AS beta FROM elim WHERE k = len(m) + 1),
e AS (SELECT period, y, x, y - list_dot_product(x, beta) AS e FROM points, fit),
score AS (SELECT 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2, count(*) AS n_obs FROM e),
d AS (SELECT i, term, beta[i] AS b, period, e * list_dot_product(m[i][len(m) + 2:], x) AS d FROM e, fit, rhs),
lagged AS (SELECT *, """ + ", ".join(f"lag(d, {k}) OVER (PARTITION BY i ORDER BY period) AS d{k}" for k in range(1, 5)) + """ FROM d),
r AS (SELECT term, b, sqrt(sum(d * d)""" + "".join(f" + 2 * {round(1 - k / 5, 1)} * sum(d * d{k})" for k in range(1, 5)) + """) AS se FROM lagged GROUP BY term, b),
q AS (SELECT *, abs(b / se) AS z FROM r)
SELECT term, n_obs, rnd(r2, 4) AS r2, rnd(b, 4) AS coef, rnd(se, 4) AS std_err, rnd(b / se, 4) AS z,
       rnd(CASE WHEN z > 8 THEN 0 ELSE 1 - exp(-z*z/2) * list_sum(list_transform(range(0, 160),
         lambda i: exp((2*i+1) * ln(z/sqrt(2.0)) - lgamma(i + 1.5)))) END, 4) AS p_value FROM q, score""",
    "train_test_ols": "WITH " + pair_sql((1,)) + f""",
c AS (SELECT *, count(*) OVER (PARTITION BY predictor_id, target_id) AS n,
             row_number() OVER (PARTITION BY predictor_id, target_id ORDER BY period) AS i FROM pairs),
d AS (SELECT *, {SPLIT_SQL} AS train FROM c),
f AS (SELECT predictor_id, target_id, regr_slope(y, x_lag1) AS b1, regr_intercept(y, x_lag1) AS b0, avg(y) AS m FROM d WHERE train GROUP BY ALL),
p AS (SELECT d.*, b0 + b1 * x_lag1 AS p, m FROM d JOIN f USING (predictor_id, target_id) WHERE NOT train)
SELECT predictor_id, target_id, count(*) AS n_predictions, rnd(avg(abs(y - p)), 4) AS mae, rnd(sqrt(avg((y - p)**2)), 4) AS rmse,
       rnd(1 - sum((y - p)**2) / (var_pop(y) * count(*)), 4) AS r2, rnd(corr(y, p), 4) AS correlation,
       rnd(sqrt(avg((y - m)**2)), 4) AS baseline_rmse, rnd(1 - avg((y - p)**2) / avg((y - m)**2), 4) AS mse_skill_vs_train_mean
FROM p GROUP BY ALL""",
}
