"""Canonical series, roll-ups, catalogues, filters, cleaning and site features."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clean, frames, profile, ranks, reshape, rollup
from ..operators.correlation import correlation_long
from .inputs import CANONICAL_SQL, R, SITES_SQL, WEEKLY_SQL, canonical, event_series, orders_series, rounded, sites, table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

EXPECTED = (
    ("predictive", "lineitem", "lineitem.parquet"),
    ("predictive", "events", "events.parquet"),
    ("predicted", "orders", "orders.parquet"),
    ("predicted", "documents", "documents.parquet"),
)


def weekly_mean(spark, sf):
    return rollup.roll_up(canonical(spark, sf)).select("series_id", "role", "period", R("value", 4).alias("value"))


def monthly_sum(spark, sf):
    return rollup.roll_up(canonical(spark, sf), "M", "sum").select("series_id", "role", "period", R("value", 2).alias("value"))


def wide_panel(spark, sf):
    wide = rollup.wide_panel(rollup.roll_up(canonical(spark, sf)))
    return wide.select("period", *[R(F.col(f"`{c}`"), 4).alias(c) for c in wide.columns if c != "period"])


def zscores(spark, sf):
    rows = clean.within_series_zscore(clean.add_log_signal(clean.add_time_features(sites(spark, sf))))
    return rows.select("event_id", "country", "pathogen", "site_id", "date", "week", "year", "month",
                       R("log10_value", 6).alias("log10_value"), R("zscore_within_series", 6).alias("zscore_within_series"))


def day_chunk():
    """A day, or some of the rows without one: no chunk grows with the table's undated rows."""
    return F.struct(F.col("date").isNull().alias("undated"), "date", F.expr("event_id div 100000").alias("part"))


def rolling(spark, sf):
    rows = clean.add_log_signal(sites(spark, sf))
    out = clean.rolling_features(rows, keys=("country", "pathogen"), order=("date", "event_id"), chunk=day_chunk())
    return out.select("event_id", *rounded(("rolling_3_log10_value", "weekly_change_rolling_3_log10_value"), 6))


def site_lags(spark, sf):
    out = clean.group_lags(sites(spark, sf), ["value"], [1, 2, 5], ["country", "site_id"], ["date", "event_id"], day_chunk())
    return out.select("event_id", "value_lag1", "value_lag2", "value_lag5")


def latest(spark, sf):
    rows = clean.within_series_zscore(clean.add_log_signal(sites(spark, sf)))
    return clean.latest_signal_summary(rows, tie="event_id").select(
        "country", "pathogen", "latest_date", "sites", R("median_latest_z", 6).alias("median_latest_z"))


def event_ranks(spark, sf):
    return ranks.value_ranks(table(spark, sf, "events"), ["event_type"], "value")


def price_ranks(spark, sf):
    """One group, nearly every value its own."""
    return ranks.value_ranks(table(spark, sf, "orders"), [], "o_totalprice")


def signal_ranking(spark, sf):
    return clean.ranked_signals(latest(spark, sf)).select("country", "pathogen", "median_latest_z", "place")


def day_first_columns(spark, sf):
    """The same days as text with the day first, with the month first and in ISO form; one order holds for a column."""
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, sf, "orders").select("o_orderkey", F.date_format(day, "dd/MM/yyyy").alias("a"), F.date_format(day, "M/d/yyyy").alias("b"),
                                             F.date_format(day, "yyyy-MM-dd").alias("c"))
    return rows.select("o_orderkey", *[frames.column_day(rows, k).alias(name) for k, name in (("a", "day_first"), ("b", "month_first"), ("c", "iso"))])


def coverage_pivot(spark, sf):
    return rollup.pivot_counts(clean.coverage(sites(spark, sf)), "country", "pathogen", "n_observations", ["k0", "k1", "k2"])


def quality(spark, sf):
    raw = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_shipdate").cast("date").alias("d"),
                                              F.when(F.col("l_linenumber") != 7, F.col("l_discount") - 0.02).alias("v"))
    return clean.quality_report(raw, ["l_returnflag"], F.col("d"), R("v", 4))


def column_profile(spark, sf):
    out = profile.describe(table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")))
    return out.select("column", "count", "missing", "missing_pct", "unique", "top", "freq",
                      *rounded(("mean", "std", "min", "p25", "p50", "p75", "max"), 4))


def number_cleaning(spark, sf):
    text = F.concat(F.format_number("o_totalprice", 2), F.when(F.col("o_orderkey") % 5 == 0, "*").when(
        F.col("o_orderkey") % 7 == 0, " x").otherwise(""))
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", S.to_number("t").alias("as_number"), S.to_count("t").alias("as_count"),
                       R(S.log1p_clipped(S.to_count("t") - 1000), 6).alias("log1p_clipped"))


def date_coercion(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    text = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy/MM/dd"))
            .when(k == 2, F.date_format(d, "MM/dd/yyyy")).when(k == 3, "not-a-date").when(k == 4, F.date_format(d, "yyyy"))
            .otherwise(F.date_format(d, "yyyy-MM-dd HH:mm:ss")))
    rows = table(spark, sf, "orders").select(
        "o_orderkey", text.alias("t"), F.concat(F.date_format(d, "yyyyMMdd"), F.lit(".0")).alias("c"),
        F.when(k == 3, F.lit(-10000)).otherwise(F.year(d)).alias("y"))
    return rows.select("o_orderkey", S.to_day("t").alias("day"), S.from_yyyymmdd("c").alias("compact"),
                       S.year_start("y").alias("year_start"))


def tokens(spark, sf):
    part = table(spark, sf, "part")
    return part.select(
        "p_partkey", S.safe_token(F.concat_ws("  ", "p_brand", "p_name")).alias("token"),
        S.predictor_token(F.concat(F.lit("*"), F.col("p_brand"), F.lit("/"), F.col("p_type"))).alias("predictor"),
        S.feature_name(F.concat(F.lit("part::"), F.col("p_name"), F.lit("/"), F.col("p_type")), F.col("p_size")).alias("feature"),
        S.term_label(F.concat(F.lit("/x/time_series_GB_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" (1).csv"))).alias("label"),
        S.join_parts(" / ", "p_brand", F.when(F.col("p_size") > 25, F.col("p_type")), F.lit(" "), "p_name").alias("joined"),
        S.mapped_name("p_type", {"ECONOMY": "eco", "PROMO": "promo"}, "part").alias("mapped"))


def chosen_series(spark, sf):
    """A target and the chosen predictors, between two dates."""
    df = canonical(spark, sf)
    target = F.col("series_id") == "orders::1-URGENT"
    chosen = (F.col("role") == "predictive") & F.col("series_id").isin("lineitem::A", "lineitem::N")
    kept = df.where((target | chosen) & F.col("date").between("1996-01-01", "1997-12-31"))
    return kept.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"),
                                         F.max("date").alias("last_date"))


def frequent_series(spark, sf):
    """Series of one nation's customers with at least ten orders."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    series = orders.select(F.col("c_name").alias("series_id"), F.col("o_totalprice").alias("value"))
    return rollup.enough_observations(series, 10).groupBy("series_id").agg(F.count("value").alias("n_obs"),
                                                                          R(F.avg("value"), 4).alias("mean_value"))


def upsert(spark, sf):
    new = event_series(spark, sf).unionByName(
        orders_series(spark, sf).where(F.col("series_name") == "5-LOW").withColumn("value", F.col("value") * 2))
    return rollup.upsert(canonical(spark, sf), new).groupBy("series_id", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), R(F.sum("value"), 2).alias("total"))


def correlation(spark, sf):
    rolled = rollup.roll_up(canonical(spark, sf)).drop("role")
    return correlation_long(rolled, block=4).select("series_a", "series_b", "n_shared", R("correlation", 6).alias("correlation"))


def custom(spark, sf):
    docs = table(spark, sf, "events").select(F.col("ts").cast("string").alias("when"), F.get_json_object("props", "$.k").alias("cases"))
    new = clean.custom_series(docs, "when", "cases", "custom::k", "Custom k", "predictive", "events.parquet")
    return rollup.upsert(orders_series(spark, sf), new, ["custom::k"]).groupBy("series_id", "role", "dataset_family").agg(
        F.count(F.lit(1)).alias("n_rows"), R(F.sum("value"), 2).alias("total"), F.max("date").alias("last_date"))


def processed(spark, sf):
    rows = sites(spark, sf).drop("event_id").withColumn("source_file", F.lit("events.parquet"))
    return reshape.processed_series(rows).groupBy("series_id", "series_name", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), R(F.avg("value"), 4).alias("mean_value"))


def group_week(spark, sf):
    rows = clean.add_time_features(sites(spark, sf))
    return rollup.group_period_mean(rows, "country", "week", "value", F.lower("pathogen") == "k1").select(
        "country", "week", R("value", 4).alias("value"))


def weekly_counts(spark, sf):
    return (orders_series(spark, sf).groupBy(S.period("date").alias("period")).agg(
        F.avg("value").alias("m"), F.count(F.lit(1)).alias("n_observations"))
        .select("period", R("m", 4).alias("mean_value"), "n_observations", R(S.log1p_clipped("m"), 6).alias("log1p_mean")))


def last_periods(spark, sf):
    """The twelve newest weeks of every series."""
    newest = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("period").desc()))
    rolled = rollup.roll_up(canonical(spark, sf)).withColumn("place", newest).where(F.col("place") <= 12)
    return rolled.select("series_id", "place", "period", R("value", 4).alias("value"))


def top_parts(spark, sf):
    spent = table(spark, sf, "lineitem").groupBy("l_partkey").agg(R(F.sum("l_extendedprice"), 2).alias("total"))
    return spent.orderBy(F.col("total").desc_nulls_last(), "l_partkey").limit(20)


def z_mean(spark, sf):
    """Mean over all predictors' z-scores per week."""
    rolled = rollup.roll_up(canonical(spark, sf).where(F.col("role") == "predictive"))
    z = clean.within_series_zscore(rolled, "value", ("series_id",), "z")
    return rollup.row_wise_mean(z, "period", "z", "z_mean").select("period", R("z_mean", 6).alias("z_mean"))


QUERIES = {
    "canonical_series": canonical,
    "weekly_mean": weekly_mean,
    "monthly_sum": monthly_sum,
    "series_catalogue": lambda s, sf: rollup.series_catalogue(canonical(s, sf)),
    "series_summary": lambda s, sf: rollup.series_summary(canonical(s, sf)),
    "family_counts": lambda s, sf: rollup.family_counts(canonical(s, sf)),
    "family_status": lambda s, sf: rollup.family_status(canonical(s, sf), EXPECTED),
    "role_counts": lambda s, sf: rollup.role_counts(canonical(s, sf)),
    "wide_panel": wide_panel,
    "within_series_zscore": zscores,
    "rolling_features": rolling,
    "site_lags": site_lags,
    "latest_signal_summary": latest,
    "signal_ranking": signal_ranking,
    "event_value_ranks": event_ranks,
    "price_ranks": price_ranks,
    "day_first_columns": day_first_columns,
    "coverage": lambda s, sf: clean.coverage(sites(s, sf)),
    "coverage_pivot": coverage_pivot,
    "quality_report": quality,
    "column_profile": column_profile,
    "column_facts": lambda s, sf: profile.column_facts(table(s, sf, "events")),
    "table_size": lambda s, sf: profile.table_size(table(s, sf, "lineitem")),
    "number_cleaning": number_cleaning,
    "date_coercion": date_coercion,
    "name_tokens": tokens,
    "chosen_series": chosen_series,
    "frequent_series": frequent_series,
    "upsert_series": upsert,
    "custom_series": custom,
    "processed_series": processed,
    "correlation_long": correlation,
    "group_week_mean": group_week,
    "weekly_counts": weekly_counts,
    "last_periods": last_periods,
    "top_parts": top_parts,
    "row_wise_mean": z_mean,
}

ZSITES_SQL = SITES_SQL + """,
logs AS (SELECT *, CASE WHEN value > 0 THEN log10(value) END AS lv FROM sites),
zed AS (
  SELECT *, CASE WHEN stddev_samp(lv) OVER g > 0 THEN (lv - avg(lv) OVER g) / stddev_samp(lv) OVER g END AS z
  FROM logs WINDOW g AS (PARTITION BY country, pathogen, site_id)
)"""

ORACLES = {
    "canonical_series": "WITH " + CANONICAL_SQL + " SELECT * FROM canonical",
    "weekly_mean": "WITH " + WEEKLY_SQL + " SELECT series_id, role, period, rnd(value, 4) AS value FROM weekly",
    "monthly_sum": "WITH " + CANONICAL_SQL + """
SELECT series_id, role, CAST(date_trunc('month', date) AS DATE) AS period, rnd(sum(value), 2) AS value
FROM canonical GROUP BY ALL""",
    "series_catalogue": "WITH " + CANONICAL_SQL + """
SELECT series_id, min(role) AS role, min(dataset_family) AS dataset_family, min(series_name) AS series_name,
       count(value) AS n_obs, min(date) AS date_min, max(date) AS date_max FROM canonical GROUP BY series_id""",
    "series_summary": "WITH " + CANONICAL_SQL + """
SELECT role, dataset_family, series_id, series_name, source_file, min(date) AS start_date, max(date) AS end_date,
       count(*) AS n_observations FROM canonical GROUP BY ALL""",
    "family_counts": "WITH " + CANONICAL_SQL + """
SELECT role, dataset_family, count(DISTINCT series_id) AS n_series FROM canonical GROUP BY ALL""",
    "family_status": "WITH " + CANONICAL_SQL + """,
want(role, dataset_family, expected_location) AS (VALUES
  ('predictive', 'lineitem', 'lineitem.parquet'), ('predictive', 'events', 'events.parquet'),
  ('predicted', 'orders', 'orders.parquet'), ('predicted', 'documents', 'documents.parquet')),
found AS (SELECT role, dataset_family, count(DISTINCT series_id) AS n FROM canonical GROUP BY ALL)
SELECT role, dataset_family, expected_location, coalesce(n, 0) AS n_series_found, coalesce(n, 0) > 0 AS available
FROM want LEFT JOIN found USING (role, dataset_family)""",
    "role_counts": "WITH " + CANONICAL_SQL + " SELECT role, count(DISTINCT series_id) AS n_series FROM canonical GROUP BY role",
    "wide_panel": "WITH " + WEEKLY_SQL + " SELECT period, " + ", ".join(
        f"rnd(max(value) FILTER (WHERE series_id = '{c}'), 4) AS \"{c}\""
        for c in ["lineitem::A", "lineitem::N", "lineitem::R", *[f"orders::{p}" for p in PRIORITIES]]) + " FROM weekly GROUP BY period",
    "within_series_zscore": "WITH " + ZSITES_SQL + """
SELECT event_id, country, pathogen, site_id, date, CAST(date_trunc('week', date) AS DATE) AS week,
       CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, rnd(lv, 6) AS log10_value,
       rnd(z, 6) AS zscore_within_series FROM zed""",
    "rolling_features": "WITH " + ZSITES_SQL + """, rolled AS (
  SELECT event_id, avg(lv) OVER (PARTITION BY country, pathogen ORDER BY date, event_id
                                 ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r,
         avg(lv) OVER (PARTITION BY country, pathogen ORDER BY date, event_id
                       ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b
  FROM logs)
SELECT event_id, rnd(r, 6) AS rolling_3_log10_value, rnd(r - b, 6) AS weekly_change_rolling_3_log10_value FROM rolled""",
    "site_lags": "WITH " + SITES_SQL + """
SELECT event_id, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2, lag(value, 5) OVER w AS value_lag5
FROM sites WINDOW w AS (PARTITION BY country, site_id ORDER BY date, event_id)""",
    "latest_signal_summary": "WITH " + ZSITES_SQL + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY country, pathogen, site_id ORDER BY date DESC NULLS FIRST, event_id DESC) AS r
  FROM zed)
SELECT country, pathogen, max(date) AS latest_date, count(DISTINCT site_id) AS sites,
       rnd(quantile_cont(z, 0.5), 6) AS median_latest_z FROM ranked WHERE r = 1 GROUP BY ALL""",
    **{name: f"""
SELECT {keys} {value}, count(*) AS n, CAST(sum(count(*)) OVER ({part} ORDER BY {value}) AS BIGINT) AS n_upto
FROM {source} WHERE {value} IS NOT NULL GROUP BY {keys} {value}""" for name, keys, value, part, source in (
        ("event_value_ranks", "event_type,", "value", "PARTITION BY event_type", "events"), ("price_ranks", "", "o_totalprice", "", "orders"))},
    "signal_ranking": "WITH " + ZSITES_SQL + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY country, pathogen, site_id ORDER BY date DESC NULLS FIRST, event_id DESC) AS r FROM zed),
summary AS (SELECT country, pathogen, rnd(quantile_cont(z, 0.5), 6) AS median_latest_z FROM ranked WHERE r = 1 GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY pathogen ORDER BY median_latest_z DESC NULLS LAST, country) AS INTEGER) AS place FROM summary""",
    "day_first_columns": """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day_first, CAST(o_orderdate AS DATE) AS month_first, CAST(o_orderdate AS DATE) AS iso FROM orders""",
    "coverage": "WITH " + SITES_SQL + """
SELECT country, pathogen, min(date) AS start_date, max(date) AS end_date, count(*) AS n_observations,
       count(DISTINCT site_id) AS n_sites FROM sites GROUP BY ALL""",
    "coverage_pivot": "WITH " + SITES_SQL + """
SELECT country, """ + ", ".join(f"count(*) FILTER (WHERE pathogen = 'k{i}') AS k{i}" for i in range(3)) + " FROM sites GROUP BY country",
    "quality_report": """
WITH raw AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS d,
                    rnd(CASE WHEN l_linenumber <> 7 THEN l_discount - 0.02::DOUBLE END, 4) AS v FROM lineitem),
good AS (SELECT *, d IS NOT NULL AND v IS NOT NULL AS ok FROM raw)
SELECT l_returnflag, count(*) AS raw_rows, count(*) FILTER (WHERE ok) AS clean_rows,
       count(*) FILTER (WHERE NOT ok) AS dropped_rows, min(d) FILTER (WHERE ok) AS min_date,
       max(d) FILTER (WHERE ok) AS max_date,
       count(*) FILTER (WHERE ok) - count(DISTINCT CASE WHEN ok THEN d END) AS duplicate_dates,
       count(*) FILTER (WHERE ok AND v < 0) AS negative_values, count(*) FILTER (WHERE ok AND v = 0) AS zero_values
FROM good GROUP BY l_returnflag""",
    "column_profile": " UNION ALL ".join(
        [f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing,
   round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct, NULL::BIGINT AS "unique", NULL::VARCHAR AS top,
   NULL::BIGINT AS freq, rnd(avg({c}), 4) AS mean, rnd(stddev_samp({c}), 4) AS std, rnd(min({c}), 4) AS min,
   rnd(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25, rnd(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50,
   rnd(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75, rnd(max({c}), 4) AS max FROM orders"""
         for c in ("o_orderkey", "o_custkey", "o_totalprice")]
        + [f"""SELECT '{c}', count({c}), count(*) - count({c}), round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2),
   count(DISTINCT {c}), (SELECT {c} FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
   (SELECT count(*) FROM orders GROUP BY {c} ORDER BY count(*) DESC LIMIT 1),
   NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM orders)"""
           .replace("FROM orders GROUP", "FROM (SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM orders) GROUP")
           for c in ("o_orderdate", "o_orderstatus", "o_orderpriority")]),
    "column_facts": """
SELECT 'event_id' AS "column", 0 AS position, count(*) AS n_rows, count(event_id) AS n_filled, 0::BIGINT AS n_dates,
       count(event_id) AS n_numbers FROM events UNION ALL
SELECT 'ts', 1, count(*), count(ts), count(ts), 0 FROM events UNION ALL
SELECT 'user_id', 2, count(*), count(user_id), 0, count(user_id) FROM events UNION ALL
SELECT 'event_type', 3, count(*), count(event_type), count(TRY_CAST(event_type AS DATE)), count(TRY_CAST(event_type AS DOUBLE)) FROM events UNION ALL
SELECT 'value', 4, count(*), count(value), 0, count(value) FROM events UNION ALL
SELECT 'props', 5, count(*), count(props), count(TRY_CAST(props AS DATE)), count(TRY_CAST(props AS DOUBLE)) FROM events""",
    "table_size": "SELECT count(*) AS n_rows, 11 AS n_columns, 8 AS n_numeric_columns FROM lineitem",
    "number_cleaning": """
WITH t AS (SELECT o_orderkey, round(o_totalprice, 2) AS v FROM orders),
n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN v END AS as_number,
             CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 <> 0 THEN v END AS as_count FROM t)
SELECT *, CASE WHEN as_count IS NOT NULL THEN rnd(ln(1 + greatest(as_count - 1000, 0)), 6) END AS log1p_clipped FROM n""",
    "date_coercion": """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 5) THEN CAST(o_orderdate AS DATE) END AS day,
       CAST(o_orderdate AS DATE) AS compact,
       CASE WHEN o_orderkey % 6 <> 3 THEN make_date(year(o_orderdate), 1, 1) END AS year_start FROM orders""",
    "name_tokens": r"""
SELECT p_partkey, trim(regexp_replace(lower(p_brand || '  ' || p_name), '[^a-z0-9]+', '_', 'g'), '_') AS token,
       lower(trim(regexp_replace('*' || p_brand || '/' || p_type, '[^0-9A-Za-z]+', '_', 'g'), '_')) AS predictor,
       replace(replace('part__' || p_name || '_' || p_type, ' ', '_'), '/', '_') || '__lag' || CAST(p_size AS VARCHAR) AS feature,
       p_name || ' (1)' AS label,
       p_brand || CASE WHEN p_size > 25 THEN ' / ' || p_type ELSE '' END || ' / ' || p_name AS joined,
       CASE p_type WHEN 'ECONOMY' THEN 'eco' WHEN 'PROMO' THEN 'promo' ELSE 'part__' || p_type END AS mapped FROM part""",
    "chosen_series": "WITH " + CANONICAL_SQL + """
SELECT series_id, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM canonical
WHERE (series_id = 'orders::1-URGENT' OR (role = 'predictive' AND series_id IN ('lineitem::A', 'lineitem::N')))
  AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY series_id""",
    "frequent_series": """
SELECT c_name AS series_id, count(o_totalprice) AS n_obs, rnd(avg(o_totalprice), 4) AS mean_value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name HAVING count(o_totalprice) >= 10""",
    "upsert_series": "WITH " + CANONICAL_SQL + """,
merged AS (
  SELECT series_id, role, value FROM canonical WHERE series_id <> 'orders::5-LOW'
  UNION ALL SELECT series_id, role, value * 2 FROM canonical WHERE series_id = 'orders::5-LOW'
  UNION ALL SELECT 'events::' || event_type, 'predictive', value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)
SELECT series_id, role, count(*) AS n_rows, rnd(sum(value), 2) AS total FROM merged GROUP BY ALL""",
    "custom_series": "WITH " + CANONICAL_SQL + """,
merged AS (
  SELECT series_id, role, dataset_family, value, date FROM canonical WHERE role = 'predicted'
  UNION ALL SELECT 'custom::k', 'predictive', 'custom', CAST(props->>'k' AS DOUBLE), CAST(ts AS DATE) FROM events)
SELECT series_id, role, dataset_family, count(*) AS n_rows, rnd(sum(value), 2) AS total, max(date) AS last_date
FROM merged WHERE value IS NOT NULL AND date IS NOT NULL GROUP BY ALL""",
    "processed_series": "WITH " + SITES_SQL + """,
named AS (SELECT *, country || ' / ' || pathogen || coalesce(' / ' || site_id, '') AS name FROM sites
          WHERE date IS NOT NULL AND value IS NOT NULL)
SELECT 'wastewater_processed::' || name AS series_id, name AS series_name, 'predictive' AS role, count(*) AS n_rows,
       rnd(avg(value), 4) AS mean_value FROM named GROUP BY ALL""",
    "correlation_long": "WITH " + WEEKLY_SQL + """
SELECT a.series_id AS series_a, b.series_id AS series_b, count(*) AS n_shared, rnd(corr(a.value, b.value), 6) AS correlation
FROM weekly a JOIN weekly b ON a.period = b.period AND a.series_id < b.series_id GROUP BY ALL""",
    "group_week_mean": "WITH " + SITES_SQL + """
SELECT country, CAST(date_trunc('week', date) AS DATE) AS week, rnd(avg(value), 4) AS value FROM sites
WHERE lower(pathogen) = 'k1' GROUP BY ALL""",
    "weekly_counts": """
WITH w AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS period, avg(o_totalprice) AS m, count(*) AS n
           FROM orders GROUP BY ALL)
SELECT period, rnd(m, 4) AS mean_value, n AS n_observations, rnd(ln(1 + greatest(m, 0)), 6) AS log1p_mean FROM w""",
    "last_periods": "WITH " + WEEKLY_SQL + """
SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY period DESC) AS INTEGER) AS place, period, rnd(value, 4) AS value
FROM weekly QUALIFY place <= 12""",
    "top_parts": """
WITH t AS (SELECT l_partkey, rnd(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_partkey)
SELECT * FROM t ORDER BY total DESC NULLS LAST, l_partkey LIMIT 20""",
    "row_wise_mean": "WITH " + WEEKLY_SQL + """,
z AS (SELECT period, (value - avg(value) OVER g) / stddev_samp(value) OVER g AS z FROM weekly WHERE role = 'predictive'
      WINDOW g AS (PARTITION BY series_id))
SELECT period, rnd(avg(z), 6) AS z_mean FROM z GROUP BY period""",
}
