"""Canonical series and other inputs derived from the given tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollup import rolled_series

COLUMNS = ["date", "value", "series_id", "role", "dataset_family", "series_name", "source_file"]


def R(column, digits: int):
    """Round for comparison: noise below 1e-8 is removed first, so ties fall the same way in every engine."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(F.round(c, 8), digits)


def rounded(names, digits: int) -> list:
    return [R(n, digits).alias(n) for n in names]


def expand_rounding(sql: str) -> str:
    """rnd(expr, digits) in oracle SQL -> the same two-step rounding as R."""
    while (start := sql.find("rnd(")) >= 0:
        depth, i, comma = 0, start + 3, None
        while True:
            ch = sql[i]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = i
            if depth == 0:
                break
            i += 1
        expr, digits = sql[start + 4:comma], sql[comma + 1:i].strip()
        sql = (sql[:start] + f"CAST(round(CAST({expr} AS DECIMAL(38,8)), {digits}) AS DOUBLE)" + sql[i + 1:])
    return sql


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stamp(df: DataFrame, date: str, value: str, label: str, role: str, family: str, file: str) -> DataFrame:
    return df.select(
        F.col(date).cast("date").alias("date"), F.col(value).alias("value"),
        F.concat(F.lit(family + "::"), F.col(label)).alias("series_id"), F.lit(role).alias("role"),
        F.lit(family).alias("dataset_family"), F.col(label).alias("series_name"), F.lit(file).alias("source_file"),
    ).dropna(subset=["date", "value"])


def orders_series(spark: SparkSession, sf: str) -> DataFrame:
    return stamp(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "o_orderpriority", "predicted", "orders",
                 "orders.parquet")


def lineitem_series(spark: SparkSession, sf: str) -> DataFrame:
    return stamp(table(spark, sf, "lineitem"), "l_shipdate", "l_quantity", "l_returnflag", "predictive", "lineitem",
                 "lineitem.parquet")


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    return lineitem_series(spark, sf).unionByName(orders_series(spark, sf))


def weekly_series(spark: SparkSession, sf: str) -> DataFrame:
    """canonical() rolled up by week once, for queries that use it several times."""
    return rolled_series(canonical(spark, sf), "W", "mean")


def event_series(spark: SparkSession, sf: str) -> DataFrame:
    return stamp(table(spark, sf, "events"), "ts", "value", "event_type", "predictive", "events", "events.parquet")


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Site-level rows: one site per user and event type; every seventh user has no site id."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("country"), F.concat(F.lit("k"), F.col("event_id") % 3).alias("pathogen"),
        F.when(F.col("user_id") % 7 != 0, F.col("user_id").cast("string")).alias("site_id"),
        F.when(F.col("event_id") % 101 != 0, F.col("ts").cast("date")).alias("date"),
        (F.col("value") - 5).alias("value"), "event_id")


CANONICAL_SQL = """
canonical AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_quantity AS value, 'lineitem::' || l_returnflag AS series_id,
         'predictive' AS role, 'lineitem' AS dataset_family, l_returnflag AS series_name,
         'lineitem.parquet' AS source_file
  FROM lineitem WHERE l_shipdate IS NOT NULL AND l_quantity IS NOT NULL
  UNION ALL
  SELECT CAST(o_orderdate AS DATE), o_totalprice, 'orders::' || o_orderpriority, 'predicted', 'orders',
         o_orderpriority, 'orders.parquet'
  FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL
)"""

WEEKLY_SQL = CANONICAL_SQL + """,
weekly AS (
  SELECT series_id, role, CAST(date_trunc('week', date) AS DATE) AS period, avg(value) AS value
  FROM canonical GROUP BY ALL
)"""

SITES_SQL = """
sites AS (
  SELECT event_type AS country, 'k' || CAST(event_id % 3 AS VARCHAR) AS pathogen,
         CASE WHEN user_id % 7 <> 0 THEN CAST(user_id AS VARCHAR) END AS site_id,
         CASE WHEN event_id % 101 <> 0 THEN CAST(ts AS DATE) END AS date,
         value - 5 AS value, event_id
  FROM events
)"""


def pair_sql(lags: tuple[int, ...]) -> str:
    """pairs(predictor_id, target_id, period, y, x_lag..): complete rows, lags taken after the join."""
    lag = ", ".join(
        (f"lag(x, {k}) OVER p AS x_lag{k}" if k else "x AS x_lag0") for k in lags)
    full = " AND ".join(f"x_lag{k} IS NOT NULL" for k in lags)
    return WEEKLY_SQL + f""",
lagged AS (
  SELECT a.series_id AS predictor_id, b.series_id AS target_id, a.period, b.value AS y, a.value AS x
  FROM weekly a JOIN weekly b ON a.period = b.period AND a.role = 'predictive' AND b.role = 'predicted'
), pairs AS (
  SELECT * FROM (
    SELECT predictor_id, target_id, period, y, {lag} FROM lagged
    WINDOW p AS (PARTITION BY predictor_id, target_id ORDER BY period)
  ) WHERE {full}
)"""
