"""Cleaning and per-site features of raw observations."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import CANONICAL, ROLES
from .frames import column_day, null_safe_join
from .ordered import over_chunks
from .quantiles import exact_quantiles

SITE_KEYS = ("country", "pathogen", "site_id")


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[S.header_name(c) for c in df.columns])


def add_time_features(df: DataFrame, date: str = "date") -> DataFrame:
    out = df.withColumn("date", column_day(df, date))
    return (out.withColumn("week", S.period("date", "W")).withColumn("year", F.year("date"))
            .withColumn("month", F.month("date")))


def add_log_signal(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn("log10_value", S.log10_positive(value))


def within_series_zscore(df: DataFrame, value: str = "log10_value", keys: Sequence[str] = SITE_KEYS,
                         name: str = "zscore_within_series") -> DataFrame:
    """z-scores within each group; NULL keys form groups of their own.

    The statistics are a partial aggregate joined back, so a site with most of the rows is spread over
    many tasks; a window would put it in one.
    """
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    joined = null_safe_join(df, stats, keys)
    return joined.withColumn(name, S.zscore(value, "_mean", "_sd")).drop("_mean", "_sd")


def rolling_features(df: DataFrame, value: str = "log10_value", keys: Sequence[str] = SITE_KEYS, window: int = 3,
                     order: Sequence[str] = ("date",), chunk: Column | None = None) -> DataFrame:
    """Trailing mean over the last `window` rows and its change from the row before.

    Row order needs a tie-break: give the columns of order down to a unique one.
    """
    rolling, change = f"rolling_{window}_{value}", f"weekly_change_rolling_{window}_{value}"

    def features(rows: DataFrame, w) -> DataFrame:
        mean = F.avg(value).over(w.rowsBetween(-(window - 1), 0))
        before = F.avg(value).over(w.rowsBetween(-window, -1))
        return rows.select("*", mean.alias(rolling), (mean - before).alias(change),
                           F.row_number().over(w).alias("_row"))

    out = over_chunks(df, keys, list(order), window, features, chunk)
    return out.drop("_row")


def group_lags(df: DataFrame, values: Sequence[str], lags: Sequence[int], keys: Sequence[str] = (),
               order: Sequence[str] = ("period",), chunk: Column | None = None) -> DataFrame:
    """value_lagK columns by row within each group; every lag shares one sort."""
    def features(rows: DataFrame, w) -> DataFrame:
        return rows.select("*", *[(F.lag(v, k).over(w) if k else F.col(v)).alias(f"{v}_lag{k}")
                                  for v in values for k in lags])

    return over_chunks(df, list(keys), list(order), max([1, *lags]), features, chunk)


def latest_signal_summary(df: DataFrame, tie: str | None = None, z: str = "zscore_within_series") -> DataFrame:
    """Per country and pathogen: latest date, distinct sites, median of the latest z of each site.

    The latest row of a site is a max_by, which combines before the shuffle. Sorting puts missing dates
    last, so a row without a date counts as the latest; tie breaks equal dates.
    """
    by = F.struct(F.col("date").isNull().alias("undated"), F.col("date"), *([F.col(tie)] if tie else []))
    latest = df.groupBy(*SITE_KEYS).agg(F.max_by(F.struct("date", F.col(z).alias("z")), by).alias("_l")).select(
        *SITE_KEYS, F.col("_l.date").alias("date"), F.col("_l.z").alias("z"))
    keys = ["country", "pathogen"]
    counts = latest.groupBy(*keys).agg(F.max("date").alias("latest_date"), F.countDistinct("site_id").alias("sites"))
    medians = exact_quantiles(latest, keys, "z", {"median_latest_z": 0.5})
    return null_safe_join(counts, medians, keys)


def ranked_signals(summary: DataFrame, group: str = "pathogen", z: str = "median_latest_z", tie: str = "country") -> DataFrame:
    """The summary by rising group and, within it, falling signal, with the place there; missing signals come last."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(z).desc_nulls_last(), tie))
    return summary.withColumn("place", place).orderBy(F.col(group).asc_nulls_last(), F.col(z).desc_nulls_last(), tie)


def coverage(df: DataFrame, keys: Sequence[str] = ("country", "pathogen"), site: str = "site_id") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        F.count(F.lit(1)).alias("n_observations"), F.countDistinct(site).alias("n_sites"))


def quality_report(raw: DataFrame, keys: Sequence[str], date: Column, value: Column) -> DataFrame:
    """Raw, clean and dropped rows, date span, duplicate dates, negatives and zeros per key, in one pass."""
    rows = raw.select(*keys, date.alias("_d"), value.alias("_v"))
    good = F.col("_d").isNotNull() & F.col("_v").isNotNull()
    day = F.when(good, F.col("_d"))
    clean = F.count_if(good)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw_rows"), clean.alias("clean_rows"),
        (F.count(F.lit(1)) - clean).alias("dropped_rows"), F.min(day).alias("min_date"), F.max(day).alias("max_date"),
        (clean - F.countDistinct(day)).alias("duplicate_dates"),
        F.count_if(good & (F.col("_v") < 0)).alias("negative_values"),
        F.count_if(good & (F.col("_v") == 0)).alias("zero_values"))


def national_rows(df: DataFrame, country: str, pathogen: str, source_file: str, date: str = "sevendayending",
                  value: str = "wastewaterrna") -> DataFrame:
    """National table with compact dates: date, value, constants and week; rows without a date or number are dropped."""
    table = normalise_headers(df)
    missing = {date, value} - set(table.columns)
    if missing:
        raise ValueError(f"columns not found: {sorted(missing)}; available: {table.columns}")
    number = S.to_number(value) if dict(table.dtypes)[value] == "string" else S.finite(F.col(value).cast("double"))
    code = F.col("country").cast("string") if "country" in table.columns else F.lit(None).cast("string")
    return table.select(
        S.from_yyyymmdd(date).alias("date"), number.alias("value"), F.lit(country).alias("country"),
        code.alias("country_code"), F.lit(pathogen).alias("pathogen"), F.lit(source_file).alias("source_file"),
    ).dropna(subset=["date", "value"]).withColumn("week", S.period("date", "W"))


def custom_series(df: DataFrame, date: str, value: str, series_id: str, series_name: str, role: str,
                  source_file: str = "uploaded", family: str = "custom") -> DataFrame:
    """Canonical rows from two columns of any table; rows without a date or number are dropped."""
    if role not in ROLES:
        raise ValueError("role must be 'predictive' or 'predicted'")
    types = dict(df.dtypes)
    day = column_day(df, date)
    number = S.to_number(value) if types[value] == "string" else S.finite(F.col(value).cast("double"))
    return df.select(
        day.alias("date"), number.alias("value"), F.lit(series_id).alias("series_id"), F.lit(role).alias("role"),
        F.lit(family).alias("dataset_family"), F.lit(series_name).alias("series_name"),
        F.lit(source_file).alias("source_file")).dropna(subset=["date", "value"]).select(*CANONICAL.names)
