"""Series roll-ups, catalogues and summaries: one partial aggregation and one shuffle each."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import stage
from .frames import distinct_values


def roll_up(series: DataFrame, freq: str = "W", aggregation: str = "mean",
            keys: Sequence[str] = ("series_id", "role"), value: str = "value") -> DataFrame:
    """One row per series and period; all-missing groups stay missing and are dropped.

    role goes with series_id (it is stamped on every row of a series), so grouping by both adds no rows.
    """
    agg = F.sum(value) if aggregation == "sum" else F.avg(value)
    return (series.where(F.col("date").isNotNull())
            .groupBy(*keys, S.period("date", freq).alias("period")).agg(agg.alias("value"))
            .where(F.col("value").isNotNull()))


def rolled_series(series: DataFrame, freq: str = "W", aggregation: str = "mean") -> DataFrame:
    """The roll-up in canonical form, written once to the shared folder and read back.

    Panels, forecasts and experiments use the rolled-up series several times; from here on they read a table
    of series x periods instead of scanning the observations again. Rolling it up once more changes nothing.
    """
    tags = ["dataset_family", "series_name", "source_file"]
    # Numbers only in the first aggregate, so it hashes; picking a tag compares text, which would sort every row.
    parts = (series.where(F.col("date").isNotNull())
             .groupBy("series_id", "role", *tags, S.period("date", freq).alias("date"))
             .agg(F.sum("value").alias("_s"), F.count("value").alias("_n")))
    total = F.sum("_s") if aggregation == "sum" else F.sum("_s") / F.sum("_n")
    rolled = (parts.where(F.col("_n") > 0).groupBy("series_id", "role", "date")
              .agg(total.alias("value"), F.min(F.struct(*tags)).alias("m")))
    return stage(rolled.select("date", "value", "series_id", "role", "m.*"), "rolled")


def wide_panel(rolled: DataFrame, ids: Sequence[str] | None = None) -> DataFrame:
    """One row per period, one column per series. Keep tables long until here."""
    ids = list(ids) if ids is not None else distinct_values(rolled, "series_id")
    return rolled.groupBy("period").pivot("series_id", ids).agg(F.first("value"))


def period_grid(rolled: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """Every series on every period that any series has; missing values NULL.

    The grid is the long form of the wide panel, so its size is the size of that panel. The periods, which the calendar bounds, are one
    array of a scalar subquery; each series unfolds it.
    """
    ids = (series if series is not None else rolled).select("series_id", "role").distinct()
    periods = rolled.agg(F.array_sort(F.collect_set("period"))).scalar()
    grid = ids.withColumn("period", F.explode(periods))
    return grid.join(rolled.select("series_id", "role", "period", "value"), ["series_id", "role", "period"], "left")


def series_catalogue(series: DataFrame) -> DataFrame:
    """One row per series: role, family, name, non-missing observations and date span.

    Counted per distinct set of tags first (a hash aggregate of numbers and dates), then reduced per series.
    """
    tagged = series.groupBy("series_id", "role", "dataset_family", "series_name").agg(
        F.count("value").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    return tagged.groupBy("series_id").agg(
        F.min("role").alias("role"), F.min("dataset_family").alias("dataset_family"),
        F.min("series_name").alias("series_name"), F.sum("n").alias("n_obs"),
        F.min("lo").alias("date_min"), F.max("hi").alias("date_max"))


def series_metadata(series: DataFrame) -> DataFrame:
    """One metadata row per (series_id, role), picked by order of the values and not by arrival."""
    tags = series.select("series_id", "role", "dataset_family", "series_name", "source_file").where(
        F.col("series_id").isNotNull()).distinct()
    first = F.min(F.struct("dataset_family", "series_name", "source_file"))
    return tags.groupBy("series_id", "role").agg(first.alias("m")).select("series_id", "role", "m.*")


def series_summary(series: DataFrame) -> DataFrame:
    return series.groupBy("role", "dataset_family", "series_id", "series_name", "source_file").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        F.count(F.lit(1)).alias("n_observations"))


def family_counts(series: DataFrame) -> DataFrame:
    """Distinct series per role and family."""
    return series.groupBy("role", "dataset_family").agg(F.countDistinct("series_id").alias("n_series"))


def family_status(series: DataFrame, expected: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Expected families (role, family, where to look) with the number of series found."""
    spark = series.sparkSession
    want = spark.createDataFrame(list(expected), "role string, dataset_family string, expected_location string")
    found = family_counts(series).withColumnRenamed("n_series", "n_series_found")
    return (want.join(found, ["role", "dataset_family"], "left").fillna(0, ["n_series_found"])
            .withColumn("available", F.col("n_series_found") > 0))


def enough_observations(series: DataFrame, minimum: int, key: str = "series_id") -> DataFrame:
    """Rows of the series with at least that many non-missing values: counted first, then a semi-join."""
    keep = series.groupBy(key).agg(F.count("value").alias("_n")).where(F.col("_n") >= minimum).select(key)
    return series.join(keep, key, "left_semi")


def upsert(series: DataFrame, new: DataFrame, known_ids: Sequence[str] | None = None) -> DataFrame:
    """Add series, replacing the ones whose id is already there. A few ids known beforehand become a filter."""
    if known_ids is not None:
        return series.where(~F.col("series_id").isin(list(known_ids))).unionByName(new)
    ids = new.select("series_id").distinct()
    return series.join(ids, "series_id", "left_anti").unionByName(new)


def role_counts(series: DataFrame) -> DataFrame:
    return series.groupBy("role").agg(F.countDistinct("series_id").alias("n_series"))


def can_model(series: DataFrame) -> bool:
    """Run gate: there is at least one predictive and one predicted series."""
    found = {r[0] for r in series.select("role").where(F.col("role").isin("predictive", "predicted")).distinct().collect()}
    return found == {"predictive", "predicted"}


def group_period_mean(df: DataFrame, group: str, period: str, value: str, where=None) -> DataFrame:
    """Mean of a value by group and period, rows chosen by a predicate first."""
    chosen = df if where is None else df.where(where)
    return chosen.groupBy(group, period).agg(F.avg(value).alias(value))


def pivot_counts(df: DataFrame, index: str, column: str, value: str, names: Sequence[str]) -> DataFrame:
    """Summed counts spread over columns, 0 where a combination is absent."""
    return df.groupBy(index).pivot(column, list(names)).agg(F.sum(value)).fillna(0)


def row_wise_mean(long: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Mean over the columns of a wide frame, computed on its long form."""
    return long.groupBy(by).agg(F.avg(value).alias(name))
