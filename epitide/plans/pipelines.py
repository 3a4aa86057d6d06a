"""End-to-end runs: landed files to canonical series, series to ranked models, sites to features, spine to forecast."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, rollup
from ..operators.features import daily_spine, season_columns
from ..operators.reshape import processed_series, two_role_series
from ..schema import CANONICAL, PanelConfig
from ..sources import cells
from ..sources.tables import SpineSource, build_spine, exists, qualified, read_delimited, read_processed, read_table, read_words, spine_rows
from . import direct, models

# Columns of the international case table used as predictors and as outcomes.
CASE_ROLES = {
    "predictive": ("new_cases_smoothed", "new_deaths_smoothed", "reproduction_rate", "new_tests_smoothed", "positive_rate",
                   "people_vaccinated_per_hundred", "people_fully_vaccinated_per_hundred", "total_boosters_per_hundred",
                   "new_vaccinations_smoothed_per_million", "stringency_index"),
    "predicted": ("new_cases_smoothed", "weekly_hosp_admissions", "hosp_patients", "icu_patients", "new_deaths_smoothed"),
}


@dataclass(frozen=True)
class Landing:
    """Folders of landed files; those that are missing are left out."""

    root: str
    searches: str = "Google_trends_v2/1y_data"
    charts: str = "charts"
    raw: str = "data/raw"
    catalogue: str = "sources.csv"
    processed: str = "data/processed/wastewater_long"
    cases: str = "data/external/owid_covid_data.csv"
    weather: str = "data/external/weather"
    case_location: str = "United Kingdom"

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"


def local_series(spark: SparkSession, landing: Landing) -> DataFrame:
    """Series of the five local families: searches, call charts, raw and processed site tables, admission charts."""
    parts: list[DataFrame] = []
    if exists(spark, landing.at(landing.searches)):
        parts.append(cells.search_series(cells.read_rows(spark, landing.at(landing.searches), "time_series_GB*")))
    if exists(spark, landing.at(landing.charts)):
        charts = cells.read_rows(spark, landing.at(landing.charts))
        parts.append(cells.chart_series(charts, "nhs_calls", "predictive", "ukhsa_nhs_calls"))
        parts.append(cells.chart_series(charts, "gp_admissions", "predicted", "ukhsa_gp_admissions"))
    if exists(spark, landing.at(landing.raw)) and exists(spark, landing.at(landing.catalogue)):
        rows = cells.read_rows(spark, landing.at(landing.raw), suffixes=(".csv", ".tsv", ".json", ".zip"))
        parts.append(cells.raw_series(rows, read_delimited(spark, landing.at(landing.catalogue), sep=","), qualified(spark, landing.at(landing.raw))))
    processed = read_processed(spark, landing.at(landing.processed + ".parquet"), landing.at(landing.processed + ".csv"))
    if processed is not None:
        parts.append(processed_series(processed))
    return _union(spark, parts)


def _union(spark: SparkSession, parts: Sequence[DataFrame]) -> DataFrame:
    out = None
    for part in parts:
        part = part.select(*CANONICAL.names)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], CANONICAL) if out is None else out


def all_series(spark: SparkSession, landing: Landing, external: bool = True) -> DataFrame:
    """local_series and, unless told otherwise, the external case and weather tables."""
    parts = [local_series(spark, landing)]
    if external and exists(spark, landing.at(landing.cases)):
        cases = read_delimited(spark, landing.at(landing.cases), sep=",")
        if "location" in cases.columns:
            cases = cases.where(F.col("location") == landing.case_location)
        cases = cases.withColumn("_place", F.lit(landing.case_location))
        parts.append(two_role_series(cases, "date", "_place", CASE_ROLES, "owid_covid", landing.cases))
    if external and exists(spark, landing.at(landing.weather)):
        parts.append(cells.weather_series(cells.read_rows(
            spark, landing.at(landing.weather), "open_meteo_*.csv", header_marks=("time", "date"))))
    return _union(spark, parts)


def write_diagnostics(series: DataFrame, folder: str) -> None:
    """Series, their summary and the family counts as CSV folders."""
    for name, df in (("canonical_series", series), ("series_summary", rollup.series_summary(series)),
                     ("family_counts", rollup.family_counts(series))):
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def model_run(series: DataFrame, folder: str, cfg: PanelConfig = PanelConfig(lags=tuple(range(1, 9))), **sizes) -> DataFrame:
    """Diagnostics, run gate, all models on all targets, results and predictions written, ranked results returned."""
    write_diagnostics(series, folder)
    if not rollup.can_model(series):
        raise ValueError("at least one predictive and one predicted series are needed")
    results, predictions = models.fit_models(series, cfg=cfg, **sizes)
    results.write.mode("overwrite").parquet(f"{folder}/model_results")
    predictions.write.mode("overwrite").parquet(f"{folder}/model_predictions")
    best = models.ranked(series.sparkSession.read.parquet(f"{folder}/model_results"))
    if best.isEmpty():
        raise ValueError("no model could be fitted; see model_results")
    return best


def site_features(sites: DataFrame, folder: str | None = None, order: Sequence[str] = ("date",), window: int = 3) -> dict[str, DataFrame]:
    """Time columns, log signal, z-scores and trailing means of site rows, with coverage and latest signals."""
    rows = clean.within_series_zscore(clean.add_log_signal(clean.add_time_features(sites)))
    rows = clean.rolling_features(rows, order=order, window=window, chunk=F.date_trunc("year", "date"))
    if folder:
        rows.write.mode("overwrite").parquet(f"{folder}/wastewater_long")
        rows = sites.sparkSession.read.parquet(f"{folder}/wastewater_long")
    return {"rows": rows, "coverage": clean.coverage(rows), "latest": clean.latest_signal_summary(rows)}


def seasonal_spine(spark: SparkSession, sources: Sequence[SpineSource], start: str, end: str,
                   temperature: str | None = None, cut: tuple[str, str] | None = None) -> DataFrame:
    """Daily spine of the configured files with the season of each day and the temperature where known."""
    rows = None
    for s in sources:
        options = {k: v for k, v in s.read_options.items() if k != "sep"}
        table = (read_delimited(spark, s.path, sep=s.read_options.get("sep"), **options)
                 if s.path.lower().endswith((".csv", ".tsv", ".txt")) else read_table(spark, s.path))
        part = spine_rows(table, s)
        rows = part if rows is None else rows.unionByName(part)
    wide = build_spine(rows, sources)
    days = season_columns(daily_spine(spark.createDataFrame([(start, end)], "start string, end string")))
    if temperature:
        from ..functions import scalars as S
        words = read_words(spark, temperature)
        heat = words.select(S.to_day(words.columns[0]).alias("date"), S.to_number("Value").alias("temp")).where("date IS NOT NULL")
        days = days.join(heat, "date", "left")
    out = wide.join(days, "date", "left")
    return out.where(F.col("date").between(*cut)) if cut else out


def spine_forecast(spine: DataFrame, target: str, **options):
    """Boosted direct forecast on a seasonal spine."""
    return direct.boosted_direct(spine, "date", target, **options)


def register_custom(series: DataFrame | None, table: DataFrame, date: str, value: str, series_id: str, name: str,
                    role: str, source_file: str = "uploaded") -> DataFrame:
    """A custom series from two columns of a table, added to the panel or replacing the series of that id."""
    new = clean.custom_series(table, date, value, series_id, name, role, source_file)
    if new.isEmpty():
        raise ValueError("no valid date and value rows in the chosen columns")
    return new if series is None else rollup.upsert(series, new, [series_id])


def export_panel(df: DataFrame, path: str) -> None:
    """CSV or Parquet by the path's suffix."""
    writer = df.write.mode("overwrite")
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
