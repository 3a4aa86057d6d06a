"""Many small landed files at once: read as rows of text, profiled and mapped per file without a driver loop.

Each file is decoded by one task (these are exports of a few megabytes; big single files go through
sources.tables). What follows are ordinary aggregates keyed by file: which column is the date, which the
value, and the canonical series they give. A file that cannot be read becomes an error row.
"""
from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import profile as P
from ..schema import CANONICAL
from ..session import stage
from .files import TABLE_SUFFIXES, chart_class, under

ROWS = "path string, member string, row_no long, header array<string>, cells array<string>, error string"
BATCH = 5_000


def _text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _records(name: str, raw: bytes, marks: Sequence[str] = ()):
    """(header, rows) of one table file, values as text or None.

    With marks, a few lines about the file may come first: the header is the first line with a marked column.
    """
    if name.lower().endswith(".json"):
        data = json.loads(_text(raw))
        data = data if isinstance(data, list) else [data]
        header = list(dict.fromkeys(k for r in data for k in r))
        return header, ([None if r.get(k) is None else str(r[k]) for k in header] for r in data)
    text = _text(raw)
    first, sep = _heading(text, "\t" if name.lower().endswith(".tsv") else ",;\t", marks)
    lines = csv.reader(io.StringIO(text), delimiter=sep)
    header = next(r for r in lines if lines.line_num > first)
    width = len(header)
    return header, ([c if c != "" else None for c in r[:width]] + [None] * (width - len(r)) for r in lines if r)


def _heading(text: str, separators: str, marks: Sequence[str]) -> tuple[int, str]:
    """Lines before the header, and the separator: the one that gives most fields there.

    With marks the header is the first line, however deep, that has a marked column.
    """
    wanted = set(marks)
    for number, line in enumerate(io.StringIO(text)):
        splits = {s: next(csv.reader([line], delimiter=s), []) for s in separators}
        fitting = [s for s in separators if wanted & set(splits[s])] if wanted else list(separators) if line.strip() else []
        if fitting:
            return number, max(fitting, key=lambda s: len(splits[s]))
    raise ValueError("no header line")


def _frames(path: str, member: str, read, marks: Sequence[str]):
    """Rows of one file in batches. The file is gone through once before, so that a broken one gives nothing but its error row."""
    try:
        raw = read()
        for _ in _records(member or path, raw, marks)[1]:
            pass
        header, rows = _records(member or path, raw, marks)
        batch = []
        for i, cells in enumerate(rows):
            batch.append((path, member, i, header, cells, None))
            if len(batch) == BATCH:
                yield pd.DataFrame(batch, columns=ROWS_NAMES)
                batch = []
        yield pd.DataFrame(batch or [(path, member, -1, header, None, None)], columns=ROWS_NAMES)
    except Exception as exc:  # a bad file is a row, not a failed run
        yield pd.DataFrame([(path, member, -1, None, None, repr(exc))], columns=ROWS_NAMES)


ROWS_NAMES = [c.split()[0] for c in ROWS.split(", ")]


def _decode(marks: Sequence[str]):
    def decode(batches):
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                if not path.lower().endswith(".zip"):
                    yield from _frames(path, "", lambda raw=raw: raw, marks)
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                        for name in archive.namelist():
                            if name.lower().endswith((".csv", ".tsv", ".json")):
                                yield from _frames(path, name, lambda archive=archive, name=name: archive.read(name), marks)
                except zipfile.BadZipFile as exc:
                    yield pd.DataFrame([(path, "", -1, None, None, repr(exc))], columns=ROWS_NAMES)
    return decode


def read_rows(spark: SparkSession, root: str, pattern: str = "*", suffixes: Sequence[str] = TABLE_SUFFIXES,
              header_marks: Sequence[str] = (), plain_headers: bool = False) -> DataFrame:
    """(path, member, row_no, header, cells, error) of every table file under root, decoded once and written.

    header_marks: column names that tell the header from a preamble. Headers are normalised unless plain_headers.
    """
    files = under(spark, root, pattern).where(S.file_suffix("path").isin([*suffixes])).select("path", "content")
    rows = stage(files.mapInPandas(_decode(tuple(header_marks)), ROWS), "file-rows")
    name = F.transform("header", lambda h: F.lower(F.trim(F.regexp_replace(F.trim(h), "[^0-9A-Za-z]+", "_"), F.lit("_"))))
    return rows if plain_headers else rows.withColumn("header", name)


def relative_name(path: Column, root: str) -> Column:
    """The path below root; root as Spark lists it, see tables.qualified."""
    return F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))


FILE = ["path", "member"]


def file_columns(rows: DataFrame) -> DataFrame:
    """One row per file and column: rows, dates and numbers found in it."""
    long = rows.where(F.col("cells").isNotNull()).select(*FILE, "header", F.posexplode("cells").alias("position", "text"))
    return long.groupBy(*FILE, "position", F.get("header", F.col("position")).alias("column")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("text").alias("n_filled"),
        F.count(S.to_day("text")).alias("n_dates"), F.count(S.to_number("text")).alias("n_numbers"),
        F.coalesce(F.max(S.only_day_first("text")), F.lit(False)).alias("day_first"))


def observations(rows: DataFrame, choice: DataFrame) -> DataFrame:
    """(path, member, columns chosen, date, value) of the rows that have both. choice is one row per file and value."""
    return rows.join(choice, FILE).select(
        *FILE, "header", "date_column", "value_column", S.to_day(F.get("cells", F.col("date_position")), day_first=F.col("day_first")).alias("date"),
        S.to_number(F.get("cells", F.col("value_position"))).alias("value")).dropna(subset=["date", "value"])


def _files(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*FILE).agg(F.first("header", ignorenulls=True).alias("columns"),
                                   F.max("error").alias("error"), F.count("cells").alias("n_rows"))


def chart_catalogue(rows: DataFrame) -> DataFrame:
    """One row per chart file: class, date and value columns; files without them are error rows."""
    columns = file_columns(rows)
    found = (_files(rows).join(P.date_choice(columns, P.CHART_DATES, 3, FILE), FILE, "left")
             .join(P.value_choice(columns, P.CHART_VALUES, FILE), FILE, "left"))
    error = F.coalesce("error", F.when(F.col("date_column").isNull(), "no date column").when(
        F.col("value_column").isNull(), "no numeric value column"))
    return found.select(
        "path", S.file_name("path").alias("filename"),
        F.when(error.isNull(), chart_class(S.file_name("path"), F.col("columns"))).otherwise("error").alias("series_type"),
        F.coalesce("date_column", F.lit("")).alias("date_column"),
        F.coalesce("value_column", F.lit("")).alias("value_column"), "columns",
        F.coalesce(error, F.lit("")).alias("error"))


def chart_observations(rows: DataFrame) -> DataFrame:
    """(path, series_type, date, value, week, month) of all readable chart files."""
    columns = file_columns(rows)
    choice = P.date_choice(columns, P.CHART_DATES, 3, FILE).join(P.value_choice(columns, P.CHART_VALUES, FILE), FILE)
    out = observations(rows, choice)
    return out.select("path", chart_class(S.file_name("path"), F.col("header")).alias("series_type"), "date", "value",
                      "date_column", "value_column", S.period("date", "W").alias("week"), S.period("date", "M").alias("month"))


def chart_series(rows: DataFrame, series_type: str, role: str, family: str) -> DataFrame:
    """Canonical series of the charts of one class."""
    charts = chart_observations(rows).where(F.col("series_type") == series_type)
    name = S.file_stem("path")
    return charts.select("date", "value", F.concat(F.lit(family + "::"), name).alias("series_id"), F.lit(role).alias("role"),
                         F.lit(family).alias("dataset_family"), name.alias("series_name"), F.col("path").alias("source_file"))


def search_catalogue(rows: DataFrame, index: int = 1) -> DataFrame:
    """One row per search-trend export: date column, positional value column, usable numbers, status."""
    columns = file_columns(rows)
    value = columns.where(F.col("position") == index).select(
        *FILE, F.col("column").alias("predictor_column"), F.col("n_numbers").alias("usable_predictor_values"))
    found = _files(rows).join(P.date_choice(columns, P.SEARCH_DATES, 3, FILE), FILE, "left").join(value, FILE, "left")
    error = F.coalesce("error", F.when(F.size("columns") <= index, "too few columns").when(
        F.col("date_column").isNull(), "no date column").when(
        F.coalesce("usable_predictor_values", F.lit(0)) == 0, "the value column has no numbers"))
    return found.select(
        "path", S.file_name("path").alias("filename"), F.coalesce("date_column", F.lit("")).alias("date_column"),
        F.lit(index).alias("predictor_column_index"), F.coalesce("predictor_column", F.lit("")).alias("predictor_column"),
        F.coalesce("usable_predictor_values", F.lit(0)).alias("usable_predictor_values"), "columns",
        F.when(error.isNull(), "ok").otherwise("error").alias("status"), F.coalesce(error, F.lit("")).alias("error"))


def search_observations(rows: DataFrame, index: int = 1, label: str = "file") -> DataFrame:
    """(path, search_term, date, count, week, month); the term is the file's name or its column header."""
    choice = P.date_choice(file_columns(rows), P.SEARCH_DATES, 3, FILE).select(
        "*", F.lit(index).alias("value_position"), F.lit("").alias("value_column"))
    out = observations(rows.where(F.size("header") > index), choice)
    term = S.term_label("path") if label == "file" else F.get("header", F.lit(index))
    return out.select("path", term.alias("search_term"), "date", F.col("value").alias("count"),
                      F.get("header", F.lit(index)).alias("value_column"),
                      S.period("date", "W").alias("week"), S.period("date", "M").alias("month"))


def search_series(rows: DataFrame, family: str = "google_trends_1y", index: int = 1, label: str = "file") -> DataFrame:
    terms = search_observations(rows, index, label)
    return terms.select("date", F.col("count").alias("value"),
                        F.concat(F.lit(family + "::"), F.col("search_term")).alias("series_id"),
                        F.lit("predictive").alias("role"), F.lit(family).alias("dataset_family"),
                        F.col("search_term").alias("series_name"), F.col("path").alias("source_file"))


def raw_series(rows: DataFrame, catalogue: DataFrame, root: str, limit: int = 3, minimum: int = 3) -> DataFrame:
    """Raw site tables (plain files, archive members, extracted folders) as predictive series.

    catalogue has filename, country, pathogen_scope and level. A table belongs to the entry whose file it is, and to the entry
    whose archive left a folder of its name anywhere above the table. It goes by its name below root, so equal names in different
    folders stay apart; a member of an archive goes by the archive's name and its own.
    """
    entry = F.col("filename")
    stem = F.regexp_replace(F.regexp_extract(entry, "[^/]+$", 0), r"(.)\.[^.]+$", "$1")
    names = catalogue.where(F.trim(entry) != "").select(
        "country", "pathogen_scope", "level", entry.alias("source_name"),
        F.explode(F.array(F.concat(F.lit("file:"), entry), F.concat(F.lit("folder:"), stem))).alias("_key"))
    columns = file_columns(rows)
    choices = P.value_choices(columns, P.date_choice(columns, P.RAW_DATES, 4, FILE), limit, FILE)
    relative = relative_name(F.col("path"), root)
    top = F.regexp_extract(relative, "^([^/]+)/", 1)
    keys = F.array(F.concat(F.lit("file:"), relative), F.when((top != "") & (F.col("member") == ""), F.concat(F.lit("folder:"), top)))
    found = observations(rows, choices).withColumn("_key", F.explode(F.array_compact(keys)))
    tagged = found.join(names, "_key")
    table_name = F.when(F.col("member") != "", F.concat(S.file_name("path"), F.lit(":"), F.col("member"))).otherwise(relative)
    label = S.join_parts(" / ", "country", "pathogen_scope", "level", table_name, "value_column")
    series = tagged.select(
        "date", "value", F.concat(F.lit("wastewater_raw::"), F.replace(label, F.lit("::"), F.lit("_"))).alias("series_id"),
        F.lit("predictive").alias("role"), F.lit("wastewater_raw").alias("dataset_family"), label.alias("series_name"),
        F.col("source_name").alias("source_file"))
    keep = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum).select("series_id")
    return series.join(keep, "series_id", "left_semi").select(*CANONICAL.names)


def file_schemas(rows: DataFrame) -> DataFrame:
    """(path, member, n_rows, n_cols, columns, error): one row per file or archive member."""
    found = _files(rows)
    good = F.col("error").isNull()
    return found.select(*FILE, F.when(good, F.col("n_rows")).alias("n_rows"), F.when(good, F.size("columns")).alias("n_cols"),
                        F.coalesce("columns", F.array().cast("array<string>")).alias("columns"), F.coalesce("error", F.lit("")).alias("error"))


def monthly_totals(rows: DataFrame, value_column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Monthly sums of one column over all files that have it, tagged by file; suppression marks are removed."""
    columns = file_columns(rows)
    months = P.date_choice(columns, P.MONTH_DATES, 1_000_000_000, FILE)
    position = F.array_position("header", value_column)
    have = rows.where((position > 0) & F.col("cells").isNotNull()).join(months, FILE, "left")
    extra = [F.get("cells", (F.array_position("header", k) - 1).cast("int")).alias(k) for k in keys]
    work = have.select("path", S.period(S.to_day(F.get("cells", F.col("date_position")), day_first=F.coalesce("day_first", F.lit(False))), "M").alias("month"),
                       S.to_count(F.get("cells", (position - 1).cast("int"))).alias("value"), *extra)
    return work.groupBy(F.col("path").alias("source_file"), "month", *keys).agg(F.sum("value").alias("value"))


def weather_series(rows: DataFrame, minimum: int = 10) -> DataFrame:
    """Weather tables (date first found by name, every other numeric column a series); place from the file name."""
    columns = file_columns(rows)
    dates = P.date_choice(columns, ("time", "date"), 1_000_000_000, FILE)
    values = columns.drop("day_first").join(dates, FILE).where((F.col("position") != F.col("date_position")) & (F.col("n_numbers") >= minimum))
    choice = values.select(*FILE, "date_column", "date_position", "day_first", F.col("column").alias("value_column"),
                           F.col("position").alias("value_position"))
    place = F.regexp_replace(S.file_stem("path"), "^open_meteo_", "")
    return observations(rows, choice).select(
        "date", "value", F.concat_ws("::", F.lit("open_meteo_weather"), place, "value_column").alias("series_id"),
        F.lit("predictive").alias("role"), F.lit("open_meteo_weather").alias("dataset_family"),
        F.concat_ws(" ", place, "value_column").alias("series_name"), F.col("path").alias("source_file"))
