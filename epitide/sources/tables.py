"""Readers for landed files of many shapes."""
from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.frames import column_day
from ..operators.reshape import first_pivot

BOM = "﻿"


def clean_headers(df: DataFrame) -> DataFrame:
    """Drops a byte-order mark from the first header."""
    return df.toDF(*[c.lstrip(BOM).strip('"') if i == 0 else c for i, c in enumerate(df.columns)])


def separator_of(spark: SparkSession, path: str, lines: int = 20) -> str:
    """The separator among comma, semicolon and tab that the first lines agree on; read from those lines only."""
    heads = [r[0] for r in spark.read.text(path).limit(lines).collect() if r[0].strip()]
    best, score = ",", 0.0
    for sep in (",", ";", "\t"):
        counts = [line.count(sep) for line in heads]
        if counts and counts[0] > 0:
            agree = sum(c == counts[0] for c in counts) / len(counts)
            if (agree, counts[0]) > (score, 0) and agree > score:
                best, score = sep, agree
    return best


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line is not valid UTF-8, then Latin-1. Reads the file; give the encoding to skip this."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if broken else "UTF-8"


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
                   infer: bool = False, **options) -> DataFrame:
    """CSV or TSV. The separator is sniffed and the encoding checked unless given; columns stay text unless infer."""
    sep = sep or ("\t" if path.lower().endswith(".tsv") else separator_of(spark, path))
    encoding = encoding or encoding_of(spark, path)
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    return clean_headers(reader.options(**options).csv(path, inferSchema=infer))


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table by its suffix: csv, txt, tsv, json or parquet."""
    low = path.lower()
    if low.endswith((".csv", ".tsv", ".txt")):
        return read_delimited(spark, path, **options)
    if low.endswith(".json"):
        return spark.read.json(path, multiLine=True)
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported table format: {path}")


def read_processed(spark: SparkSession, parquet: str, csv: str) -> DataFrame | None:
    """Parquet if it is there, else CSV, else None."""
    for path, reader in ((parquet, spark.read.parquet), (csv, lambda p: read_delimited(spark, p))):
        if exists(spark, path):
            return reader(path)
    return None


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark lists the files below it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, place): lines with the file and block they are from, places ascending within a block."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def below(lines: DataFrame, heading: Column) -> DataFrame:
    """Lines after the first one of each file that meets the condition, told by place and not by their text.

    The heading of a file is looked for in its first block; files without one give nothing.
    """
    first = lines.where((F.col("block") == 0) & heading).groupBy(F.col("file").alias("_file")).agg(F.min("place").alias("_first"))
    return lines.join(first, F.col("file") == F.col("_file")).where((F.col("block") > 0) | (F.col("place") > F.col("_first")))


def read_words(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """Text split at runs of blanks; the first line holds the names unless they are given."""
    placed = placed_lines(spark, path)
    lines = placed if names is not None else below(placed, F.trim("value") != "")
    words = F.split(F.trim("value"), r"\s+").alias("w")
    if names is None:
        names = placed.where((F.col("block") == 0) & (F.trim("value") != "")).orderBy("place").select(words).first()["w"]
    return lines.where(F.trim("value") != "").select(words).select(*[F.get("w", i).alias(n) for i, n in enumerate(names)])


def read_with_preamble(spark: SparkSession, path: str, marks: Sequence[str] = ("time", "date")) -> DataFrame:
    """CSV whose header follows lines about the file, however many; the header is the first line with a marked column."""
    lines = placed_lines(spark, path)
    fields = F.transform(F.split(F.ltrim("value", F.lit(BOM)), ","), lambda h: F.trim(F.trim(h), F.lit('"')))
    heading = F.arrays_overlap(fields, F.array(*[F.lit(m) for m in marks]))
    head = lines.where((F.col("block") == 0) & heading).orderBy("place").select(fields.alias("names")).first()
    if head is None:
        raise ValueError(f"no header with one of {list(marks)} in {path}")
    names = head["names"]
    schema = ", ".join(f"c{j} string" for j in range(len(names)))
    rows = below(lines, heading).where(F.trim("value") != "")
    return rows.select(F.from_csv("value", F.lit(schema)).alias("r")).select(
        *[F.col(f"r.c{j}").alias(n) for j, n in enumerate(names)])


def _members(batches):
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if name.lower().endswith((".csv", ".tsv", ".json")):
                            yield from _member(path, name, archive)
            except zipfile.BadZipFile as exc:
                yield _member_rows(path, "", [(-1, None)], repr(exc))


def _member(path, name, archive):
    """Lines of one member in batches; one that cannot be read to its end gives only its error row."""
    try:
        with archive.open(name) as handle:
            if name.lower().endswith(".json"):
                data = json.load(io.TextIOWrapper(handle, "utf-8"))
                yield _member_rows(path, name, list(enumerate(json.dumps(r) for r in (data if isinstance(data, list) else [data]))))
                return
            for _ in iter(lambda: handle.read(1 << 20), b""):  # the checksum stands at the end
                pass
        with archive.open(name) as handle:
            rows = []
            for i, line in enumerate(io.TextIOWrapper(handle, "utf-8-sig", errors="replace")):
                rows.append((i, line.rstrip("\r\n")))
                if len(rows) == 10_000:
                    yield _member_rows(path, name, rows)
                    rows = []
            if rows:
                yield _member_rows(path, name, rows)
    except Exception as exc:  # a bad member is a row, not a failed run
        yield _member_rows(path, name, [(-1, None)], repr(exc))


def _member_rows(path, name, rows, error=None):
    frame = pd.DataFrame(rows, columns=["line_no", "line"])
    return frame.assign(path=path, member=name, error=error)[["path", "member", "line_no", "line", "error"]]


def read_zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, line_no, line, error) of every table in the archives; members are streamed, one archive per task.

    A broken archive or member is one row with its error and line_no -1.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(_members, "path string, member string, line_no long, line string, error string")


def zip_members(lines: DataFrame) -> DataFrame:
    """(member, header, n_rows) of each member; the header names its columns."""
    return lines.where("error IS NULL").groupBy("path", "member").agg(
        F.min_by("line", "line_no").alias("header"), F.count(F.lit(1)).alias("n_lines"))


def zip_table(lines: DataFrame, member: str) -> DataFrame:
    """One member as a table of text columns."""
    rows = lines.where((F.col("member") == member) & F.col("error").isNull())
    if member.lower().endswith(".json"):
        sample = rows.select("line").first()
        schema = F.schema_of_json(F.lit(sample["line"]))
        return rows.select(F.from_json("line", schema).alias("r")).select("r.*")
    head = rows.where(F.col("line_no") == 0).first()["line"]
    sep = "\t" if member.lower().endswith(".tsv") else (";" if head.count(";") > head.count(",") else ",")
    names = [h.strip().strip('"') for h in head.split(sep)]
    schema = ", ".join(f"c{j} string" for j in range(len(names)))
    body = rows.where((F.col("line_no") > 0) & (F.trim("line") != ""))
    return body.select(F.from_csv("line", F.lit(schema), {"sep": sep}).alias("r")).select(
        *[F.col(f"r.c{j}").alias(n) for j, n in enumerate(names)])


# ---- configured sources ---------------------------------------------------------

@dataclass(frozen=True)
class SpineSource:
    """One file that gives one or several columns of the daily spine."""

    name: str
    path: str
    date_column: str
    value_column: str
    output_name: str | None = None
    series_column: str | None = None
    date_layout: str | None = None
    read_options: dict = field(default_factory=dict)
    filters: dict = field(default_factory=dict)
    keep: tuple[str, ...] = ()
    renames: dict = field(default_factory=dict)

    def columns(self) -> list[str]:
        """Output columns this source is known to give, in order."""
        if self.series_column is None:
            return [self.output_name or self.name]
        if self.keep:
            return [self.renames.get(s, f"{self.name}__{s}") for s in self.keep]
        return [self.output_name or self.name]


def spine_rows(df: DataFrame, source: SpineSource, order: str | None = None) -> DataFrame:
    """(date, column_name, value, row_index) of one source: filters, dates, chosen series, renamed columns."""
    for column, wanted in source.filters.items():
        if column in df.columns:
            df = df.where(F.col(column) == wanted)
    date = column_day(df, source.date_column, source.date_layout)
    value = S.to_number(source.value_column) if dict(df.dtypes)[source.value_column] == "string" else F.col(source.value_column)
    if source.series_column is None:
        name = F.lit(source.output_name or source.name)
    else:
        if source.keep:
            df = df.where(F.col(source.series_column).isin(list(source.keep)))
        name = S.mapped_name(F.col(source.series_column).cast("string"), source.renames, source.name)
    index = F.col(order) if order else F.monotonically_increasing_id()
    return df.select(date.alias("date"), name.alias("column_name"), value.cast("double").alias("value"),
                     index.alias("row_index")).where(F.col("date").isNotNull())


def build_spine(rows: DataFrame, sources: Sequence[SpineSource], start=None, end=None,
                names: Sequence[str] | None = None) -> DataFrame:
    """The union of all sources' rows as one wide table by date: one pivot instead of a chain of outer joins."""
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    wide = first_pivot(rows, "date", "column_name", "value", "row_index", names)
    front = [c for s in sources for c in s.columns() if c in wide.columns]
    return wide.select("date", *front, *[c for c in wide.columns if c not in front and c != "date"])
