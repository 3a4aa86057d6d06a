"""Inventories, checksums and catalogues of landed files."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .tables import qualified

TABLE_SUFFIXES = (".csv", ".tsv", ".txt", ".json")
# Folders that hold no data.
SKIPPED_FOLDERS = (".git", ".venv", "__pycache__", ".ipynb_checkpoints")

LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
# Tasks an inventory may use besides four a core; each is sent the names of its files, so there must be enough of them.
INVENTORY_TASKS = 1000

# Words of file and column names that tell the class of a chart.
CALL_WORDS = ("nhs111", "nhs-111", "nhs_111", "111", "call", "calls", "online")
VISIT_WORDS = ("gp", "general-practice", "general_practice", "admission", "admissions", "consultation", "consultations")


def under(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of the files under a folder, however many folders they lie in.

    Spark lists the folders while it loads, with a task for each of up to 10,000 of them at every level; here a task lists many.
    """
    asked = spark.conf.get(LISTING)
    spark.conf.set(LISTING, min(int(asked), 4 * spark.sparkContext.defaultParallelism))
    try:
        return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                .option("pathGlobFilter", pattern).load(root))
    finally:
        spark.conf.set(LISTING, asked)


def inventory(spark: SparkSession, root: str, pattern: str = "*", suffixes: Sequence[str] = ()) -> DataFrame:
    """(path, filename, suffix, size, modified) of the files under a folder; contents are not read.

    Spark counts 4 MB for opening a file, which makes a task of every few files; as nothing is opened here, a task takes many.
    """
    out = under(spark, root, pattern).select(
        "path", S.file_name("path").alias("filename"), S.file_suffix("path").alias("suffix"),
        F.col("length").alias("size_bytes"), (F.col("length") / 1024).alias("size_kb"),
        F.col("modificationTime").alias("modified")).coalesce(max(INVENTORY_TASKS, 4 * spark.sparkContext.defaultParallelism))
    for folder in SKIPPED_FOLDERS:
        out = out.where(~F.col("path").contains(f"/{folder}/"))
    return out.where(F.col("suffix").isin(list(suffixes))) if suffixes else out


def clinical_inventory(spark: SparkSession, raw: str, domain: str | None = None) -> DataFrame:
    """CSV files below <raw>/<domain>/<year>/ with domain and year taken from the path."""
    tail = F.regexp_extract("path", r"/" + raw.rstrip("/").split("/")[-1] + r"/(.*)$", 1)
    parts = F.split(tail, "/")
    out = inventory(spark, raw, "*.csv").select(
        "path", F.when(F.size(parts) > 1, parts[0]).otherwise("").alias("domain"),
        F.when(F.size(parts) > 2, parts[1]).otherwise("").alias("year"), "size_kb")
    return out.where(F.array_contains(F.split("path", "/"), domain)) if domain else out


def checksums(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256, status) of each file; Spark does not list empty ones."""
    files = under(spark, root, pattern)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.lit("ok").alias("status"))


def transfer_status(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected files beside their checksums: one status table; failures are the rows that are not ok."""
    here = found.select(S.file_name("path").alias("filename"), "bytes", "sha256", F.col("status").alias("_s"))
    return expected.join(here, "filename", "left").withColumn("status", F.coalesce("_s", F.lit("missing"))).drop("_s")


def listed_sources(catalogue: DataFrame) -> DataFrame:
    """Catalogue rows that name a source: blank and commented ids are left out."""
    return catalogue.where((F.trim("source_id") != "") & ~F.trim("source_id").startswith("#"))


def size_by_suffix(files: DataFrame) -> DataFrame:
    return files.groupBy("suffix").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("total_bytes"))


def source_counts(catalogue: DataFrame, keys: Sequence[str] = ("country", "pathogen_scope", "level", "format")) -> DataFrame:
    return catalogue.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sources"))


def chart_class(name: Column | str, columns: Column | None = None) -> Column:
    """nhs_calls, gp_admissions or other, from a file name and the column names."""
    text = F.replace(F.lower(S.as_col(name)), F.lit("_"), F.lit("-"))
    if columns is not None:
        text = F.concat(text, F.lit(" "), F.lower(F.array_join(columns, " ")))
    calls, visits = F.lit(False), F.lit(False)
    for word in CALL_WORDS:
        calls = calls | text.contains(word)
    for word in VISIT_WORDS:
        visits = visits | text.contains(word)
    specific = text.contains("admission") | text.contains("gp")
    return (F.when(calls & ~visits, "nhs_calls").when(visits & ~calls, "gp_admissions")
            .when(calls & visits, F.when(specific, "gp_admissions").otherwise("nhs_calls")).otherwise("other"))


def source_schemas(spark: SparkSession, sources: DataFrame, raw: str) -> DataFrame:
    """Members, columns and row counts of each catalogued file; missing and unreadable files are rows too. All files are read by one job."""
    from .cells import file_schemas, read_rows, relative_name
    root = qualified(spark, raw)
    listed = sources.select("country", "pathogen_scope", "level", F.col("filename").alias("source_file"))
    here = inventory(spark, raw).select(relative_name(F.col("path"), root).alias("source_file"), F.lit(True).alias("_here"))
    read = file_schemas(read_rows(spark, raw, suffixes=(*TABLE_SUFFIXES, ".zip"), plain_headers=True)).withColumn(
        "source_file", relative_name(F.col("path"), root)).drop("path")
    found = listed.join(here, "source_file", "left").join(read, "source_file", "left")
    there = F.coalesce("_here", F.lit(False))
    unread = there & F.col("error").isNull()
    return found.select("country", "pathogen_scope", "level", "source_file", there.alias("exists"), F.coalesce("member", F.lit("")).alias("member"),
                        "n_rows", "n_cols", F.coalesce("columns", F.array().cast("array<string>")).alias("columns"),
                        F.when(unread, "unsupported format").otherwise(F.coalesce("error", F.lit(""))).alias("error"))


def search_terms(catalogue: DataFrame, query: str, size: int = 10) -> DataFrame:
    """Files whose term holds the query: one per (period, term), in file order, the first `size`.

    catalogue has term, period and local_file columns.
    """
    hits = catalogue.where(F.lower("term").contains(query.lower()))
    w = Window.partitionBy("period", F.lower("term")).orderBy("local_file")
    first = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
    return first.orderBy("period", "local_file", "term").limit(size)
