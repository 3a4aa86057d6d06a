"""Reshaping of source tables, ingestion, files, links, registry, events and forecasts."""
from __future__ import annotations

import os
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..operators import reshape, rollup
from ..operators.pairs import PAIR
from ..plans import events as E
from ..plans import forecast
from ..schema import BacktestConfig, PanelConfig
from ..session import run_folder
from ..sources import cells, files, links, runs, tables
from .core import FIRST_ORIGIN, NORMAL_SF, rolling_ctes
from .inputs import CANONICAL_SQL, R, canonical, rounded, table, weekly_series

MAPPING = {"date_column": "l_shipdate", "geography_column": "l_returnflag",
           "signal_columns": ["l_quantity", "l_discount", "l_linestatus", "no_such_column"]}


def line_signals(spark, sf):
    raw = table(spark, sf, "lineitem").withColumn("l_discount", F.when(F.col("l_linenumber") != 3, F.col("l_discount")))
    return raw, reshape.normalized_signals(raw, "shipping", "none", "predicted", MAPPING)


def unpivot(spark, sf):
    _, signals = line_signals(spark, sf)
    return signals.groupBy("source", "pathogen", "role", "signal_type", "metric", "geography_name", "geography_code").agg(
        F.count(F.lit(1)).alias("n_rows"), R(F.sum("value"), 2).alias("total"), F.min("date").alias("first_date"))


def merged(left, right, key):
    """Columns of two summaries with one row per key, side by side."""
    both = left.unionByName(right, allowMissingColumns=True)
    return both.groupBy(key).agg(*[F.max(c).alias(c) for c in both.columns if c != key])


def ingest_stats(spark, sf):
    raw, signals = line_signals(spark, sf)
    stats = runs.ingest_stats(signals)
    missing = runs.missing_fraction(raw, ["l_quantity", "l_discount"]).withColumn("source", F.lit("shipping"))
    from ..functions import scalars as S
    f = F.col("missing_value_fraction")
    return merged(stats, missing, "source").select(
        "source", "rows", "signal_count", "date_min", "date_max", R("missing_value_fraction", 6).alias("missing_value_fraction"),
        S.missing_status(f).alias("validation_status"), runs.summary_text(F.col("source")).alias("summary"))


def feature_series(spark, sf):
    wide = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.avg("o_totalprice").alias("target_price"), F.count(F.lit(1)).alias("n_orders"),
        F.max("o_orderpriority").alias("metric"), F.max(F.when(F.col("o_orderkey") == 0, 1.0)).alias("rare"))
    out = reshape.feature_table_series(wide, "Daily Orders", "orders.parquet")
    return out.select("date", R("value", 4).alias("value"), "series_id", "role", "dataset_family", "series_name", "source_file")


def signal_rows(spark, sf):
    return table(spark, sf, "events").select(
        F.col("ts").cast("date").alias("date"), "value", F.lit("web").alias("source"), F.lit("none").alias("pathogen"),
        F.when(F.col("event_type") == "view", "hospital_admissions").otherwise(F.col("event_type")).alias("signal_type"),
        F.lit("rate").alias("metric"), F.concat(F.lit("User "), F.col("user_id") % 4).alias("geography_name"),
        F.when(F.col("user_id") % 4 != 0, F.lit("X")).alias("geography_code"),
        F.when(F.col("event_type") == "click", F.lit("predicted")).alias("role"))


def signal_series(spark, sf):
    return reshape.signal_series(signal_rows(spark, sf)).groupBy("series_id", "role", "dataset_family", "series_name").agg(
        F.count(F.lit(1)).alias("n_rows"), R(F.sum("value"), 2).alias("total"))


def two_roles(spark, sf):
    roles = {"predictive": ["l_quantity", "l_discount", "absent"], "predicted": ["l_quantity", "l_extendedprice"]}
    out = reshape.two_role_series(table(spark, sf, "lineitem"), "l_shipdate", "l_returnflag", roles, "ship", "lineitem.parquet")
    return out.groupBy("series_id", "role", "dataset_family", "series_name").agg(
        F.count(F.lit(1)).alias("n_rows"), R(F.sum("value"), 2).alias("total"))


def raw_table(spark, sf):
    out = reshape.raw_table_series(table(spark, sf, "events"), "Nowhere", "", "site", "events.parquet", "events")
    return out.groupBy("series_id", "series_name", "role", "dataset_family", "source_file").agg(
        F.count(F.lit(1)).alias("n_rows"), R(F.sum("value"), 2).alias("total"))


def site_adapter(spark, sf):
    raw = table(spark, sf, "events").select(F.col("ts").alias("Sample Date"), F.col("value").alias("RNA load"),
                                            F.col("user_id").alias("WWTP id"), F.col("event_type").alias("Area"))
    return reshape.site_rows(raw, "Nowhere", "none", "site", "events.parquet").groupBy(
        "country", "source", "site_id", "region", "geography_level").agg(
        F.count(F.lit(1)).alias("n_rows"), R(F.sum("value"), 2).alias("total"), F.max("date").alias("last_date"))


def latest_manifests(spark, sf):
    doc = F.from_json("props", "k int")
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("feature_set"), F.format_string("%03d-%012d", doc["k"], F.col("event_id")).alias("latest_run_id"),
        F.lit(None).cast("string").alias("run_id"), doc["k"].cast("long").alias("rows"), F.lit(9).alias("columns"),
        F.date_format("ts", "yyyy-MM-dd").alias("data_start"), F.when(F.col("value") > 50, "passed").otherwise("").alias("validation_status"),
        F.lit("unchecked").alias("status"), F.concat(F.lit("data/"), F.col("event_type")).alias("path"))
    newest = rows.groupBy("feature_set").agg(F.max_by(F.struct(*rows.columns), "latest_run_id").alias("m")).select("m.*")
    return runs.manifest_view(newest).drop("date_max")


def page_links(spark, sf):
    found = links.extract_links(table(spark, sf, "pages"), contains=None)
    return found.select("page_url", "link", links.url_file_name("link").alias("file_name"),
                        links.keep_link(F.lit("ae_emergency_admissions"), F.col("link"), "e").alias("keep"))


def source_rows(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.lit("none").alias("pathogen"),
        F.when(k % 5 == 0, "unsure").when(k % 5 == 1, F.lit(None)).when(k % 5 == 2, "predicted").otherwise("predictive").alias("role"),
        F.when(k % 3 == 0, F.concat(F.lit("http://example.org/"), k)).alias("url"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "slug").alias("catalog_slug"),
        F.lit(None).cast("string").alias("google_trends_term"), F.lit(None).cast("string").alias("google_trends_local_file"))


def source_validation(spark, sf):
    return runs.validate_sources(source_rows(spark, sf)).select("name", "role", "status", "error")


def source_append(spark, sf):
    known = table(spark, sf, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_name").alias("name"))
    return runs.add_sources(known, source_rows(spark, sf)).groupBy("status", "error").agg(F.count(F.lit(1)).alias("n"))


def search_terms(spark, sf):
    customer = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("term"), F.concat(F.lit("p"), F.col("c_nationkey")).alias("period"), F.col("c_name").alias("local_file"))
    return files.search_terms(customer, "ui")


def chart_classes(spark, sf):
    docs = table(spark, sf, "documents")
    kind = files.chart_class(F.concat("source", F.lit(".csv")), F.array("text"))
    return docs.select("doc_id", kind.alias("series_type"))


def event_profiles(spark, sf):
    """Orders as events: levels and context follow from the keys of the order and its customer."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")

    def level(divisor, *names):
        out = F.lit(names[-1])
        for i, n in enumerate(names[:-1]):
            out = F.when((k / divisor).cast("long") % len(names) == i, n).otherwise(out)
        return out

    return orders.select(
        k.alias("event_id"), F.col("c_mktsegment").alias("event_name"), F.lit("influenza").alias("pathogen"),
        F.when(k % 97 == 0, F.lit(-1)).otherwise((F.col("o_totalprice") / 100).cast("int")).alias("attendance"),
        (k % 12 + 0.5).alias("duration_hours"), (k % 2 == 0).alias("indoor"),
        level(1, "low", "Medium ", "high").alias("crowding_level"), level(3, "good", "medium", "poor", "high").alias("ventilation_level"),
        level(5, "low", "medium", "high").alias("vocalisation_level"), level(7, "low", "medium", "high", "odd").alias("alcohol_level"),
        level(11, "low", "medium", "high").alias("travel_mixing_level"), level(13, "low", "medium", "high").alias("mitigation_level"),
        (F.when(k % 89 == 0, 1.5).otherwise((k % 50 + 1) / 5000.0)).alias("prevalence"), (0.5 + k % 4 / 4.0).alias("reproduction_number"),
        F.lit(0.7).alias("attendance_probability_if_infectious"), F.lit(0.2).alias("dispersion_k"),
        F.when(k % 3 != 0, (k % 1000).cast("double")).alias("regional_expected_transmissions"))


def event_taf(spark, sf):
    out = E.amplification(E.validated(event_profiles(spark, sf)))
    return out.select("event_id", "status", "error", "explanation", *rounded(
        ("log_amplification", "taf", "expected_infectious_attendees", "superspreading_threshold"), 6))


def event_moments(spark, sf):
    out = E.event_moments(event_profiles(spark, sf))
    return out.select("event_id", "status", "error", "risk_band", *rounded(
        ("expected_secondary_infections", "variance_secondary_infections", "p_superspreading", "secondary_infections_p05",
         "secondary_infections_p50", "secondary_infections_p95", "regional_contribution_index"), 4))


def leading_candidates(spark, sf):
    return forecast.leading_candidates(rollup.series_catalogue(canonical(spark, sf)))


def leading(spark, sf):
    out = forecast.leading_forecast(weekly_series(spark, sf), 4, cfg=BacktestConfig(lags=(1,)))
    return out.select(*PAIR, "period", "is_forecast", *rounded(("actual", "prediction", "lower", "upper"), 4))


def ar(spark, sf):
    return forecast.ar_forecast(weekly_series(spark, sf), 4)


def strategies(spark, sf):
    """Every target asks for one predictor; one of them asks for a predictor without later rows, one for none."""
    series = canonical(spark, sf)
    targets = series.where(F.col("role") == "predicted").select(F.col("series_id").alias("target_id")).distinct()
    ask = (F.when(F.col("target_id") == "orders::5-LOW", F.lit(None)).when(F.col("target_id") == "orders::2-HIGH", "no::such")
           .otherwise("lineitem::A"))
    return forecast.forecast_targets(series, targets.withColumn("predictor_id", ask), 4, PanelConfig())


def round_trip(spark, sf):
    """Orders written as semicolon-separated text and read back with separator and columns found again."""
    path = run_folder(spark, "orders-csv")
    table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).write.option(
        "sep", ";").option("header", True).csv(path)
    back = tables.read_delimited(spark, path)
    from ..functions import scalars as S
    return back.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_rows"), R(F.sum(S.to_number("o_totalprice")), 2).alias("total"),
        F.max(S.to_day("o_orderdate")).alias("last_date"))


def _files_of_folders(root, suffix, header):
    """Rows ordered by folder as one file in each folder, taking its name only when it is whole; gives the number of files."""
    def write(batches):
        count, folder, out = 0, None, None

        def finish():
            if out is not None:
                out.close()
                os.replace(out.name, os.path.join(root, folder, f"part-00000{suffix}"))

        for batch in batches:
            runs, start = pc.run_end_encode(batch.column("folder")), 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if name != folder:
                    finish()
                    os.makedirs(os.path.join(root, name), exist_ok=True)
                    folder, out = name, open(os.path.join(root, name, f".{uuid.uuid4().hex}"), "wb")
                    out.write(header)
                    count += 1
                out.writelines(line + b"\n" for line in batch.column("line")[start:end].to_pylist())
                start = end
        finish()
        yield pa.RecordBatch.from_pydict({"files": pa.array([count], pa.int64())})
    return write


def many_files(rows, root, keys, order, suffix, header=b""):
    """The lines of each combination of the keys (years and numbers) as one text file, in folders named like Spark's partitions.

    root is a folder of the machine's own file system: there Hadoop runs chmod twice for every file it creates, where its native library is missing.
    """
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for k in keys]
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, *order, "line").select(
        F.concat_ws("/", *parts).alias("folder"), F.col("line").cast("binary").alias("line"))
    os.makedirs(root, exist_ok=True)
    placed.mapInArrow(_files_of_folders(root, suffix, header), "files long").write.format("noop").mode("overwrite").save()


def landed_orders(spark, sf):
    """Orders as one text file for each year and hundred customers, customers as one CSV file for each hundred; the folder."""
    root = run_folder(spark, "files")
    year = F.coalesce(F.year("o_orderdate").cast("string"), F.lit("undated"))
    orders = table(spark, sf, "orders").select(
        year.alias("year"), F.floor(F.col("o_custkey") / 100).alias("block"), "o_orderkey",
        F.concat_ws(";", "o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("line"))
    buyers = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 100).alias("block"), "c_custkey", "c_nationkey")
    place = tables.qualified(spark, root)
    if place.startswith("file:"):
        local = place.removeprefix("file:")
        many_files(orders, f"{local}/orders", ("year", "block"), ("o_orderkey",), ".txt")
        many_files(buyers.withColumn("line", F.to_csv(F.struct("c_custkey", "c_nationkey"))), f"{local}/customers",
                   ("block",), ("c_custkey",), ".csv", b"c_custkey,c_nationkey\n")
        return root
    ordered = orders.repartition("year", "block").sortWithinPartitions("year", "block", "o_orderkey", "line")
    ordered.drop("o_orderkey").write.partitionBy("year", "block").text(f"{root}/orders")
    buyers.repartition("block").write.partitionBy("block").option("header", True).csv(f"{root}/customers")
    return root


def of_block(path="path"):
    return [F.regexp_extract(path, "/(orders|customers)/", 1).alias("kind"), F.regexp_extract(path, "year=([^/]+)/", 1).alias("year"),
            F.regexp_extract(path, "block=([0-9]+)/", 1).cast("long").alias("block")]


def file_inventory(spark, sf):
    """Size and suffix of every landed file."""
    return files.inventory(spark, landed_orders(spark, sf)).select(*of_block(), "suffix", "size_bytes", R("size_kb", 4).alias("size_kb"))


def file_checksums(spark, sf):
    """Length and digest of every landed text file."""
    return files.checksums(spark, landed_orders(spark, sf), "*.txt").select(*of_block(), "bytes", "sha256", "status")


def files_by_suffix(spark, sf):
    return files.size_by_suffix(files.inventory(spark, landed_orders(spark, sf)))


def chart_files(spark, sf):
    """Daily totals per event type landed as one CSV export each, read back as cells under the name of the chart."""
    path = run_folder(spark, "charts")
    daily = table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("date"), "event_type").agg(
        R(F.sum("value"), 2).alias("metric_value"))
    name = F.when(F.col("event_type") == "view", "gp-admissions").when(F.col("event_type") == "click", "nhs-111-calls").otherwise(F.col("event_type"))
    daily.repartition("event_type").withColumn("chart", name).drop("event_type").write.partitionBy("chart").option("header", True).csv(path)
    rows = cells.read_rows(spark, path).withColumn("path", F.concat(F.regexp_extract("path", "chart=([^/]+)/", 1), F.lit(".csv")))
    return rows


def landed_charts(spark, sf):
    """The charts classified and mapped file by file."""
    out = cells.chart_observations(chart_files(spark, sf))
    return out.groupBy(F.col("path").alias("chart"), "series_type", "date_column", "value_column", "week").agg(
        F.count(F.lit(1)).alias("n_rows"), R(F.sum("value"), 2).alias("total"))


def landed_catalogue(spark, sf):
    """Class and columns of every chart file."""
    out = cells.chart_catalogue(chart_files(spark, sf))
    return out.select("filename", "series_type", "date_column", "value_column", F.array_join("columns", ",").alias("columns"), "error")


def landed_months(spark, sf):
    """Attendances by month and site group over the exports of all event types; every seventh count is a suppression mark."""
    path = run_folder(spark, "months")
    rows = table(spark, sf, "events").where(F.col("event_id").isNotNull()).select(
        F.col("event_type").alias("kind"), F.date_format("ts", "dd/MM/yyyy").alias("month"),
        F.when(F.col("event_id") % 7 == 0, "*").otherwise((F.col("event_id") % 1500).cast("string")).alias("attendances"),
        (F.col("user_id") % 3).alias("site"))
    rows.repartition("kind").write.partitionBy("kind").option("header", True).csv(path)
    found = cells.read_rows(spark, path).withColumn("path", F.regexp_extract("path", "kind=([^/]+)/", 1))
    out = cells.monthly_totals(found, "attendances", ("site",))
    return out.select("source_file", "month", "site", R("value", 2).alias("value"))


def landed_events(spark, sf, *folders):
    """The events table as CSV files, one for each combination of the folders' columns, nested in this order."""
    path = run_folder(spark, "raw-landing")
    rows = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("sample_date"), F.col("value").alias("viral_load"), F.col("user_id").alias("site_id"),
                                             F.col("event_type").alias("kind"), (F.col("event_id") % 3).alias("part"))
    rows.repartition(*folders).write.partitionBy(*folders).option("header", True).csv(path)
    return path


def raw_folder_series(spark, sf):
    """Tables two folders deep, whose catalogue names the archive they came from; equal file names in two folders are two series."""
    path = landed_events(spark, sf, "kind", "part")
    entries = table(spark, sf, "events").select(F.concat(F.lit("kind="), F.col("event_type"), F.lit(".zip")).alias("filename")).distinct().select(
        "filename", F.lit("Nowhere").alias("country"), F.lit("none").alias("pathogen_scope"), F.lit("site").alias("level"))
    series = cells.raw_series(cells.read_rows(spark, path), entries, tables.qualified(spark, path))
    name = F.regexp_replace("series_name", "/part-[^/ ]+[.]csv", "")
    return series.groupBy("source_file", name.alias("series_name")).agg(F.count(F.lit(1)).alias("n_rows"), R(F.sum("value"), 2).alias("total"))


def landed_schemas(spark, sf):
    """Rows and columns of every landed file, counted by one job."""
    path = landed_events(spark, sf, "kind")
    found = cells.file_schemas(cells.read_rows(spark, path, plain_headers=True))
    return found.groupBy(F.regexp_extract("path", "kind=([^/]+)/", 1).alias("kind"), F.array_join("columns", ",").alias("columns"), "n_cols", "error").agg(
        F.sum("n_rows").alias("n_rows"))


def ingestion_run(spark, sf):
    """One ingestion run of the events table: written by source and run, then read back through its manifest."""
    root = run_folder(spark, "registry")
    raw = table(spark, sf, "events").select(F.col("ts").alias("date"), F.col("event_type").alias("location"), "value",
                                            F.when(F.col("user_id") % 4 == 0, F.col("user_id")).alias("visits"))
    runs.ingest(raw, {"name": "web", "pathogen": "none", "role": "predictive"}, root, "20240101T000000Z")
    runs.ingest(raw, {"name": "web", "pathogen": "none", "role": "predicted"}, root, "20240201T000000Z")
    newest = runs.latest_manifests(runs.manifests(spark, root)).select(
        F.col("feature_set").alias("source"), "run_id", "rows", "columns", "date_min", "date_max", "validation_status", "validation_notes")
    series = reshape.signal_series(runs.read_signals(spark, root, latest_only=True)).groupBy("role").agg(
        F.countDistinct("series_id").alias("n_series"), F.count(F.lit(1)).alias("n_observations"))
    return merged(newest, series.withColumn("source", F.lit("web")), "source")


def ingestion_rerun(spark, sf):
    """A run of the events table, a second one, and the second one again from the rows with a value of at least 5: the last writing counts."""
    root = run_folder(spark, "registry")
    raw = table(spark, sf, "events").select(F.col("ts").alias("date"), F.col("event_type").alias("location"), "value")
    for run, rows in (("20240101T000000Z", raw), ("20240201T000000Z", raw), ("20240201T000000Z", raw.where("value >= 5"))):
        runs.ingest(rows, {"name": "web", "pathogen": "none", "role": "predictive"}, root, run)
    stored = runs.read_signals(spark, root).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"), R(F.sum("value"), 2).alias("total"))
    return merged(stored, runs.manifests(spark, root).select("run_id", F.col("rows").alias("manifest_rows")), "run_id")


QUERIES = {
    "normalized_unpivot": unpivot,
    "ingest_stats": ingest_stats,
    "feature_table_to_series": feature_series,
    "signals_to_series": signal_series,
    "two_role_series": two_roles,
    "raw_table_to_series": raw_table,
    "site_adapter": site_adapter,
    "latest_manifests": latest_manifests,
    "link_extract": page_links,
    "source_validation": source_validation,
    "source_append": source_append,
    "search_terms": search_terms,
    "chart_classes": chart_classes,
    "event_taf": event_taf,
    "event_moments": event_moments,
    "leading_candidates": leading_candidates,
    "leading_indicator_forecast": leading,
    "ar_forecast": ar,
    "forecast_strategies": strategies,
    "delimited_round_trip": round_trip,
    "landed_charts": landed_charts,
    "ingestion_run": ingestion_run,
    "ingestion_rerun": ingestion_rerun,
    "raw_folder_series": raw_folder_series,
    "landed_schemas": landed_schemas,
    "landed_catalogue": landed_catalogue,
    "landed_months": landed_months,
    "file_inventory": file_inventory,
    "file_checksums": file_checksums,
    "files_by_suffix": files_by_suffix,
}

FILES_SQL = """
WITH lines AS (SELECT coalesce(CAST(year(o_orderdate) AS VARCHAR), 'undated') AS year, CAST(floor(o_custkey / 100) AS BIGINT) AS block, o_orderkey AS k,
                      concat_ws(';', o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d')) || chr(10) AS line FROM orders),
texts AS (SELECT 'orders' AS kind, year, block, '.txt' AS suffix, string_agg(line, '' ORDER BY k, line) AS content FROM lines GROUP BY ALL),
exports AS (SELECT 'customers' AS kind, '' AS year, CAST(floor(c_custkey / 100) AS BIGINT) AS block, '.csv' AS suffix,
                   'c_custkey,c_nationkey' || chr(10) || string_agg(c_custkey || ',' || c_nationkey || chr(10), '') AS content FROM customer GROUP BY ALL),
files AS (SELECT *, strlen(content) AS size FROM (SELECT * FROM texts UNION ALL SELECT * FROM exports))"""

SIGNALS_SQL = """
signals AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_quantity AS value, 'l_quantity' AS signal_type, l_returnflag AS geography_name FROM lineitem
  UNION ALL SELECT CAST(l_shipdate AS DATE), CASE WHEN l_linenumber <> 3 THEN l_discount END, 'l_discount', l_returnflag FROM lineitem),
kept AS (SELECT * FROM signals WHERE date IS NOT NULL AND value IS NOT NULL)"""

LEVELS = {
    "crowding": (1, [("low", -0.15), ("Medium ", 0.25), ("high", 0.70)]),
    "ventilation": (3, [("good", -0.45), ("medium", 0.20), ("poor", 0.80), ("high", -0.45)]),
    "vocalisation": (5, [("low", 0.0), ("medium", 0.30), ("high", 0.70)]),
    "alcohol": (7, [("low", 0.0), ("medium", 0.15), ("high", 0.35), ("odd", 0.0)]),
    "travel mixing": (11, [("low", 0.0), ("medium", 0.20), ("high", 0.45)]),
    "mitigation": (13, [("low", 0.0), ("medium", -0.35), ("high", -0.70)]),
}


def taf_sql():
    def case(divisor, weights):
        return ("CASE " + " ".join(f"WHEN (k // {divisor}) % {len(weights)} = {i} THEN {w}::DOUBLE" for i, (_, w) in enumerate(weights)) + " END")
    factors = [("indoor", "CASE WHEN k % 2 = 0 THEN 0.6::DOUBLE ELSE -0.25 END")]
    factors += [(name, case(d, w)) for name, (d, w) in LEVELS.items()]
    factors += [("duration", "CASE WHEN k % 12 + 0.5 > 8 THEN 0.6::DOUBLE WHEN k % 12 + 0.5 > 4 THEN 0.3 WHEN k % 12 + 0.5 < 1 THEN -0.15 ELSE 0 END")]
    listed = ", ".join(f"{{'i': {i}, 'name': '{n}', 'w': {c}}}" for i, (n, c) in enumerate(factors))

    def names(sign, size, fallback):
        top = f"list_sort(list_transform(list_filter(f, lambda e: e.w {sign} 0), lambda e: {{'k': -abs(e.w), 'i': e.i, 'name': e.name}}))"
        return f"coalesce(nullif(array_to_string(list_transform(({top})[1:{size}], lambda e: e.name), ', '), ''), '{fallback}')"
    return f"""
WITH e AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 97 = 0 THEN -1 ELSE CAST(trunc(o_totalprice / 100) AS INTEGER) END AS attendance,
         CASE WHEN o_orderkey % 89 = 0 THEN 1.5::DOUBLE ELSE (o_orderkey % 50 + 1) / 5000.0::DOUBLE END AS prevalence,
         0.5::DOUBLE + (o_orderkey % 4) / 4.0::DOUBLE AS r FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT *, [{listed}] AS f FROM e),
s AS (SELECT *, list_sum(list_transform(f, lambda e: e.w)) AS score, attendance * prevalence * 0.7::DOUBLE AS i FROM f),
t AS (SELECT *, least(exp(score), 25) AS taf,
             CASE WHEN i * r <= 0 THEN 1 ELSE greatest(1, i * r + 2.3263478740408408 * sqrt(i * r) + 0.5) END AS threshold,
             CASE WHEN attendance < 0 THEN 'attendance must be non-negative'
                  WHEN prevalence NOT BETWEEN 0 AND 1 THEN 'prevalence must be between 0 and 1' ELSE '' END AS error FROM s)
SELECT k AS event_id, CASE WHEN error = '' THEN 'ok' ELSE 'error' END AS status, error,
       'TAF is ' || printf('%.2f', taf) || '. Main amplifying factors: ' || {names('>', 3, 'baseline event conditions')} ||
       '. Main reducing factors: ' || {names('<', 2, 'none')} || '. Context uses prevalence=' || printf('%.4f', prevalence) ||
       ', R_t=' || printf('%.2f', r) || ', dispersion k=0.20.' AS explanation,
       rnd(score, 6) AS log_amplification, rnd(taf, 6) AS taf, rnd(i, 6) AS expected_infectious_attendees,
       rnd(threshold, 6) AS superspreading_threshold FROM t"""


EVENTS_SQL = taf_sql()
CALLS = "|".join(w for w in ("nhs111", "nhs-111", "nhs_111", "111", "call", "online"))
VISITS = "gp|general-practice|general_practice|admission|consultation"

ORACLES = {
    "normalized_unpivot": "WITH " + SIGNALS_SQL + """
SELECT 'shipping' AS source, 'none' AS pathogen, 'predicted' AS role, signal_type, signal_type AS metric, geography_name,
       'unknown' AS geography_code, count(*) AS n_rows, rnd(sum(value), 2) AS total, min(date) AS first_date FROM kept GROUP BY ALL""",
    "ingest_stats": "WITH " + SIGNALS_SQL + """,
m AS (SELECT (avg(CASE WHEN l_quantity IS NULL THEN 1.0::DOUBLE ELSE 0 END) + avg(CASE WHEN l_linenumber = 3 OR l_discount IS NULL THEN 1.0::DOUBLE ELSE 0 END)) / 2 AS f FROM lineitem),
s AS (SELECT count(*) AS n, count(DISTINCT signal_type) AS k, CAST(min(date) AS VARCHAR) AS a, CAST(max(date) AS VARCHAR) AS b FROM kept)
SELECT 'shipping' AS source, n AS rows, k AS signal_count, a AS date_min, b AS date_max, rnd(f, 6) AS missing_value_fraction,
       CASE WHEN f > 0.5 THEN 'failed' WHEN f > 0.1 THEN 'warning' ELSE 'passed' END AS validation_status,
       'shipping: ' || n || ' rows across ' || k || ' signals, ' || a || ' to ' || b || '.' AS summary FROM s, m""",
    "feature_table_to_series": """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS p, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1),
l AS (SELECT date, p AS v, 'target_price' AS c, 'predicted' AS role FROM d UNION ALL SELECT date, n, 'n_orders', 'predictive' FROM d)
SELECT date, rnd(v, 4) AS value, 'agent_feature::daily_orders::' || c AS series_id, role, 'agent_feature::Daily Orders' AS dataset_family,
       'Daily Orders: ' || c AS series_name, 'orders.parquet' AS source_file FROM l""",
    "signals_to_series": """
WITH s AS (SELECT CASE event_type WHEN 'view' THEN 'hospital_admissions' ELSE event_type END AS t, user_id % 4 AS u, value, event_type FROM events)
SELECT 'agent_signal::web::none::' || t || '::rate::user_' || u || '::' || CASE WHEN u <> 0 THEN 'x' ELSE 'unknown' END AS series_id,
       CASE WHEN event_type IN ('click', 'view') THEN 'predicted' ELSE 'predictive' END AS role, 'agent_normalized_signal' AS dataset_family,
       'User ' || u || ' none ' || t || ' rate' AS series_name, count(*) AS n_rows, rnd(sum(value), 2) AS total
FROM s GROUP BY ALL HAVING count(value) >= 3""",
    "two_role_series": """
WITH l AS (
  SELECT l_returnflag AS g, 'l_quantity' AS c, 'predictive' AS role, 'ship_predictive' AS fam, l_quantity AS v FROM lineitem UNION ALL
  SELECT l_returnflag, 'l_discount', 'predictive', 'ship_predictive', l_discount FROM lineitem UNION ALL
  SELECT l_returnflag, 'l_quantity', 'predicted', 'ship_target', l_quantity FROM lineitem UNION ALL
  SELECT l_returnflag, 'l_extendedprice', 'predicted', 'ship_target', l_extendedprice FROM lineitem)
SELECT fam || '::' || g || '::' || c AS series_id, role, fam AS dataset_family, g || ' ' || c AS series_name, count(v) AS n_rows,
       rnd(sum(v), 2) AS total FROM l GROUP BY ALL HAVING count(v) >= 10""",
    "raw_table_to_series": """
SELECT 'wastewater_raw::Nowhere / site / events / value' AS series_id, 'Nowhere / site / events / value' AS series_name,
       'predictive' AS role, 'wastewater_raw' AS dataset_family, 'events.parquet' AS source_file, count(value) AS n_rows,
       rnd(sum(value), 2) AS total FROM events WHERE ts IS NOT NULL""",
    "site_adapter": """
SELECT 'Nowhere' AS country, 'events.parquet' AS source, CAST(user_id AS VARCHAR) AS site_id, event_type AS region, 'site' AS geography_level,
       count(value) AS n_rows, rnd(sum(value), 2) AS total, CAST(max(ts) AS DATE) AS last_date FROM events WHERE value IS NOT NULL GROUP BY ALL""",
    "latest_manifests": """
WITH r AS (SELECT event_type, printf('%03d-%012d', CAST(props->>'k' AS INTEGER), event_id) AS run, CAST(props->>'k' AS BIGINT) AS k, ts, value FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY run DESC) AS i FROM r)
SELECT event_type AS feature_set, 'unknown' AS artifact_type, run AS run_id, k AS rows, 9 AS columns, strftime(ts, '%Y-%m-%d') AS date_min,
       CASE WHEN value > 50 THEN 'passed' ELSE 'unchecked' END AS validation_status, 'data/' || event_type AS path FROM n WHERE i = 1""",
    "link_extract": r"""
WITH h AS (SELECT url, unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)) AS href FROM pages),
a AS (SELECT DISTINCT url AS page_url, CASE WHEN t LIKE 'http%' THEN t ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || t END AS link
      FROM (SELECT url, replace(replace(replace(replace(href, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM h)),
p AS (SELECT *, url_decode(replace(link, '+', '%2B')) AS u,
             regexp_replace(regexp_replace(link, '[?#].*$', ''), '^[a-z]+://[^/]*', '') AS path FROM a)
SELECT page_url, link, regexp_replace(list_extract(string_split(rtrim(url_decode(replace(path, '+', '%2B')), '/'), '/'), -1), '[^A-Za-z0-9._-]+', '_', 'g') AS file_name,
       lower(u) LIKE '%e' AND contains(lower(u), 'monthly') AND contains(lower(u), 'ae') AS keep FROM p""",
    "source_validation": """
WITH s AS (SELECT c_name AS name, c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END AS n FROM customer),
e AS (SELECT *, CASE WHEN n <> 1 THEN 'exactly one location field must be set' WHEN k % 5 = 0 THEN 'role must be predictive or predicted' ELSE '' END AS error FROM s)
SELECT name, CASE k % 5 WHEN 0 THEN 'unsure' WHEN 2 THEN 'predicted' ELSE 'predictive' END AS role,
       CASE WHEN error = '' THEN 'ok' ELSE 'error' END AS status, error FROM e""",
    "source_append": """
WITH s AS (SELECT c_name, c_custkey AS k, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END AS n FROM customer),
e AS (SELECT *, CASE WHEN c_acctbal < 0 THEN 'a source of this name already exists' WHEN n <> 1 THEN 'exactly one location field must be set'
                     WHEN k % 5 = 0 THEN 'role must be predictive or predicted' ELSE '' END AS error FROM s)
SELECT CASE WHEN error = '' THEN 'ok' ELSE 'error' END AS status, error, count(*) AS n FROM e GROUP BY ALL""",
    "search_terms": """
WITH h AS (SELECT c_mktsegment AS term, 'p' || c_nationkey AS period, c_name AS local_file,
                  row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_name) AS i FROM customer WHERE contains(lower(c_mktsegment), 'ui'))
SELECT term, period, local_file FROM h WHERE i = 1 ORDER BY period, local_file, term LIMIT 10""",
    "chart_classes": f"""
WITH t AS (SELECT doc_id, replace(lower(source || '.csv'), '_', '-') || ' ' || lower(text) AS t FROM documents),
c AS (SELECT doc_id, t, regexp_matches(t, '{CALLS}') AS calls, regexp_matches(t, '{VISITS}') AS visits FROM t)
SELECT doc_id, CASE WHEN calls AND NOT visits THEN 'nhs_calls' WHEN visits AND NOT calls THEN 'gp_admissions'
  WHEN calls AND visits THEN CASE WHEN contains(t, 'admission') OR contains(t, 'gp') THEN 'gp_admissions' ELSE 'nhs_calls' END ELSE 'other' END AS series_type FROM c""",
    "event_taf": EVENTS_SQL,
    "event_moments": EVENTS_SQL[:EVENTS_SQL.rindex("SELECT k AS event_id")] + f""",
w AS (SELECT *, r * taf AS m, least(prevalence * 0.7::DOUBLE, 1) AS q, CASE WHEN k % 3 <> 0 THEN CAST(k % 1000 AS DOUBLE) END AS region FROM t),
v AS (SELECT *, attendance * q * m AS mean, attendance * q * (m + m * m / 0.2::DOUBLE) + attendance * q * (1 - q) * m * m AS variance FROM w),
u AS (SELECT *, CASE WHEN error = '' AND variance > 0 THEN (threshold - mean) / sqrt(variance) END AS z,
             CASE WHEN error = '' THEN sqrt(variance) END AS spread FROM v),
p AS (SELECT *, CASE WHEN error <> '' THEN NULL WHEN variance > 0 THEN {NORMAL_SF} ELSE CASE WHEN mean > threshold THEN 1 ELSE 0 END END AS tail FROM u)
SELECT k AS event_id, CASE WHEN error = '' THEN 'ok' ELSE 'error' END AS status, error,
       CASE WHEN error <> '' THEN NULL WHEN tail >= 0.35 OR mean >= 50 THEN 'very high' WHEN tail >= 0.15 OR mean >= 20 THEN 'high'
            WHEN tail >= 0.05 OR mean >= 5 THEN 'moderate' ELSE 'low' END AS risk_band,
       rnd(CASE WHEN error = '' THEN mean END, 4) AS expected_secondary_infections, rnd(CASE WHEN error = '' THEN variance END, 4) AS variance_secondary_infections,
       rnd(tail, 4) AS p_superspreading, rnd(greatest(0, mean - 1.6448536269514722 * spread) * CASE WHEN error = '' THEN 1 END, 4) AS secondary_infections_p05,
       rnd(mean * CASE WHEN error = '' THEN 1 END, 4) AS secondary_infections_p50,
       rnd(greatest(0, mean + 1.6448536269514722 * spread) * CASE WHEN error = '' THEN 1 END, 4) AS secondary_infections_p95,
       rnd(CASE WHEN error = '' AND region > 0 THEN mean / region END, 4) AS regional_contribution_index FROM p""",
    "leading_candidates": "WITH " + CANONICAL_SQL + """,
c AS (SELECT series_id, min(role) AS role, max(date) AS e FROM canonical GROUP BY series_id)
SELECT a.series_id AS predictor_id, a.e AS predictor_end, b.series_id AS target_id, b.e AS target_end
FROM c a JOIN c b ON a.role = 'predictive' AND b.role = 'predicted' AND a.e > b.e""",
    "leading_indicator_forecast": rolling_ctes((1,)) + """,
x AS (SELECT series_id AS predictor_id, period, lag(value) OVER (PARTITION BY series_id ORDER BY period) AS x FROM weekly WHERE role = 'predictive'),
paired AS (SELECT predictor_id, w.series_id AS target_id, x.period, x, w.value AS y FROM x JOIN weekly w ON w.period = x.period AND w.role = 'predicted' WHERE x IS NOT NULL),
st AS (SELECT predictor_id, target_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_samp(x) AS sx, stddev_samp(y) AS sy, corr(x, y) AS r
       FROM paired GROUP BY ALL HAVING count(*) >= 13),
ends AS (SELECT series_id AS target_id, max(period) AS e FROM weekly WHERE role = 'predicted' GROUP BY 1),
ahead AS (SELECT st.*, x.period, x.x, row_number() OVER (PARTITION BY st.predictor_id, st.target_id ORDER BY x.period) AS step
          FROM st JOIN ends USING (target_id) JOIN x ON x.predictor_id = st.predictor_id AND x.period > ends.e WHERE x.x IS NOT NULL),
lines AS (SELECT *, (n - 1) / (n - 1 + 1.0::DOUBLE) AS f FROM ahead WHERE step <= 4),
done AS (SELECT *, my + r * sy / sx * f * (x - mx) AS p, sy * sqrt(1 - 2 * f * r * r + f * f * r * r) AS s FROM lines)
SELECT predictor_id, target_id, period, TRUE AS is_forecast, NULL::DOUBLE AS actual, rnd(p, 4) AS prediction,
       rnd(p - 1.2815515655446004 * s, 4) AS lower, rnd(p + 1.2815515655446004 * s, 4) AS upper FROM done
UNION ALL
SELECT predictor_id, target_id, period, FALSE, rnd(y, 4), rnd(prediction, 4), NULL, NULL FROM final
WHERE (predictor_id, target_id) IN (SELECT (predictor_id, target_id) FROM done)""",
    "delimited_round_trip": """
SELECT o_orderpriority, count(*) AS n_rows, rnd(sum(o_totalprice), 2) AS total, CAST(max(o_orderdate) AS DATE) AS last_date FROM orders GROUP BY 1""",
    "landed_charts": """
WITH d AS (SELECT CAST(ts AS DATE) AS date, event_type, rnd(sum(value), 2) AS v FROM events GROUP BY ALL)
SELECT CASE event_type WHEN 'view' THEN 'gp-admissions' WHEN 'click' THEN 'nhs-111-calls' ELSE event_type END || '.csv' AS chart,
       CASE event_type WHEN 'view' THEN 'gp_admissions' WHEN 'click' THEN 'nhs_calls' ELSE 'other' END AS series_type,
       'date' AS date_column, 'metric_value' AS value_column, CAST(date_trunc('week', date) AS DATE) AS week,
       count(*) AS n_rows, rnd(sum(v), 2) AS total FROM d GROUP BY ALL""",
    "landed_catalogue": """
SELECT DISTINCT CASE event_type WHEN 'view' THEN 'gp-admissions' WHEN 'click' THEN 'nhs-111-calls' ELSE event_type END || '.csv' AS filename,
       CASE event_type WHEN 'view' THEN 'gp_admissions' WHEN 'click' THEN 'nhs_calls' ELSE 'other' END AS series_type,
       'date' AS date_column, 'metric_value' AS value_column, 'date,metric_value' AS columns, '' AS error FROM events""",
    "landed_months": """
SELECT event_type AS source_file, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(user_id % 3 AS VARCHAR) AS site,
       rnd(sum(CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 1500 AS DOUBLE) END), 2) AS value
FROM events WHERE event_id IS NOT NULL GROUP BY ALL""",
    "file_inventory": FILES_SQL + """
SELECT kind, year, block, suffix, CAST(size AS BIGINT) AS size_bytes, rnd(size / 1024, 4) AS size_kb FROM files""",
    "file_checksums": FILES_SQL + """
SELECT kind, year, block, CAST(size AS BIGINT) AS bytes, sha256(content) AS sha256, 'ok' AS status FROM files WHERE suffix = '.txt'""",
    "files_by_suffix": FILES_SQL + """
SELECT suffix, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_bytes FROM files GROUP BY suffix""",
    "raw_folder_series": """
SELECT 'kind=' || event_type || '.zip' AS source_file,
       'Nowhere / none / site / kind=' || event_type || '/part=' || CAST(event_id % 3 AS VARCHAR) || ' / viral_load' AS series_name,
       count(*) AS n_rows, rnd(sum(value), 2) AS total
FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY event_type, event_id % 3 HAVING count(*) >= 3""",
    "landed_schemas": """
SELECT event_type AS kind, 'sample_date,viral_load,site_id,part' AS columns, 4 AS n_cols, '' AS error, count(*) AS n_rows FROM events GROUP BY event_type""",
    "ingestion_rerun": """
SELECT '20240101T000000Z' AS run_id, count(value) AS n_rows, rnd(sum(value), 2) AS total, count(value) AS manifest_rows FROM events
UNION ALL SELECT '20240201T000000Z', count(*), rnd(sum(value), 2), count(*) FROM events WHERE value >= 5""",
    "ingestion_run": """
WITH m AS (SELECT avg(CASE WHEN user_id % 4 <> 0 THEN 1.0::DOUBLE ELSE 0 END) / 2 AS f, count(value) + count(*) FILTER (WHERE user_id % 4 = 0) AS n,
                  strftime(min(ts), '%Y-%m-%d') AS a, strftime(max(ts), '%Y-%m-%d') AS b FROM events)
SELECT 'web' AS source, '20240201T000000Z' AS run_id, n AS rows, 9 AS columns, a AS date_min, b AS date_max,
       CASE WHEN f > 0.5 THEN 'failed' WHEN f > 0.1 THEN 'warning' ELSE 'passed' END AS validation_status,
       CASE WHEN f > 0.1 THEN CAST(round(f * 100) AS INTEGER) || '% of values are missing.' ELSE 'No heuristic anomalies detected.' END AS validation_notes,
       'predicted' AS role, 2 * (SELECT count(DISTINCT event_type) FROM events) AS n_series, n AS n_observations FROM m""",
}
