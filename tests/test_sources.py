import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from epitide.operators import profile, reshape
from epitide.plans import events, pipelines
from epitide.schema import REGISTRY
from epitide.sources import cells, files, links, runs, tables

D = dt.date


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_separators_and_encodings(spark, tmp_path):
    assert tables.read_delimited(spark, write(tmp_path / "a.csv", "d;v\n2024-01-01;1,5\n")).columns == ["d", "v"]
    tab = tables.read_table(spark, write(tmp_path / "b.tsv", "d\tv\n2024-01-01\t2\n"))
    assert tab.first()["v"] == "2"
    bom = tables.read_delimited(spark, write(tmp_path / "c.csv", "﻿date,Nom\n2024-01-01,é\n"))
    assert bom.columns == ["date", "Nom"]
    latin = tables.read_delimited(spark, write(tmp_path / "d.csv", "date,Nom\n2024-01-01,é\n", "latin-1"))
    assert latin.first()["Nom"] == "é"
    assert tables.read_table(spark, write(tmp_path / "e.json", '[{"a": 1}, {"a": 2}]')).count() == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.bin")


def test_preamble_and_words(spark, tmp_path):
    meteo = write(tmp_path / "open_meteo_london.csv", "latitude,longitude\n51.5,0.1\n\ntime,temp (C)\n2024-01-01,3\n2024-01-02,4\n")
    df = tables.read_with_preamble(spark, meteo)
    assert df.columns == ["time", "temp (C)"] and df.count() == 2
    words = tables.read_words(spark, write(tmp_path / "t.txt", "Date  Value\n2024-01-01   3.5\n2024-01-02 4\n"))
    assert words.columns == ["Date", "Value"] and words.count() == 2


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "pack.zip", "w") as z:
        z.writestr("one.csv", 'date,v\n2024-01-01,"1,000"\n2024-01-02,2\n')
        z.writestr("sub/two.tsv", "date\tv\n2024-01-01\t5\n")
        z.writestr("three.json", json.dumps([{"date": "2024-01-01", "v": 1}]))
        z.writestr("readme.md", "x")
    lines = tables.read_zip_lines(spark, str(tmp_path))
    assert {r["member"]: r["n_lines"] for r in tables.zip_members(lines).collect()} == {"one.csv": 3, "sub/two.tsv": 2, "three.json": 1}
    assert [r["v"] for r in tables.zip_table(lines, "one.csv").orderBy("date").collect()] == ["1,000", "2"]
    assert tables.zip_table(lines, "sub/two.tsv").first()["v"] == "5"
    assert tables.zip_table(lines, "three.json").first()["v"] == 1
    catalogue = spark.createDataFrame([("x", "y", "z", "pack.zip"), ("x", "y", "z", "gone.csv")],
                                      "country string, pathogen_scope string, level string, filename string")
    found = files.source_schemas(spark, catalogue, str(tmp_path)).collect()
    assert len(found) == 4 and [r["exists"] for r in found if r["source_file"] == "gone.csv"] == [False]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """A small landing tree with every family of files."""
    root = tmp_path_factory.mktemp("landing")
    weeks = [D(2024, 1, 7) + dt.timedelta(weeks=i) for i in range(30)]
    search = root / "Google_trends_v2" / "1y_data"
    for name in ("time_series_GB_cough.csv", "time_series_GB_fever.csv"):
        write(search / name, '"Time","persistent cough"\n' + "".join(f'"{w}",{i}\n' for i, w in enumerate(weeks)))
    write(search / "time_series_GB_bad.csv", "just one column\n1\n")
    write(root / "charts" / "ukhsa-chart-nhs-111-calls.csv", "﻿Date,Metric Value\n" + "".join(f'{w},"{1000 + i}"\n' for i, w in enumerate(weeks)))
    write(root / "charts" / "ukhsa-chart-hospital-admissions.csv", "date,value\n" + "".join(f"{w},{20 + i % 7}\n" for i, w in enumerate(weeks)))
    write(root / "charts" / "ukhsa-chart-broken.csv", "only,text\nx,y\n")
    write(root / "sources.csv", "country,pathogen_scope,level,format,url,filename\nBelgium,rsv,site,zip,u,bel.zip\nScotland,cov,national,csv,u,scot.csv\n")
    (root / "data" / "raw").mkdir(parents=True)
    with zipfile.ZipFile(root / "data" / "raw" / "bel.zip", "w") as z:
        z.writestr("m.csv", "sample_date,site_id,viral_load\n" + "".join(f"{w},{i},{i * 2}\n" for i, w in enumerate(weeks)))
    write(root / "data" / "raw" / "scot.csv", "week;rna_copies;postcode\n" + "".join(f"{w};{i};EH{i}\n" for i, w in enumerate(weeks)))
    write(root / "data" / "external" / "weather" / "open_meteo_london.csv",
          "latitude,longitude\n51.5,0.1\n\ntime,temperature\n" + "".join(f"{w},{i / 2}\n" for i, w in enumerate(weeks)))
    write(root / "data" / "external" / "owid_covid_data.csv", "location,date,new_cases_smoothed,hosp_patients,stringency_index\n" + "".join(
        f"{p},{w},{i},{'' if i < 25 else i},1\n" for p in ("United Kingdom", "France") for i, w in enumerate(weeks)))
    return root


def test_search_files(spark, tree):
    rows = cells.read_rows(spark, str(tree / "Google_trends_v2"), "time_series_GB*")
    got = {r["filename"]: r for r in cells.search_catalogue(rows).collect()}
    assert got["time_series_GB_cough.csv"]["predictor_column"] == "persistent_cough"
    assert got["time_series_GB_cough.csv"]["usable_predictor_values"] == 30 and got["time_series_GB_bad.csv"]["status"] == "error"
    terms = cells.search_observations(rows)
    assert {r["search_term"] for r in terms.select("search_term").distinct().collect()} == {"cough", "fever"}
    assert cells.search_observations(rows, label="header").select("search_term").distinct().count() == 1
    first = terms.where("search_term = 'cough'").orderBy("date").first()
    assert (first["date"], first["week"], first["month"]) == (D(2024, 1, 7), D(2024, 1, 1), D(2024, 1, 1))


def test_chart_files(spark, tree):
    rows = cells.read_rows(spark, str(tree / "charts"))
    got = {r["filename"]: r for r in cells.chart_catalogue(rows).collect()}
    assert got["ukhsa-chart-nhs-111-calls.csv"]["series_type"] == "nhs_calls"
    assert got["ukhsa-chart-hospital-admissions.csv"]["series_type"] == "gp_admissions"
    assert got["ukhsa-chart-broken.csv"]["series_type"] == "error" and got["ukhsa-chart-broken.csv"]["error"]
    assert got["ukhsa-chart-nhs-111-calls.csv"]["value_column"] == "metric_value"


def test_all_series(spark, tree):
    series = pipelines.all_series(spark, pipelines.Landing(str(tree)))
    families = {(r["role"], r["dataset_family"]): r["n"] for r in series.groupBy("role", "dataset_family").agg(
        F.countDistinct("series_id").alias("n")).collect()}
    assert families == {
        ("predictive", "google_trends_1y"): 2, ("predictive", "ukhsa_nhs_calls"): 1, ("predicted", "ukhsa_gp_admissions"): 1,
        ("predictive", "wastewater_raw"): 2, ("predictive", "open_meteo_weather"): 1,
        ("predictive", "owid_covid_predictive"): 2, ("predicted", "owid_covid_target"): 1}
    raw = {r["series_name"] for r in series.where("dataset_family = 'wastewater_raw'").select("series_name").distinct().collect()}
    assert raw == {"Belgium / rsv / site / bel.zip:m.csv / viral_load", "Scotland / cov / national / scot.csv / rna_copies"}


def test_model_run_writes_everything(spark, tree, tmp_path):
    from epitide.schema import PanelConfig
    series = pipelines.all_series(spark, pipelines.Landing(str(tree)), external=False)
    best = pipelines.model_run(series, str(tmp_path / "out"), PanelConfig(lags=(1,)), trees=2, rounds=1)
    assert best.count() == 5
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "family_counts")).count() == 4
    with pytest.raises(ValueError):
        pipelines.model_run(series.where("role = 'predictive'"), str(tmp_path / "none"))


def test_monthly_totals(spark, tmp_path):
    write(tmp_path / "a.csv", 'Period,Calls,Region\n2024-01-03,"1,000",N\n2024-01-20,*,N\n2024-02-01,5,S\n')
    write(tmp_path / "b.csv", "Period,Other\n2024-01-03,1\n")
    out = cells.monthly_totals(cells.read_rows(spark, str(tmp_path)), "calls", ["region"]).orderBy("month").collect()
    assert [(r["month"], r["region"], r["value"]) for r in out] == [(D(2024, 1, 1), "N", 1000.0), (D(2024, 2, 1), "S", 5.0)]


def test_ingestion_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([(str(D(2026, 1, 4) + dt.timedelta(weeks=i)), "Testland", float(i), float(i) / 2) for i in range(4)],
                                "date string, location string, new_cases double, new_deaths double")
    manifest = runs.ingest(raw, {"name": "test", "pathogen": "rsv", "role": "predicted"}, str(tmp_path), "r1").first()
    assert manifest["rows"] == 8 and manifest["validation_status"] == "passed"
    back = runs.read_signals(spark, str(tmp_path))
    assert {r["role"] for r in back.select("role").collect()} == {"predicted"}
    assert reshape.signal_series(back).select("series_id").distinct().count() == 2
    runs.ingest(raw, {"name": "test", "pathogen": "rsv", "role": "predicted"}, str(tmp_path), "r2")
    assert runs.read_signals(spark, str(tmp_path)).count() == 16 and runs.read_signals(spark, str(tmp_path), True).count() == 8
    table, newest = runs.read_feature_table(spark, str(tmp_path), "test")
    assert table.count() == 8 and newest["run_id"] == "r2"
    with pytest.raises(ValueError):
        runs.ingest(raw.drop("date"), {"name": "bad", "pathogen": "rsv", "role": "predicted"}, str(tmp_path), "r3")


def test_pointer_files(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "features" / "rsv.parquet"))
    write(tmp_path / "manifests" / "m.json", json.dumps({"feature_set": "rsv", "path": "features/rsv.parquet", "rows": 4}))
    write(tmp_path / "latest" / "rsv.json", json.dumps({"feature_set": "rsv", "latest_run_id": "r9", "manifest_path": "manifests/m.json"}))
    table, manifest = runs.read_pointer(spark, str(tmp_path), "rsv")
    assert table.count() == 4 and manifest["run_id"] == "r9"


def test_known_table_shapes(spark):
    daily = spark.createDataFrame([("Belgium", "2020-03-12", 1.0)], "entities string, dates string, weekly double")
    assert runs.catalogue_mapping(daily) == {"date_column": "dates", "geography_column": "entities", "signal_columns": ["weekly"]}
    annual = spark.createDataFrame([("Belgium", y, 5) for y in (-10000, -9000, 2020)], "entities string, years int, population bigint")
    out = reshape.normalized_signals(annual, "pop", "none", "predictive", runs.catalogue_mapping(annual)).collect()
    assert [r["date"] for r in out] == [D(2020, 1, 1)]
    trends = spark.createDataFrame([(D(2026, 1, 4), 3, False)], "date date, `/m/1` int, isPartial boolean")
    flat, mapping = runs.trends_mapping(trends)
    assert flat.columns == ["date", "/m/1"] and mapping["signal_columns"] == ["/m/1"]
    local = spark.createDataFrame([("2026-01-04", "37"), ("2026-01-11", "27")], "Time string, `persistent cough` string")
    flat, mapping = runs.local_trends_mapping(local)
    assert mapping == {"date_column": "time", "geography_column": None, "signal_columns": ["persistent_cough"]}


def test_source_registry(spark, tmp_path):
    def row(name, role="predictive", url=None, slug=None):
        return (name, "rsv", "", role, url, slug, None, None, None, None)
    new = spark.createDataFrame([row("a", url="u"), row("b"), row("c", url="u", slug="s"), row("d", "unsure", "u"), row("e", None, "u")], REGISTRY)
    path = str(tmp_path / "registry")
    got = {r["name"]: (r["status"], r["role"]) for r in runs.append_sources(path, new).collect()}
    assert got == {"a": ("ok", "predictive"), "b": ("error", "predictive"), "c": ("error", "predictive"), "d": ("error", "unsure"), "e": ("ok", "predictive")}
    again = {r["name"]: r["error"] for r in runs.append_sources(path, spark.createDataFrame([row("a", url="v"), row("f", url="v")], REGISTRY)).collect()}
    assert again["a"] and not again["f"] and spark.read.parquet(path).count() == 3


def test_search_hits_once_per_term_and_period(spark):
    df = spark.createDataFrame([("Cough", "1y", "a.csv"), ("cough", "1y", "a (1).csv"), ("Cough", "5y", "b.csv"), ("Fever", "1y", "c.csv")],
                               "term string, period string, local_file string")
    assert files.search_terms(df, "COUGH").count() == 2


def test_links(spark):
    html = """<a href="/x/IUCADC_raw.csv">a</a> <A HREF='sub/b%20c.csv?x=1&amp;y=2'>b</A> <a href="//h.org/Monthly-AE.csv">c</a>
    <a href="https://h.org/Monthly-AE-growth.csv">d</a> <a href="/x/IUCADC_raw.csv">a</a> <a href="page.html">e</a>"""
    df = spark.createDataFrame([("https://site.org/dir/index.html?q=1", html)], "url string, html string")
    found = {r["link"] for r in links.extract_links(df).collect()}
    assert found == {"https://site.org/x/IUCADC_raw.csv", "https://site.org/dir/sub/b%20c.csv?x=1&y=2", "https://h.org/Monthly-AE.csv",
                     "https://h.org/Monthly-AE-growth.csv"}
    kept = links.extract_links(df).where(links.keep_link(F.lit("ae_emergency_admissions"), F.col("link")))
    assert [r["link"] for r in kept.collect()] == ["https://h.org/Monthly-AE.csv"]
    names = links.extract_links(df).select(links.url_file_name("link").alias("n"))
    assert "b_c.csv" in {r["n"] for r in names.collect()}


def event(**changes):
    base = dict(event_id="e", event_name="n", pathogen="covid", attendance=1000, duration_hours=3.0, indoor=True, crowding_level="medium",
                ventilation_level="medium", vocalisation_level="medium", alcohol_level="low", travel_mixing_level="medium",
                mitigation_level="low", prevalence=0.02, reproduction_number=1.2, attendance_probability_if_infectious=0.7,
                dispersion_k=0.2, regional_expected_transmissions=100.0)
    return {**base, **changes}


def test_event_risk(spark):
    safe = dict(indoor=False, crowding_level="low", ventilation_level="good", vocalisation_level="low", mitigation_level="high")
    rows = [event(event_id="default"), event(event_id="safe", **safe),
            event(event_id="risky", crowding_level="high", ventilation_level="poor", vocalisation_level="high", duration_hours=9.0),
            event(event_id="zero", reproduction_number=0.0), event(event_id="bad", prevalence=1.5), event(event_id="odd", crowding_level="?")]
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'string'}"
                       for k, v in event().items())
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = {r["event_id"]: r for r in events.event_moments(df).collect()}
    assert got["default"]["transmission_amplification_factor"] == pytest.approx(2.718281828459045**1.55)
    assert got["safe"]["transmission_amplification_factor"] == pytest.approx(2.718281828459045**-1.35)
    assert got["risky"]["expected_secondary_infections"] > got["safe"]["expected_secondary_infections"]
    assert got["default"]["expected_secondary_infections"] == pytest.approx(14 * 1.2 * 2.718281828459045**1.55)
    assert got["zero"]["secondary_infections_p95"] == 0 and got["zero"]["expected_secondary_infections"] == 0
    for r in got.values():
        if r["status"] == "ok":
            assert r["secondary_infections_p05"] <= r["secondary_infections_p50"] <= r["secondary_infections_p95"]
            assert r["risk_band"] in {"low", "moderate", "high", "very high"}
    assert got["bad"]["status"] == "error" and got["bad"]["risk_band"] is None
    assert "indoor, vocalisation, crowding" in got["default"]["explanation"]
    again = {r["event_id"]: r["p_superspreading"] for r in events.event_moments(df.repartition(3)).collect()}
    assert all(again[k] == got[k]["p_superspreading"] for k in got)


def test_spine_from_files(spark, tmp_path):
    write(tmp_path / "a.csv", "date,metric,metric_value,geography\n2024-01-01,m1,1,England\n2024-01-01,m1,9,England\n2024-01-02,m1,2,Wales\n2024-01-03,m1,3,England\n")
    write(tmp_path / "b.csv", "SevenDayEnding;RNA\n20240102;5\n20240104;7\n")
    write(tmp_path / "t.txt", "Date Value\n2024-01-01 3.5\n")
    sources = (tables.SpineSource("calls", str(tmp_path / "a.csv"), "date", "metric_value", series_column="metric", filters={"geography": "England", "sex": "all"}),
               tables.SpineSource("rna", str(tmp_path / "b.csv"), "SevenDayEnding", "RNA", output_name="rna", date_layout="yyyyMMdd", read_options={"sep": ";"}))
    spine = pipelines.seasonal_spine(spark, sources, "2024-01-01", "2024-01-31", str(tmp_path / "t.txt"), ("2024-01-01", "2024-01-03"))
    got = {r["date"]: r for r in spine.collect()}
    assert sorted(got) == [D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 3)]
    assert got[D(2024, 1, 1)]["calls__m1"] == 1.0 and got[D(2024, 1, 2)]["rna"] == 5.0 and got[D(2024, 1, 1)]["temp"] == 3.5


def test_site_features(spark, tmp_path):
    rows = [("c", "p", "s", D(2024, 1, 1) + dt.timedelta(weeks=i), 10.0 ** (i % 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "country string, pathogen string, site_id string, date date, value double")
    out = pipelines.site_features(df, str(tmp_path / "long"))
    assert out["coverage"].first()["n_observations"] == 10 and out["latest"].count() == 1 and out["rows"].count() == 10


def test_checksums(spark, tmp_path):
    import hashlib
    write(tmp_path / "x.csv", "hello")
    found = files.checksums(spark, str(tmp_path))
    assert found.first()["sha256"] == hashlib.sha256(b"hello").hexdigest()
    want = spark.createDataFrame([("x.csv",), ("y.csv",)], "filename string")
    assert {r["filename"]: r["status"] for r in files.transfer_status(want, found).collect()} == {"x.csv": "ok", "y.csv": "missing"}


def test_national_rows(spark):
    from epitide.operators.clean import national_rows
    df = spark.createDataFrame([("20240107.0", "1,5"), ("20240108", "x"), ("bad", "3")], "SevenDayEnding string, `Wastewater RNA` string")
    with pytest.raises(ValueError):
        national_rows(df, "Scotland", "cov", "s.csv")
    out = national_rows(df.withColumnRenamed("Wastewater RNA", "WastewaterRNA"), "Scotland", "cov", "s.csv").collect()
    assert [(r["date"], r["value"], r["week"]) for r in out] == [(D(2024, 1, 7), 15.0, D(2024, 1, 1))]


def test_source_counts(spark):
    df = spark.createDataFrame([("a", "x", "n", "csv"), ("a", "x", "n", "csv"), ("b", "x", "n", "zip")],
                               "country string, pathogen_scope string, level string, format string")
    assert {r["country"]: r["n_sources"] for r in files.source_counts(df).collect()} == {"a": 2, "b": 1}


def test_day_first_preamble_and_broken_files(spark, tmp_path):
    write(tmp_path / "a.csv", "about\n" * 40 + "date;value\n05/12/2023;1\n25/12/2023;2\n26/12/2023;3\n")
    write(tmp_path / "b.csv", "date,value\n" + "2024-01-01,1\n" * 6000 + "2024-01-02," + "x" * 200_000 + "\n")
    rows = cells.read_rows(spark, str(tmp_path), header_marks=("date",))
    columns = cells.file_columns(rows)
    choice = profile.date_choice(columns, ("date",), 3, cells.FILE).join(profile.value_choice(columns, profile.CHART_VALUES, cells.FILE), cells.FILE)
    got = sorted((str(r["date"]), r["value"]) for r in cells.observations(rows, choice).collect())
    assert got == [("2023-12-05", 1.0), ("2023-12-25", 2.0), ("2023-12-26", 3.0)]
    assert rows.where("error IS NOT NULL").count() == 1


def test_lines_equal_to_the_header_are_data(spark, tmp_path):
    write(tmp_path / "p.csv", "about\n" * 30 + "time,v\n2024-01-01,1\ntime,v\nabout,2\n")
    got = [tuple(r) for r in tables.read_with_preamble(spark, str(tmp_path / "p.csv")).collect()]
    assert sorted(got) == [("2024-01-01", "1"), ("about", "2"), ("time", "v")]
    write(tmp_path / "w.txt", "a b\n1 2\na b\n")
    assert sorted(tuple(r) for r in tables.read_words(spark, str(tmp_path / "w.txt")).collect()) == [("1", "2"), ("a", "b")]


def test_links_with_dots_and_references(spark):
    page = ("<a href='../data/x.csv'><a href='./y.csv'><a href='/a/./b/../z.csv?q=../k'><a href='caf&eacute;&#x26;&#38;&amp;lt;.csv'><a href='../../../top.csv'>")
    df = spark.createDataFrame([("https://h.org/p/q/page.html", page)], "url string, html string")
    assert {r["link"] for r in links.extract_links(df).collect()} == {
        "https://h.org/p/data/x.csv", "https://h.org/p/q/y.csv", "https://h.org/a/z.csv?q=../k", "https://h.org/p/q/caf\u00e9&&&lt;.csv", "https://h.org/top.csv"}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), None)], "a double, b int")
    assert runs.missing_fraction(df, ["a", "b"]).first()[0] == 0.5


def test_a_run_that_is_repeated_replaces_itself(spark, tmp_path):
    def land(run, factor, n=5):
        raw = spark.createDataFrame([(D(2026, 1, 4) + dt.timedelta(weeks=i), factor * i) for i in range(n)], "date date, cases double")
        runs.ingest(raw, {"name": "a", "pathogen": "rsv", "role": "predicted"}, str(tmp_path), run)

    land("r1", 1.0)
    land("r2", 2.0)
    land("r2", 3.0, 4)
    rows = runs.read_signals(spark, str(tmp_path))
    assert {(r["run_id"], r["n"], r["v"]) for r in rows.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("value").alias("v")).collect()} == {
        ("r1", 5, 10.0), ("r2", 4, 18.0)}
    assert sorted((r["run_id"], r["rows"]) for r in runs.manifests(spark, str(tmp_path)).collect()) == [("r1", 5), ("r2", 4)]
    table, manifest = runs.read_feature_table(spark, str(tmp_path), "a")
    assert table.count() == 4 and manifest["run_id"] == "r2" and {"source", "run_id"} <= set(table.columns)


def test_pointers_without_manifest(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "features" / "own.parquet"))
    write(tmp_path / "latest" / "own.json", json.dumps({"feature_set": "own", "run_id": "r1", "path": "features/own.parquet"}))
    write(tmp_path / "latest" / "lost.json", json.dumps({"feature_set": "lost", "latest_run_id": "r2", "manifest_path": "manifests/lost/r2.json"}))
    table, manifest = runs.read_pointer(spark, str(tmp_path), "own")
    assert table.count() == 3 and manifest["run_id"] == "r1"
    for name in ("lost", "absent"):
        with pytest.raises(FileNotFoundError):
            runs.read_pointer(spark, str(tmp_path), name)
    write(tmp_path / "manifests" / "lost" / "r2.json", json.dumps({"feature_set": "lost", "run_id": "r2", "path": "features/own.parquet"}))
    assert runs.read_pointer(spark, str(tmp_path), "lost")[1]["run_id"] == "r2"


def test_nested_tables_and_equal_names(spark, tmp_path):
    weeks = [D(2024, 1, 7) + dt.timedelta(weeks=i) for i in range(4)]

    def body(k):
        return "sample_date,viral_load\n" + "".join(f"{w},{i * k}\n" for i, w in enumerate(weeks))

    for k, name in enumerate(("belg/x.csv", "belg/sub/x.csv", "belg/sub/deep/y.tsv", "belg.csv", "other/belg/x.csv", "belg/notes.txt"), 1):
        write(tmp_path / "raw" / name, body(k).replace(",", "\t") if name.endswith("tsv") else body(k))
    with zipfile.ZipFile(tmp_path / "raw" / "belg.zip", "w") as z:
        z.writestr("in/x.csv", body(9))
    (tmp_path / "raw" / "torn.zip").write_bytes(b"PK nothing")
    catalogue = spark.createDataFrame([("Belgium", "rsv", "site", "belg.zip"), ("Lost", "", "", "absent.csv"), ("Torn", "", "", "torn.zip")],
                                      "country string, pathogen_scope string, level string, filename string")
    root = str(tmp_path / "raw")
    rows = cells.read_rows(spark, root, suffixes=(".csv", ".tsv", ".json", ".zip"))
    got = cells.raw_series(rows, catalogue, tables.qualified(spark, root)).groupBy("series_name").agg(F.sum("value").alias("v")).collect()
    assert {r["series_name"]: r["v"] for r in got} == {f"Belgium / rsv / site / {name} / viral_load": 6.0 * k for name, k in (
        ("belg/x.csv", 1), ("belg/sub/x.csv", 2), ("belg/sub/deep/y.tsv", 3), ("belg.zip:in/x.csv", 9))}
    found = {(r["source_file"], r["member"]): r for r in files.source_schemas(spark, catalogue, root).collect()}
    assert found["belg.zip", "in/x.csv"]["n_rows"] == 4 and found["belg.zip", "in/x.csv"]["columns"] == ["sample_date", "viral_load"]
    assert not found["absent.csv", ""]["exists"] and "BadZipFile" in found["torn.zip", ""]["error"]


def test_broken_archives_are_error_rows(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("a.csv", "date,v\n2024-01-01,1\n")
        z.writestr("b.json", "{not json")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    lines = tables.read_zip_lines(spark, str(tmp_path))
    errors = {(r["path"].rsplit("/", 1)[1], r["member"]) for r in lines.where("error IS NOT NULL").collect()}
    assert errors == {("bad.zip", ""), ("good.zip", "b.json")}
    assert [(r["member"], r["n_lines"]) for r in tables.zip_members(lines).collect()] == [("a.csv", 2)]
    assert tables.zip_table(lines, "a.csv").first()["v"] == "1"
