import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epitide.operators import clean, features, frames, metrics, profile, quantiles, ranks, reshape, rollup, splits
from epitide.operators.correlation import correlation_long
from epitide.schema import CANONICAL, PanelConfig

D = dt.date


def canonical(spark, rows):
    full = [(d, float(v), s, r, f"fam_{s}", f"Series {s.upper()}", f"{s}.csv") for d, v, s, r in rows]
    return spark.createDataFrame(full, CANONICAL)


@pytest.fixture(scope="module")
def two(spark):
    weeks = [D(2024, 1, 1), D(2024, 1, 8), D(2024, 1, 15)]
    return canonical(spark, [(d, i + 1, "a", "predictive") for i, d in enumerate(weeks)]
                     + [(d, i + 10, "b", "predicted") for i, d in enumerate(weeks[:2])])


def test_catalogue(two):
    rows = {r["series_id"]: r for r in rollup.series_catalogue(two).collect()}
    assert (rows["a"]["n_obs"], rows["a"]["date_min"], rows["a"]["date_max"]) == (3, D(2024, 1, 1), D(2024, 1, 15))
    assert rows["b"]["n_obs"] == 2


def test_upsert_adds_and_replaces(spark, two):
    new = canonical(spark, [(D(2024, 2, 1), 5, "c", "predictive")])
    assert rollup.upsert(two, new).count() == 6
    again = canonical(spark, [(D(2024, 2, 1), 5, "b", "predicted")])
    merged = rollup.upsert(two, again)
    assert merged.count() == 4 and merged.where("series_id = 'b'").first()["value"] == 5.0


def test_custom_series_drops_bad_rows(spark):
    df = spark.createDataFrame([("2024-02-01", 10.0), ("2024-02-08", None), ("not-a-date", 12.0), ("2024-02-15", 14.0)],
                               "When string, Cases double")
    out = clean.custom_series(df, "When", "Cases", "x", "X", "predictive")
    assert out.columns == CANONICAL.names and out.count() == 2
    with pytest.raises(ValueError):
        clean.custom_series(df, "When", "Cases", "x", "X", "bogus")


def test_describe_counts_missing(spark):
    df = spark.createDataFrame([(1.0, 1, "u"), (None, 2, "u"), (3.0, 3, None)], "x double, y int, t string")
    rows = {r["column"]: r for r in profile.describe(df).collect()}
    assert (rows["x"]["missing"], rows["y"]["missing"], rows["t"]["missing"]) == (1, 0, 1)
    assert rows["x"]["p50"] == 2.0 and rows["t"]["top"] == "u" and rows["t"]["freq"] == 2


def test_site_edge_cases(spark):
    rows = [("c", "p", "s1", D(2024, 1, 7), 0.0, 1), ("c", "p", "s1", D(2024, 1, 8), 10.0, 2), ("c", "p", "s1", D(2024, 1, 15), 1000.0, 3),
            ("c", "p", "flat", D(2024, 1, 1), 10.0, 4), ("c", "p", "flat", D(2024, 1, 8), 10.0, 5),
            ("c", "p", "one", D(2024, 1, 1), 10.0, 6), ("c", "p", None, D(2024, 1, 1), 10.0, 7), ("c", "p", None, D(2024, 1, 2), 100.0, 8),
            ("c", "p", "s1", None, 100.0, 9)]
    df = spark.createDataFrame(rows, "country string, pathogen string, site_id string, date date, value double, i int")
    z = clean.within_series_zscore(clean.add_log_signal(clean.add_time_features(df)))
    got = {r["i"]: r for r in z.collect()}
    assert got[1]["log10_value"] is None and got[1]["week"] == D(2024, 1, 1)
    assert got[4]["zscore_within_series"] is None and got[6]["zscore_within_series"] is None
    assert got[7]["zscore_within_series"] == pytest.approx(-np.sqrt(0.5))
    latest = clean.latest_signal_summary(z, tie="i").first()
    assert latest["sites"] == 3
    expected = np.median([got[9]["zscore_within_series"], got[8]["zscore_within_series"]])
    assert latest["median_latest_z"] == pytest.approx(expected)


@pytest.mark.parametrize("lookback_window", [2, 3, 7])
def test_chunked_windows_equal_plain_ones(spark, lookback_window):
    rng = np.random.default_rng(3)
    # one hot key, sparse chunks, ties, a missing key and missing dates
    n = 600
    keys = np.where(rng.random(n) < 0.6, "hot", rng.choice(["u", "v", None], n))
    days = [None if rng.random() < 0.05 else D(2024, 1, 1) + dt.timedelta(days=int(x)) for x in rng.exponential(40, n)]
    rows = [(k if k != "None" else None, d, float(i % 17), i) for i, (k, d) in enumerate(zip(keys, days))]
    df = spark.createDataFrame(rows, "k string, date date, v double, i int")
    args = dict(value="v", keys=["k"], window=lookback_window, order=["date", "i"])
    plain = clean.rolling_features(df, **args).orderBy("i").toPandas()
    cut = clean.rolling_features(df, **args, chunk=F.date_trunc("week", "date")).orderBy("i").toPandas()
    pd.testing.assert_frame_equal(plain, cut[plain.columns], rtol=1e-12)
    lags = clean.group_lags(df, ["v"], [1, 4], ["k"], ["date", "i"]).orderBy("i").toPandas()
    lags_cut = clean.group_lags(df, ["v"], [1, 4], ["k"], ["date", "i"], F.col("date")).orderBy("i").toPandas()
    pd.testing.assert_frame_equal(lags, lags_cut[lags.columns])


@pytest.fixture
def many_ranges(spark):
    """Range partitions stay as they are, however small."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}

    def split(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield split
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("n", [1, 7, 30])
def test_running_sums_over_ranges(spark, many_ranges, n):
    many_ranges(n)
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": rng.choice(["hot"] * 8 + ["a", None], 4000), "v": rng.permutation(4000) / 7, "w": rng.integers(0, 5, 4000)})
    df = spark.createDataFrame(pdf)
    ranged = ranks.in_ranges(df, ["k"], F.col("v"))
    assert ranged.where("k = 'hot'").select(ranks.RANGE).distinct().count() >= min(n, 10) // 2
    for order, ascending in ((F.col("v"), True), (F.col("v").desc(), False)):
        got = ranks.running_sums(df, ["k"], order, ["w"]).toPandas()
        want = pdf.sort_values("v", ascending=ascending)
        want["w_upto"] = want.groupby("k", dropna=False)["w"].cumsum()
        both = got.merge(want, on="v", suffixes=("", "_want"))
        assert len(both) == 4000 and (both["w_upto"] == both["w_upto_want"]).all()
    assert ranks.running_sums(df.limit(0), ["k"], F.col("v"), ["w"]).isEmpty()


@pytest.mark.parametrize("buckets", [1, 5, 40])
def test_exact_quantiles(spark, many_ranges, buckets):
    many_ranges(buckets)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": np.where(rng.random(3000) < 0.7, "hot", "cold"), "v": np.round(rng.normal(size=3000), 2)})
    pdf.loc[:20, "k"] = None
    pdf = pd.concat([pdf, pd.DataFrame({"k": ["single"], "v": [4.0]})])
    probs = {"q05": 0.05, "q50": 0.5, "q85": 0.85, "q100": 1.0}
    got = quantiles.exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", probs).toPandas()
    for _, row in got.iterrows():
        mine = pdf[pdf["k"].isna()] if row["k"] is None else pdf[pdf["k"] == row["k"]]
        for name, p in probs.items():
            assert row[name] == pytest.approx(mine["v"].quantile(p), abs=1e-12)
    assert len(got) == 4


def test_correlation_blocks(spark):
    rng = np.random.default_rng(7)
    n, ids = 400, [f"s{i}" for i in range(9)]
    wide = pd.DataFrame(rng.normal(size=(n, 9)), columns=ids)
    wide["s3"] = 5.0
    wide[rng.random((n, 9)) < 0.3] = np.nan
    wide["s8"] = np.nan
    wide.loc[0, "s8"] = 1.0
    long = wide.assign(period=[D(2020, 1, 1) + dt.timedelta(days=3 * i) for i in range(n)]).melt("period", var_name="series_id").dropna()
    got = correlation_long(spark.createDataFrame(long), block=4, span=100).toPandas()
    want = wide.corr(min_periods=2)
    both = wide.notna().astype(int)
    for row in got.itertuples():
        assert row.n_shared == (both[row.series_a] * both[row.series_b]).sum()
        expected = want.loc[row.series_a, row.series_b]
        assert (pd.isna(row.correlation) and pd.isna(expected)) or row.correlation == pytest.approx(expected, abs=1e-10)
    assert len(got) == sum(((both[a] * both[b]).sum() > 0) for i, a in enumerate(ids) for b in ids[i + 1:])


def test_split_sizes(spark):
    rows = [(k, D(2024, 1, 1) + dt.timedelta(days=i)) for k, n in (("a", 2), ("b", 4), ("c", 10), ("d", 100)) for i in range(n)]
    out = splits.chronological_split(spark.createDataFrame(rows, "k string, period date"), ["k"])
    n = {(r["k"], r["split"]): r["count"] for r in out.groupBy("k", "split").count().collect()}
    assert n == {("a", None): 2, ("b", "train"): 3, ("b", "test"): 1, ("c", "train"): 6, ("c", "test"): 4, ("d", "train"): 80, ("d", "test"): 20}


def test_classification_metrics_with_ties_and_one_class(spark):
    rows = [("m", 1, 0.9), ("m", 0, 0.9), ("m", 1, 0.4), ("m", 0, 0.2), ("o", 0, 0.3), ("o", 0, 0.7)]
    got = {r["k"]: r for r in metrics.classification_metrics(
        spark.createDataFrame(rows, "k string, y int, p double"), ["k"], "y", "p").collect()}
    m, o = got["m"], got["o"]
    assert m["precision"] == 0.5 and m["recall"] == 0.5 and m["f1"] == 0.5
    assert m["roc_auc"] == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert m["average_precision"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert m["brier"] == pytest.approx((0.01 + 0.81 + 0.36 + 0.04) / 4)
    assert o["roc_auc"] is None and o["average_precision"] is None and o["precision"] == 0.0


def test_lag_panel_uses_the_shared_grid(spark):
    weeks = [D(2024, 1, 1) + dt.timedelta(weeks=i) for i in range(6)]
    rows = [(w, i, "x", "predictive") for i, w in enumerate(weeks) if i != 2] + [(w, i, "y", "predicted") for i, w in enumerate(weeks)]
    got = features.lag_panel(canonical(spark, rows), PanelConfig(lags=(1,)))
    values = {r["period"]: r["value"] for r in got.collect()}
    assert values == {weeks[0]: None, weeks[1]: 0.0, weeks[2]: 1.0, weeks[3]: None, weeks[4]: 3.0, weeks[5]: 4.0}


def test_column_rules(spark):
    facts = spark.createDataFrame([(0, n, i, 10, d, v, False) for i, (n, d, v) in enumerate((
        ("week", 10, 0), ("region_id", 0, 10), ("viral_load", 0, 10), ("mean_copies", 0, 9), ("comment", 0, 0), ("year", 0, 10)))],
        "_table int, column string, position int, n_rows long, n_dates long, n_numbers long, day_first boolean")
    dates = profile.date_choice(facts, profile.CHART_DATES, 3, ["_table"])
    assert dates.first()["date_column"] == "week"
    assert profile.value_choice(facts, ("load",), ["_table"]).first()["value_column"] == "viral_load"
    assert profile.value_choice(facts, ("zzz",), ["_table"]).first()["value_column"] == "region_id"
    assert [r["value_column"] for r in profile.value_choices(facts, dates, 3, ["_table"]).collect()] == ["viral_load", "mean_copies"]
    assert profile.date_choice(facts.where("position > 0"), profile.CHART_DATES, 3, ["_table"]).isEmpty()
    assert profile.column_mapping(["date", "location", "new_cases"]) == {
        "date_column": "date", "geography_column": "location", "signal_columns": ["new_cases"]}
    assert profile.column_mapping(["date", "a", "b"], {"date_column": "zz", "signal_columns": ["b"]})["signal_columns"] == ["b"]
    assert profile.columns_like(["gp_calls", "calls_total", "x"], ["call"], ["gp"]) == ["calls_total"]


def test_feature_table_roles(spark):
    df = spark.createDataFrame([(D(2024, 1, 1) + dt.timedelta(weeks=i), float(i), i / 2) for i in range(4)],
                               "date date, target_rsv_admissions_t_plus_2 double, rsv_positivity_lag_1w double")
    out = reshape.feature_table_series(df, "rsv", "x.parquet")
    assert out.count() == 8 and {r["role"] for r in out.select("role").distinct().collect()} == {"predicted", "predictive"}


def test_stated_role_wins(spark):
    rows = [(D(2024, 1, 1) + dt.timedelta(weeks=i), float(i), "s", "rsv", "hospital_admissions", "admission_rate", "England", "E92") for i in range(3)]
    df = spark.createDataFrame(rows, "date date, value double, source string, pathogen string, signal_type string, metric string, "
                                     "geography_name string, geography_code string")
    assert {r["role"] for r in reshape.signal_series(df).collect()} == {"predicted"}
    assert {r["role"] for r in reshape.signal_series(df.withColumn("role", F.lit("predictive"))).collect()} == {"predictive"}


def test_distinct_values_are_sorted_without_null(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "name string")
    assert frames.distinct_values(df, "name") == ["a", "b"]


def test_positive_lags():
    assert frames.positive_lags((3, 1, 1)) == [1, 3]
    with pytest.raises(ValueError):
        frames.positive_lags((0, 1))


def test_one_date_order_for_a_column(spark):
    df = spark.createDataFrame([("05/12/2023", "05/12/2023", 1.0), ("25/12/2023", "12/25/2023", 2.0), ("26/12/2023", None, 3.0)], "a string, b string, v double")
    days = {c: [r[0] for r in clean.custom_series(df, c, "v", "s", "s", "predicted").orderBy("value").select("date").collect()] for c in ("a", "b")}
    assert days == {"a": [D(2023, 12, 5), D(2023, 12, 25), D(2023, 12, 26)], "b": [D(2023, 5, 12), D(2023, 12, 25)]}
    assert [r["date"] for r in clean.add_time_features(df, "a").orderBy("v").collect()] == days["a"]
    wide = reshape.normalized_signals(df.drop("b"), "s", "p", "predicted", {"date_column": "a", "geography_column": None, "signal_columns": ["v"]})
    assert [r["date"] for r in wide.orderBy("value").collect()] == days["a"]
    empty = clean.custom_series(df.limit(0), "a", "v", "s", "s", "predicted")
    assert empty.isEmpty()


def test_undated_rows_keep_their_order(spark):
    rows = [("k", D(2024, 1, d) if d else None, i, float(i)) for i, d in enumerate((1, 1, 2, 0, 0, 0))]
    df = spark.createDataFrame(rows, "country string, date date, event_id long, value double")
    chunk = F.struct(F.col("date").isNull().alias("undated"), "date", F.expr("event_id div 2").alias("part"))
    got = clean.group_lags(df, ["value"], [1, 3], ["country"], ["date", "event_id"], chunk)
    assert [(r["value_lag1"], r["value_lag3"]) for r in got.orderBy("event_id").collect()] == [
        (None, None), (0.0, None), (1.0, None), (2.0, 0.0), (3.0, 1.0), (4.0, 2.0)]


def test_signals_ranked_in_two_directions(spark):
    df = spark.createDataFrame([("a", "p2", 1.0), ("b", "p1", None), ("c", "p1", 2.0), ("d", "p1", 2.0), ("e", None, 1.0)], "country string, pathogen string, median_latest_z double")
    assert [(r["country"], r["place"]) for r in clean.ranked_signals(df).collect()] == [("c", 1), ("d", 2), ("b", 3), ("a", 1), ("e", 1)]


def test_commas_in_numbers_by_argument(spark):
    df = spark.createDataFrame([(D(2024, 1, d), f"{d},000", str(d)) for d in (1, 2, 3)], "date date, a string, b string")
    mapping = {"date_column": "date", "geography_column": None, "signal_columns": ["a", "b"]}
    for commas, names in ((False, {"b"}), (True, {"a", "b"})):
        rows = reshape.normalized_signals(df, "s", "p", "predicted", mapping, commas=commas)
        assert {r["signal_type"] for r in rows.collect()} == names
        series = reshape.feature_table_series(df, "s", "x", commas=commas)
        assert series.select("series_id").distinct().count() == len(names)
