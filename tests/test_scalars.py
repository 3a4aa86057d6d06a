import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from epitide.functions import scalars as S
from epitide.functions.numeric import normal_quantile, normal_sf


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'date' if isinstance(v, dt.date) else 'string'}"
        for k, v in values.items()))
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("1,234.5", 1234.5), (" 7 ", 7.0), ("1e3", 1000.0), ("", None), ("x", None), ("1.0d", None), ("NaN", None), ("12*", None)])
def test_to_number(spark, text, expected):
    assert one(spark, S.to_number("a"), a=text) == expected


def test_to_count_drops_suppression_marks(spark):
    assert one(spark, S.to_count("a"), a="1,2*") == 12.0
    assert one(spark, S.to_count("a"), a="*") is None


@pytest.mark.parametrize("text,expected", [
    ("2024-02-01", dt.date(2024, 2, 1)), ("2024-02-01 10:11:12", dt.date(2024, 2, 1)), ("01-Oct-18", dt.date(2018, 10, 1)),
    ("2024/02/03", dt.date(2024, 2, 3)), ("02/03/2024", dt.date(2024, 2, 3)), ("not-a-date", None), ("20240201", None),
    ("2024", None), ("2024-13-01", None)])
def test_to_day(spark, text, expected):
    assert one(spark, S.to_day("a"), a=text) == expected


@pytest.mark.parametrize("text,day_first,expected", [
    ("25/12/2023", False, dt.date(2023, 12, 25)), ("05/12/2023", False, dt.date(2023, 5, 12)), ("05/12/2023", True, dt.date(2023, 12, 5)),
    ("2021-07", False, dt.date(2021, 7, 1)), ("1 January 2024", False, dt.date(2024, 1, 1)), ("Jan 2024", False, dt.date(2024, 1, 1)),
    ("January 2024", False, dt.date(2024, 1, 1)), ("05.12.2023", False, dt.date(2023, 12, 5)), ("Mar 4, 2024", False, dt.date(2024, 3, 4)), ("31/31/2024", True, None)])
def test_other_layouts(spark, text, day_first, expected):
    assert one(spark, S.to_day("a", day_first=day_first), a=text) == expected


def test_compact_dates(spark):
    assert one(spark, S.from_yyyymmdd("a"), a="20240201.0") == dt.date(2024, 2, 1)
    assert one(spark, S.from_yyyymmdd("a"), a="99999999") is None


@pytest.mark.parametrize("year,expected", [(2020, dt.date(2020, 1, 1)), (-10000, None), (999999999, None), (0, None)])
def test_year_start(spark, year, expected):
    assert one(spark, S.year_start("a"), a=year) == expected


def test_weeks_start_on_monday(spark):
    assert one(spark, S.period("a", "W"), a=dt.date(2024, 1, 7)) == dt.date(2024, 1, 1)
    assert one(spark, S.period("a", "W"), a=dt.date(2024, 1, 8)) == dt.date(2024, 1, 8)
    assert one(spark, S.period("a", "M"), a=dt.date(2024, 1, 31)) == dt.date(2024, 1, 1)


def test_bands(spark):
    cuts = [(0.0, "none"), (0.1, "borderline"), (0.25, "mild"), (1.0, "moderate"), (2.0, "severe")]
    assert [one(spark, S.severity_band("a"), a=s) for s, _ in cuts] == [b for _, b in cuts]
    assert one(spark, S.risk_band(F.lit(0.01), "a"), a=6.0) == "moderate"
    assert one(spark, S.missing_status("a"), a=0.6) == "failed"
    assert one(spark, S.missing_status("a"), a=0.2) == "warning"
    assert one(spark, S.missing_status("a"), a=0.0) == "passed"


def test_normal_tail(spark):
    for z in (-3.0, 0.0, 1.5, 6.0):
        assert one(spark, normal_sf("a"), a=z) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-12)
    assert normal_quantile(0.9) == pytest.approx(1.2815515655446004)


def test_names(spark):
    assert S.header_name("  Total (A) % ") == "total_a"
    assert one(spark, S.safe_token("a"), a=" A--b ") == "a_b"
    assert one(spark, S.safe_token("a"), a="--") == "unknown"
    assert one(spark, S.term_label("a"), a="/x/time_series_GB_20250630-1431 (1).csv") == "20250630 1431 (1)"
