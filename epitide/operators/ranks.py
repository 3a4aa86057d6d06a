"""Running sums, and so ranks, in groups of any size: a prefix sum over ranges.

A window over a group puts the group into one task. Here rows are dealt out by ranges of (group, value), whose bounds Spark samples, so a
large group is spread over many tasks; each range adds up its rows, the sums of the ranges before it are its offset, and only rows
of one range are ordered together.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .frames import null_safe_join

RANGE = "_range"


def in_ranges(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Rows with the number of their range, which rises along the order of each group; written, so that the numbers stay.

    The rows of a group with one value stay in one range: count equal values first.
    """
    rows = stage(rows, "range-rows")  # the bounds are sampled from what is written
    return stage(rows.repartitionByRange(*keys, order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def range_offsets(ranged: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, range) with the sums of each name in the range, before it (<name>_before) and in the whole group (<name>_all)."""
    group = Window.partitionBy(*keys)
    before = group.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, RANGE).agg(*[F.sum(n).alias(n) for n in names])  # a group has no more rows here than there are ranges
    return sums.select("*", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in names],
                       *[F.sum(n).over(group).alias(f"{n}_all") for n in names])


def upto(keys: Sequence[str], order: Column) -> Window:
    """Rows of one range of a group up to the present one."""
    return Window.partitionBy(*keys, RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def running_sums(rows: DataFrame, keys: Sequence[str], order: Column, names: Sequence[str]) -> DataFrame:
    """Adds <name>_upto for each name: its sum over the rows of the group up to the present one. Equal orders within a group must not occur."""
    ranged = in_ranges(rows, keys, order)
    offsets = range_offsets(ranged, keys, names).drop(*names, *[f"{n}_all" for n in names])
    joined = null_safe_join(ranged, offsets, [*keys, RANGE], "inner")
    sums = [(F.col(f"{n}_before") + F.sum(n).over(upto(keys, order))).alias(f"{n}_upto") for n in names]
    return joined.select(*rows.columns, *sums)


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, n_upto): how often each value stands in a group, and how many values are not above it."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return running_sums(counts, keys, F.col(value), ["n"])


NUMBER = "_no"


def numbered(rows: DataFrame, order: Column) -> DataFrame:
    """Rows with their place, from 1, in an order without ties; no task sees more than a range of them."""
    placed = running_sums(rows.withColumn("_one", F.lit(1).cast("long")), [], order, ["_one"])
    return placed.drop("_one").withColumnRenamed("_one_upto", NUMBER)


def fan_out(rows: DataFrame, places: DataFrame, upto: Column) -> DataFrame:
    """Every row with the numbered places from 1 to its count: as many rows as come out are made, and both sides meet on the number."""
    wide = rows.withColumn(NUMBER, F.explode(F.when(upto >= 1, F.sequence(F.lit(1).cast("long"), upto.cast("long")))))
    return wide.join(places, NUMBER).drop(NUMBER)
