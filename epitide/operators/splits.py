"""Chronological splits and train-window scaling, per key and without collecting anything."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import train_scale
from .frames import ordered


def split_index(n: Column, train_fraction: float, min_test: int) -> Column:
    """Number of training rows out of n: floor(n*f), at least min_test left over, at least one kept."""
    share = F.least(F.floor(n * F.lit(float(train_fraction))), n - min_test)
    return F.greatest(F.lit(1), F.when(n <= min_test, n - 1).otherwise(share)).cast("long")


def chronological_split(df: DataFrame, keys: Sequence[str], order: str = "period", train_fraction: float = 0.8,
                        min_test: int = 4) -> DataFrame:
    """Adds n_rows, row_index (from 1) and split; groups of fewer than three rows get split NULL."""
    if not 0 < train_fraction < 1:
        raise ValueError("train_fraction must lie between 0 and 1")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return (df.withColumn("n_rows", n).withColumn("row_index", F.row_number().over(ordered(keys, [order])))
            .withColumn("split", F.when(F.col("n_rows") >= 3, F.when(
                F.col("row_index") <= split_index(F.col("n_rows"), train_fraction, min_test), "train").otherwise("test"))))


def three_way_split(df: DataFrame, keys: Sequence[str], order: str, valid_fraction: float = 0.1,
                    test_fraction: float = 0.2) -> DataFrame:
    """Train, validation and test blocks in time order; both held-out blocks have at least one row."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    test = F.greatest(F.lit(1), F.floor(F.col("n_rows") * F.lit(float(test_fraction))))
    valid = F.greatest(F.lit(1), F.floor(F.col("n_rows") * F.lit(float(valid_fraction))))
    train = F.col("n_rows") - test - valid
    return (df.withColumn("n_rows", n).withColumn("row_index", F.row_number().over(ordered(keys, [order])))
            .withColumn("split", F.when(train <= 0, F.lit(None)).when(F.col("row_index") <= train, "train")
                        .when(F.col("row_index") <= train + valid, "valid").otherwise("test")))


def block_split(df: DataFrame, keys: Sequence[str], order: str, train_to: float = 0.70,
                valid_to: float = 0.85) -> DataFrame:
    """Blocks cut at two fractions of the rows, truncated."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    i, total = F.col("row_index"), F.col("n_rows")
    return (df.withColumn("n_rows", n).withColumn("row_index", F.row_number().over(ordered(keys, [order])))
            .withColumn("split", F.when(i <= F.floor(total * F.lit(train_to)), "train")
                        .when(i <= F.floor(total * F.lit(valid_to)), "valid").otherwise("test")))


def purge_crossing_labels(df: DataFrame, keys: Sequence[str], order: str = "period",
                          window_end: str = "future_window_end") -> DataFrame:
    """Drop training rows whose label window reaches past the end of training."""
    train_end = F.max(F.when(F.col("split") == "train", F.col(order))).over(Window.partitionBy(*keys))
    return (df.withColumn("_train_end", train_end)
            .where((F.col("split") != "train") | (F.col(window_end) <= F.col("_train_end"))).drop("_train_end"))


def train_zscore(df: DataFrame, keys: Sequence[str], columns: Sequence[str], suffix: str = "_z",
                 population: bool = False) -> DataFrame:
    """z-scores by the mean and deviation of the training rows of each key."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop if population else F.stddev_samp
    added = []
    for c in columns:
        x = F.when(F.col("split") == "train", F.col(c))
        added.append(((F.col(c) - F.avg(x).over(w)) / train_scale(sd(x).over(w))).alias(c + suffix))
    return df.select("*", *added)
