"""Small helpers shared by the operators."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def positive_lags(lags: Iterable[int]) -> list[int]:
    """Sorted, de-duplicated lags; anything below one would leak the period itself."""
    clean = sorted({int(k) for k in lags})
    if not clean or clean[0] <= 0:
        raise ValueError("lags must be strictly positive, e.g. 1,2,3,4")
    return clean


def lag_text(lags: Iterable[int]) -> str:
    return ",".join(str(int(k)) for k in lags)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                   keep: Sequence[str] | None = None) -> DataFrame:
    """Equi-join in which NULL keys match each other; right columns other than the keys are added."""
    added = [c for c in (keep or right.columns) if c not in keys]
    slim = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *added)
    on = None
    for k in keys:
        test = left[k].eqNullSafe(slim[f"__r_{k}"])
        on = test if on is None else on & test
    return left.join(slim, on, how).drop(*[f"__r_{k}" for k in keys])


def ordered(keys: Sequence[str], order: Sequence[str | Column]) -> Window:
    """Window over one group in time order, missing dates last."""
    return Window.partitionBy(*keys).orderBy(
        *[(F.col(c) if isinstance(c, str) else c).asc_nulls_last() for c in order])


def column_day(df: DataFrame, column: str, layout: str | None = None) -> Column:
    """Dates of a column of any type. Text has one order of day and month for the whole column.

    One value that can only have its day first decides for all; this is asked in a scalar subquery, an aggregate of the one column.
    """
    if dict(df.dtypes)[column] in ("date", "timestamp", "timestamp_ntz"):
        return F.col(f"`{column}`").cast("date")
    if layout:
        return S.to_day(F.col(f"`{column}`"), layout)
    order = df.select(F.col(f"`{column}`").alias("_text")).agg(F.coalesce(F.max(S.only_day_first("_text")), F.lit(False))).scalar()
    return S.to_day(F.col(f"`{column}`"), day_first=order)


def distinct_values(df: DataFrame, column: str) -> list:
    """Sorted distinct values, for the columns of a pivot."""
    return sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def salted(df: DataFrame, key: str, salts: int) -> DataFrame:
    """Tag rows with a salt derived from key, so that one side of a join spreads over salts tasks per key."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))


def replicated(df: DataFrame, salts: int) -> DataFrame:
    """One copy of each row per salt: the partner of salted()."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
