"""Row-based windows over raw rows, safe when one group holds most of the table.

A window partitioned by series puts a whole series into one task. After a weekly or monthly roll-up that is
fine: the calendar bounds the rows. On raw rows it is not, so the group is cut into time chunks and every
chunk is given the few rows that precede it (its halo). The halo is exact: it reaches back over as many
chunks as needed to hold `lookback` rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import null_safe_join, ordered

HALO = "_halo"
CHUNK = "_chunk"


def with_halo(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, lookback: int) -> DataFrame:
    """Rows plus, for every (keys, chunk), copies of the lookback rows before it, marked by _halo.

    chunk must not decrease along order within a group; NULL chunks count as the last one.
    """
    keys = list(keys)
    rows = df.withColumn(CHUNK, chunk)
    sizes = (rows.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_i", F.row_number().over(ordered(keys, [CHUNK])))
             .withColumn("_upto", F.sum("_n").over(ordered(keys, [CHUNK]).rowsBetween(Window.unboundedPreceding, 0))))
    backwards = Window.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).desc_nulls_first() for c in order])
    tails = rows.withColumn("_pos", F.row_number().over(backwards)).where(F.col("_pos") <= lookback)
    tails = (null_safe_join(tails, sizes, [*keys, CHUNK], "inner").drop(CHUNK)
             .withColumn("_i", F.explode(F.sequence(F.col("_i") + 1, F.col("_i") + lookback))))
    later = sizes.select(*keys, "_i", CHUNK, (F.col("_upto") - F.col("_n")).alias("_before"))
    halo = (null_safe_join(tails, later, [*keys, "_i"], "inner")
            .where(F.col("_pos") + F.col("_before") - F.col("_upto") <= lookback)
            .drop("_pos", "_n", "_i", "_upto", "_before"))
    return rows.withColumn(HALO, F.lit(False)).unionByName(halo.withColumn(HALO, F.lit(True)))


def over_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], lookback: int, features,
                chunk: Column | None = None) -> DataFrame:
    """Add the columns features(window) returns; with a chunk, no task sees more than one chunk of a group.

    features may look back at most `lookback` rows in total.
    """
    if chunk is None:
        return features(df, ordered(keys, order))
    wide = with_halo(df, keys, order, chunk, lookback)
    done = features(wide, ordered([*keys, CHUNK], order))
    return done.where(~F.col(HALO)).drop(HALO, CHUNK)
