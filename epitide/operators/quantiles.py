"""Exact linear-interpolation quantiles of groups of any size.

Spark's percentile() keeps every distinct value of a group in one task. Here values are counted first and dealt out in ranges, and
only the ranges that hold the wanted ranks are ordered.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import null_safe_join
from .ranks import RANGE, in_ranges, range_offsets, upto


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with one column per entry of probs (name -> probability)."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = in_ranges(counts, keys, F.col("_v"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("_n_all") - 1)).alias("pos")) for name, p in probs.items()])
    start, end = F.col("_n_before"), F.col("_n_before") + F.col("_n")
    hits = F.filter(wanted, lambda w: (F.ceil(w["pos"]) >= start) & (F.floor(w["pos"]) < end))
    ranges = range_offsets(ranged, keys, ["_n"]).withColumn("_wanted", hits).where(F.size("_wanted") > 0).select(*keys, RANGE, "_n_before", "_wanted")
    near = null_safe_join(ranged, ranges, [*keys, RANGE], "inner")
    near = (near.withColumn("_last", F.col("_n_before") + F.sum("_n").over(upto(keys, F.col("_v"))) - 1)
            .withColumn("_first", F.col("_last") - F.col("_n") + 1)
            .select(*keys, "_v", "_first", "_last", F.explode("_wanted").alias("_w")))
    low, high = F.floor(F.col("_w.pos")), F.ceil(F.col("_w.pos"))
    aggs = []
    for name in probs:
        mine = F.col("_w.name") == name
        v_low = F.max(F.when(mine & low.between(F.col("_first"), F.col("_last")), F.col("_v")))
        v_high = F.max(F.when(mine & high.between(F.col("_first"), F.col("_last")), F.col("_v")))
        part = F.max(F.when(mine, F.col("_w.pos") - low))
        aggs.append((v_low + part * (v_high - v_low)).alias(name))
    return near.groupBy(*keys).agg(*aggs)
