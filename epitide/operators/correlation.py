"""Pairwise-complete correlation of many series without emitting a row per pair and period.

Values are packed into small dense blocks (a run of series on a run of periods). Blocks that share periods
meet, and a pair of blocks gives all its products in one matrix multiplication, so what is shuffled is one
matrix per block pair instead of one row per pair of observations.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .frames import replicated, salted

PRODUCTS = ("n", "sa", "sb", "saa", "sbb", "sab")


def _multiply(batches):
    """Sums over the shared periods for every pair of columns of two blocks."""
    for pdf in batches:
        out = {name: [] for name in ("ra", "rb", "width", *PRODUCTS)}
        for row in pdf.itertuples(index=False):
            ka, kb = int(row.ka), int(row.kb)
            a = np.zeros((int(row.span), ka))
            b = np.zeros((int(row.span), kb))
            ma, mb = np.zeros_like(a), np.zeros_like(b)
            a[row.ta, row.ca], ma[row.ta, row.ca] = row.va, 1.0
            b[row.tb, row.cb], mb[row.tb, row.cb] = row.vb, 1.0
            out["ra"].append(row.ra)
            out["rb"].append(row.rb)
            out["width"].append(kb)
            for name, left, right in (("n", ma, mb), ("sa", a, mb), ("sb", ma, b), ("saa", a * a, mb),
                                      ("sbb", ma, b * b), ("sab", a, b)):
                out[name].append((left.T @ right).ravel())
        yield pd.DataFrame(out)


def correlation_long(rolled: DataFrame, block: int = 64, span: int = 256, salts: int = 16) -> DataFrame:
    """(series_a, series_b, n_shared, correlation) for series_a < series_b, from rows (series_id, period, value).

    block series by span periods make one dense block, so the work of a task is bounded by the two settings.
    """
    # ids are numbered within hash buckets and the buckets' sizes added up, so no task ranks all of them
    ids = rolled.select("series_id").distinct().withColumn("_h", F.pmod(F.xxhash64("series_id"), F.lit(4096)))
    w = Window.partitionBy("_h").orderBy("series_id")
    sizes = ids.groupBy("_h").agg(F.count(F.lit(1)).alias("_c"))
    starts = sizes.withColumn("_start", F.sum("_c").over(
        Window.partitionBy(F.lit(0)).orderBy("_h").rowsBetween(Window.unboundedPreceding, -1))).select("_h", F.coalesce("_start", F.lit(0)).alias("_start"))
    numbered = stage(ids.withColumn("_k", F.row_number().over(w) - 1).join(starts, "_h").select(
        "series_id", (F.col("_k") + F.col("_start")).alias("_i")), "series-numbers")
    mean = rolled.groupBy("series_id").agg(F.avg("value").alias("_mean"))
    day = F.datediff("period", F.lit("1970-01-01").cast("date"))
    cells = (rolled.join(numbered, "series_id").join(mean, "series_id")
             .select(F.floor(F.col("_i") / block).alias("r"), (F.col("_i") % block).cast("int").alias("c"),
                     F.floor(day / span).alias("q"), F.pmod(day, F.lit(span)).cast("int").alias("t"),
                     (F.col("value") - F.col("_mean")).alias("v")))
    packed = stage(cells.groupBy("r", "q").agg(
        F.collect_list("t").alias("t"), F.collect_list("c").alias("c"), F.collect_list("v").alias("v")), "series-blocks")
    a = packed.select(F.col("r").alias("ra"), "q", F.col("t").alias("ta"), F.col("c").alias("ca"), F.col("v").alias("va"))
    b = packed.select(F.col("r").alias("rb"), "q", F.col("t").alias("tb"), F.col("c").alias("cb"), F.col("v").alias("vb"))
    met = salted(a, "ra", salts).join(replicated(b, salts), ["q", "_salt"]).where(F.col("ra") <= F.col("rb")).select(
        "*", F.lit(block).alias("ka"), F.lit(block).alias("kb"), F.lit(span).alias("span"))
    arrays = ", ".join(f"{p} array<double>" for p in PRODUCTS)
    sums = met.mapInPandas(_multiply, f"ra long, rb long, width long, {arrays}")
    cellwise = sums.select("ra", "rb", "width", F.posexplode(F.arrays_zip(*PRODUCTS)).alias("pos", "m")).where(
        F.col("m.n") > 0)
    totals = cellwise.groupBy(
        (F.col("ra") * block + F.floor(F.col("pos") / F.col("width"))).alias("ia"),
        (F.col("rb") * block + F.col("pos") % F.col("width")).alias("ib"),
    ).agg(*[F.sum(f"m.{p}").alias(p) for p in PRODUCTS]).where(F.col("ia") < F.col("ib"))
    n = F.col("n")
    va, vb = F.col("saa") - F.col("sa") ** 2 / n, F.col("sbb") - F.col("sb") ** 2 / n
    flat = 1e-12
    corr = F.when((n > 1) & (va > flat * F.col("saa")) & (vb > flat * F.col("sbb")),
                  (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt(va * vb))
    name_a = numbered.select(F.col("_i").alias("ia"), F.col("series_id").alias("one"))
    name_b = numbered.select(F.col("_i").alias("ib"), F.col("series_id").alias("two"))
    return totals.select("ia", "ib", n.cast("long").alias("n_shared"), corr.alias("correlation")).join(
        name_a, "ia").join(name_b, "ib").select(
        F.least("one", "two").alias("series_a"), F.greatest("one", "two").alias("series_b"), "n_shared", "correlation")
