"""Exact dedup over an extendible-hash index kept as shared files. DataFrame functions only."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import run_folder, stage
from .common import join_counted, texts

BUCKET_ENTRIES = 16_384  # a bucket with more is split by doubling the directory
MOST_DEPTH = 40  # bits of the hash a directory may use; beyond it entries stay in their bucket
PLACE = ["depth", "bucket", "hash"]


def slot(depth: int):
    """The first `depth` bits of the hash: the place in a directory of 2**depth slots."""
    return F.shiftrightunsigned("hash", 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, bucket_entries: int = BUCKET_ENTRIES) -> tuple[int, DataFrame]:
    """entries: one row for each hash. Global depth and, for each slot in use, the depth and number of the bucket it points to.

    The directory doubles until no slot is overfull; then slots that fit together share the bucket of their common prefix.
    """
    depth = max(0, math.ceil(math.log2(max(1, entries.count()) / bucket_entries)))
    while depth < MOST_DEPTH:
        overfull = entries.groupBy(slot(depth).alias("slot")).count().filter(F.col("count") > bucket_entries)
        if overfull.isEmpty():
            break
        depth += 1
    slots = entries.groupBy(slot(depth).alias("slot")).count()
    prefixes = slots.select("slot", "count", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftright(slot, {depth} - depth)"))
    fits = prefixes.groupBy("depth", "prefix").agg(F.sum("count").alias("filled"), F.collect_set("slot").alias("slots")).filter(
        (F.col("filled") <= bucket_entries) | (F.col("depth") == depth))
    return depth, fits.select(F.explode("slots").alias("slot"), "depth").groupBy("slot").agg(
        F.min("depth").alias("depth")).withColumn("bucket", F.expr(f"shiftright(slot, {depth} - depth)"))


def routed(rows: DataFrame, bucket_entries: int = BUCKET_ENTRIES, hash_bits: int = 64) -> DataFrame:
    """Rows with their hash and the bucket (depth, number) that the directory sends it to."""
    hashed = rows.withColumn("hash", F.shiftleft(F.xxhash64("text"), 64 - hash_bits))
    hashes = stage(hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")), "exact-hashes")
    depth, slots = directory(hashes, bucket_entries)
    slots = stage(slots, "exact-directory")
    return join_counted(hashed.withColumn("slot", slot(depth)), slots, "slot").drop("slot")


def build_index(located: DataFrame) -> DataFrame:
    """Writes the index: within its bucket, the texts of a hash are told apart by their bytes and chained; returns it as read back.

    Copies are combined before the shuffle, so a group of any size is one row a task; each task of the last step owns a range of
    buckets. `chained` is the length of the chain, `link` the place in it.
    """
    entries = located.groupBy("depth", "bucket", "hash", "text").agg(
        F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    small = stage(entries.select("depth", "bucket", "hash", F.sha2("text", 256).alias("text_sha256"), "group_size", "keep_id"), "exact-entries")
    chain = Window.partitionBy(*PLACE)
    path = run_folder(located.sparkSession, "exact-index")
    # the bits of a bucket's prefix, moved to the front, order buckets of all depths as their hashes are ordered
    front = F.expr("shiftleft(bucket, 63 - depth)")
    small.withColumns({"chained": F.count(F.lit(1)).over(chain), "link": F.row_number().over(chain.orderBy("text_sha256"))}).withColumn(
        "front", front).repartitionByRange("front").sortWithinPartitions("front", "hash", "link").drop("front").write.parquet(path)
    return located.sparkSession.read.parquet(path)


def look_up(located: DataFrame, index: DataFrame) -> DataFrame:
    """Every row with its entry: by bucket and hash, and by the bytes of the text where the chain has more than one."""
    alone = index.filter(F.col("chained") == 1)
    found = located.select("doc_id", *PLACE).join(alone, PLACE)
    crowded = stage(index.filter(F.col("chained") > 1), "exact-chains")
    if crowded.isEmpty():
        return found
    rows = join_counted(located, crowded.select(*PLACE).distinct(), PLACE, "left_semi")
    heads = rows.select(*PLACE, "text").distinct().withColumn("text_sha256", F.sha2("text", 256))
    chains = heads.join(crowded, [*PLACE, "text_sha256"])
    return found.unionByName(rows.join(chains, [*PLACE, "text"]).select(*found.columns))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = BUCKET_ENTRIES,
                hash_bits: int = 64) -> DataFrame:
    """Every row with the row that stays of its group of equal texts.

    Returns doc_id, keep_id (largest doc_id of the group), group_size, kept, text_sha256, hash, link, depth, bucket.
    Null texts count as empty. Rows without doc_id never stay unless no row of the group has one; then they all stay.
    Repeated rows of the staying doc_id all stay. An empty table gives no rows; other columns are ignored. Fewer `hash_bits`
    only make collisions likelier: the result is the same.
    """
    rows = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    located = routed(rows, bucket_entries, hash_bits)
    return look_up(located, build_index(located)).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
        "hash", "link", "depth", "bucket")
