"""Sharding by a hierarchical weighted hash tree. DataFrame functions only."""
from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import texts

CHUNK_ROWS = 5_000  # rows that are numbered together
REGION_SHARDS, RACK_SHARDS = 4, 2


def tree(shards: int, grown: int = 0) -> dict[int, tuple[str, str, float]]:
    """Shard -> region, rack, weight. Shards that are added later stand in regions of their own, so no other weight changes."""
    first = {s: (f"r{s // REGION_SHARDS}", f"r{s // REGION_SHARDS}/k{s % REGION_SHARDS // RACK_SHARDS}", 1.0) for s in range(shards)}
    return first | {s: (f"g{s}", f"g{s}/k0", 1.0) for s in range(shards, shards + grown)}


def children(nodes: dict[int, tuple[str, str, float]]) -> list[dict[str, dict[str, float]]]:
    """For each level: parent -> child -> weight, a parent weighing what its shards weigh. Weightless nodes are left out."""
    levels = [defaultdict(lambda: defaultdict(float)) for _ in range(3)]
    for shard, (region, rack, weight) in sorted(nodes.items()):
        if weight > 0:
            for level, (parent, child) in zip(levels, (("", region), (region, rack), (rack, str(shard))), strict=True):
                level[parent][child] += weight
    return levels


def uniform(*parts: Column) -> Column:
    """A number within (0, 1) decided by the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def descend(key: Column, nodes: dict[int, tuple[str, str, float]]) -> Column:
    """The shard of a key. At each level every child draws ln(u) / weight and the largest draw wins.

    A child's draw depends on nothing but the key, its own name and weight: when a weight grows keys move only into that
    subtree, when it shrinks only out of it.
    """
    at = F.lit("")
    for level in children(nodes):
        below = F.create_map(*[x for parent, kids in level.items() for x in (F.lit(parent), F.array(
            *[F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight")) for name, weight in kids.items()]))])
        draws = F.transform(F.element_at(below, at), lambda c: F.struct(
            (F.ln(uniform(key, c["name"])) / c["weight"]).alias("draw"), c["name"].alias("name")))
        at = F.array_max(draws)["name"]
    return at.cast("int")


def numbered(placed: DataFrame, order: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds slot: 0, 1, ... within each shard without a gap.

    A shard is numbered in chunks of counted size, each offset by the rows of the chunks before it, so no task sorts a shard.
    """
    shards = max(1, placed.select("shard").distinct().count())
    chunks = max(1, -(-placed.count() // (shards * chunk_rows)))
    rows = placed.withColumn("_chunk", F.pmod(F.xxhash64(F.col(order[0]), F.lit("slot")), F.lit(chunks)))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "_chunk").count().select(
        "shard", "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_chunk").orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(within)).join(stage(offsets, "shard-offsets"), ["shard", "_chunk"]).withColumn(
        "slot", F.col("_before") + F.col("_rank") - 1).drop("_chunk", "_rank", "_before")


def assign_shards(docs: DataFrame, nodes: dict, id_col: str = "doc_id", to: str = "shard") -> DataFrame:
    """All columns and the shard. Nothing is shuffled: a row's shard follows from its id and the tree."""
    return docs.withColumn(to, descend(F.col(f"`{id_col}`").cast("long"), nodes))


def shard_documents(docs: DataFrame, nodes: dict, grown: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its shard, its slot there and the shard it would have in the grown tree.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot, grown_shard (null without a grown tree). Null texts have
    no bytes and the checksum 0 of the empty text. Equal ids share a shard, so do rows without id; ties in a shard are
    ordered by id, checksum and size. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    placed = stage(texts(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        descend(F.col("doc_id"), nodes).alias("shard"),
        (descend(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard")), "shards")
    return numbered(placed, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")
