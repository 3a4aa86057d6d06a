"""Corpus preparation: quality, near-duplicates, test-item passages, mixture, shards. Each stage works on what the one before kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epitide.llm.common import join_counted, keyed, table
from epitide.llm.decontaminate import decontaminate
from epitide.llm.minhash import near_duplicates
from epitide.llm.mixing import mix
from epitide.llm.quality import quality
from epitide.llm.shards import assign_shards, tree
from epitide.session import stage

SHARDS = 8


def without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of keyed() that no verdict (_row, kept) drops. Only the keys to drop are moved, as long as a count shows that they are few."""
    dropped = stage(verdicts.filter(~F.col("kept")).select(F.col("_row").alias("_dropped")), "dropped")
    return join_counted(docs, dropped, F.col("_row") == F.col("_dropped"), "left_anti").drop("_row")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go."""
    rows = keyed(docs)
    return without(rows, quality(rows, table(spark, sf_dir, "labels"), row_col="_row"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the smallest id (null ids last): five-word shingles, similarity 0.8 or more.

    Rows are compared one by one, whatever their ids: of equal rows one stays, and rows of one id are alike only if their texts are.
    """
    rows = keyed(docs)
    found = near_duplicates(rows, size=5, num=80, den=100, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    groups = stage(found.join(rows.select("_row", "doc_id"), "_row"), "near-groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"), F.count(F.lit(1)).alias("members"))
    first = stage(first.filter("members > 1").select("component_id", F.col("first._row").alias("stays")), "near-first")
    return without(rows, join_counted(groups, first, "component_id").select("_row", (F.col("_row") == F.col("stays")).alias("kept")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which passages of test items make up a twentieth or more go; the others keep their texts as they are."""
    rows = keyed(docs)
    found = decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col="_row")
    return without(rows, found.select(F.col("doc_id").alias("_row"), (~F.col("contaminated")).alias("kept")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are drawn with the probabilities that bring the sources to their target weights."""
    rows = keyed(docs)
    return without(rows, mix(rows, row_col="_row"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard."""
    return assign_shards(docs, tree(SHARDS))


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("sharding", sharding),
]

#: Fitted models and set similarities of a whole corpus are not SQL; tests/llm holds run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
