"""Follows the folder of normalized runs and keeps the canonical series current.

sources.runs.ingest writes each run into a folder of its own, so a file stream sees every writing of a run once. Every micro-batch is
stored under its own batch id: a batch that is retried replaces itself. What is stored are signal rows with their run and the time of
their writing, not series: which writing counts is decided when the series are read, however runs fell into batches.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.reshape import signal_series
from ..schema import CANONICAL, SIGNALS

STORED = T.StructType([*SIGNALS.fields, T.StructField("run_id", T.StringType()), T.StructField("written_at", T.StringType())])


def follow_runs(spark: SparkSession, root: str, table: str, checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Starts a query that processes all run files present, then stops; start it again for later ones."""
    reader = spark.readStream.schema(STORED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (reader.parquet(f"{root}/normalized").writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def current_series(spark: SparkSession, table: str, minimum: int = 3) -> DataFrame:
    """The series of each source's newest run, as it was last written.

    A run that came in several batches is whole; of two runs in one batch the newer counts, an old run that comes late does not.
    """
    rows = spark.read.schema(T.StructType([*STORED.fields, T.StructField("batch_id", T.LongType())])).parquet(table)
    newest = rows.groupBy("source").agg(F.max(F.struct("run_id", "written_at")).alias("_n")).select(
        "source", F.col("_n.run_id").alias("run_id"), F.col("_n.written_at").alias("written_at"))
    kept = rows.join(newest, ["source", "run_id", "written_at"], "left_semi").drop("batch_id", "written_at")
    return signal_series(kept, minimum).select(*CANONICAL.names)
