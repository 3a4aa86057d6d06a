"""What the operators share: reading their columns, Arrow maps, joins that broadcast only a counted side."""
from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..operators.ranks import NUMBER, numbered
from ..session import stage

SMALL_ROWS = 2_000_000  # a side of at most so many short rows is broadcast, a larger one is shuffled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator needs, under its own names, so that others can't clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       *[F.col(f"`{c}`") for c in more])


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def arrow_map(frame: DataFrame, ddl: str, work) -> DataFrame:
    """work(batch) yields the columns of result batches; it must keep no more than a batch in memory."""
    schema = schema_of(ddl)
    fields = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for columns in work(batch):
                    yield record(fields, columns)
    return frame.mapInArrow(run, schema)


def arrow_fold(frame: DataFrame, ddl: str, start, add, finish) -> DataFrame:
    """One state for each task: start() makes it, add(state, batch) grows it, finish(state) yields columns."""
    schema = schema_of(ddl)
    fields = to_arrow_schema(schema)

    def run(batches):
        state = start()
        for batch in batches:
            if batch.num_rows:
                add(state, batch)
        for columns in finish(state):
            yield record(fields, columns)
    return frame.mapInArrow(run, schema)


def record(schema: pa.Schema, columns) -> pa.RecordBatch:
    """A record batch of the given columns in order."""
    arrays = [c if isinstance(c, pa.Array) and c.type == f.type else c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type)
              for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def is_small(frame: DataFrame, most: int = SMALL_ROWS) -> bool:
    return frame.limit(most + 1).count() <= most


def join_counted(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = SMALL_ROWS) -> DataFrame:
    """Joins with a side that is broadcast only if a count shows at most `most` rows; otherwise both are shuffled."""
    return left.join(F.broadcast(right) if is_small(right, most) else right, on, how)


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with _row, a key of each row: the number of its file and its place in it. Rows that are no Parquet files yet are written.

    A column _row that is there is replaced.
    """
    try:
        plain = docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation"  # above a join or an explode, a row of a file may repeat
        placed = docs.select("*", F.col("_metadata.file_path").alias("_keyed_file"), F.col("_metadata.row_index").alias("_keyed_at")) if plain else None
    except AnalysisException:
        placed = None
    if placed is None:
        return keyed(stage(docs, "keyed-rows"))
    files = stage(numbered(placed.select("_keyed_file").distinct(), F.col("_keyed_file")).withColumnRenamed(NUMBER, "_keyed_no"), "files")
    return join_counted(placed, files, "_keyed_file").withColumn("_row", F.shiftleft("_keyed_no", 40) + F.col("_keyed_at")).drop("_keyed_file", "_keyed_no", "_keyed_at")


class _Shared:
    """Gives the model; on its way to a task it leaves forget() behind."""

    def __init__(self, get):
        self.get = get

    def __call__(self):
        return self.get()

    def __reduce__(self):
        return _Shared, (self.get,)


def share(spark: SparkSession, thing):
    """Broadcasts a model together with its classes; the function that is returned gives it to a task, which unpacks it once.

    Its attribute forget() frees the copies on the executors, once what needs the model is written.
    """
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    held = []

    def get():
        if not held:
            held.append(pickle.loads(packed.value))
        return held[0]
    handle = _Shared(get)
    handle.forget = packed.unpersist
    return handle
