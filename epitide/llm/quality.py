"""Quality: an interpolated modified Kneser-Ney model of characters, trained on trusted text, and quantiles by language as thresholds.

Symbols are UTF-16 code units, so that an n-gram of four is one 64-bit number whatever the script. Texts are dealt out in blocks of
bounded size. The different n-grams of a block, with their counts in trusted texts, are what is shuffled: added up by n-gram they
are the model, joined with its probabilities they return to their block, where the texts are scored. No table of the corpus is
held by a task or the driver.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.quantiles import exact_quantiles
from ..session import stage
from .common import join_counted, keyed, record, schema_of, texts

ORDER = 4
BITS = 16  # of a symbol
BASE = 1.0 / (1 << BITS)  # probability of a symbol of which nothing is known
BLOCK_BYTES = 64 << 20  # bounds the texts of a block; n-grams that most blocks share are sent once for each
HELD_GRAMS = 3_000_000  # a task hands over what it has counted once it holds so many n-grams
PIECE_BYTES = 1 << 20  # texts are sent to their block in compressed pieces of whole texts
CHUNK_UNITS = 1 << 20  # n-grams are made for so many symbols at a time
QUANTILE = 0.99  # of the trusted perplexities of a language, at which its threshold stands
POOL_ROWS = 30  # weight, in trusted rows, of the quantile over all languages in that of one
MODELS = 3  # 0 and 1 count the trusted rows of the other fold, so that a trusted row is judged by a model without it; 2 counts all
ROW = "doc_id bigint, row_key bigint, lang string, trusted boolean"


def with_block(docs: DataFrame) -> DataFrame:
    """The rows with their block: texts of one size class in a stretch of row keys.

    Sizes grow 16-fold from class to class and the stretches are as much shorter: distinct keys keep a block under 4 * BLOCK_BYTES or
    to one longer text. A block follows from the row alone, so that texts need not be written for it and a lost task finds it again.
    """
    bits = F.floor(F.log2(F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1))) / 4).cast("int") * 4 + 2
    stretch = F.greatest(F.lit(BLOCK_BYTES.bit_length() - 1) - bits, F.lit(0))
    return docs.withColumn("block", F.xxhash64(bits, F.expr("shiftright(row_key, 40)"), F.call_function("shiftright", F.expr(f"row_key & {(1 << 40) - 1}"), stretch)))


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of every text."""
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def symbols(raw: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts end to end, and where each text begins (one offset more than texts)."""
    units = [(t or b"").decode("utf-8", "replace").encode("utf-16-le") for t in raw]
    return np.frombuffer(b"".join(units), np.uint16), np.cumsum([0, *(len(u) // 2 for u in units)])


def gram_chunks(units: np.ndarray, offsets: np.ndarray):
    """(place, n-grams): for every symbol from this place on the number of the n-gram that ends there; places before a text read as 0."""
    for at in range(0, len(units), CHUNK_UNITS):
        lo, hi = max(0, at - ORDER + 1), min(at + CHUNK_UNITS, len(units))
        shifted = units[lo:hi].astype(np.int64)
        begins = offsets[(offsets >= lo) & (offsets < hi)] - lo
        number = shifted.copy()
        for k in range(1, ORDER):
            shifted = np.r_[np.int64(0), shifted[:-1]]
            shifted[begins] = 0
            number |= shifted << (BITS * k)
        yield at, number[at - lo:]


def packed(blocks: DataFrame) -> DataFrame:
    """block, rows: pieces of whole rows of a block as compressed Arrow streams, a third of what a shuffle would write for the rows."""
    schema = schema_of("block bigint, rows binary")
    fields = to_arrow_schema(schema)

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("block")))
            number, piece = pieces(batch)
            for lo, hi in runs(number, piece):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                    out.write_batch(batch.slice(lo, hi - lo))
                yield record(fields, [number[lo:lo + 1], pa.array([sink.getvalue().to_pybytes()], pa.binary())])
    return blocks.select("block", "fold", "doc_id", "row_key", "lang", "trusted", "text").mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Block of every row, and a number that changes about every PIECE_BYTES."""
    length = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64)
    return np.asarray(batch.column("block")), np.cumsum(length) // PIECE_BYTES


def runs(*numbers: np.ndarray) -> list[tuple[int, int]]:
    """Stretches in which none of the numbers changes."""
    if not len(numbers[0]):
        return []
    cuts = [0, *(np.flatnonzero(np.any([np.diff(n) != 0 for n in numbers], axis=0)) + 1).tolist(), len(numbers[0])]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def block_grams(blocks: DataFrame) -> DataFrame:
    """block, gram, n0, n1: the different n-grams of each block and how often they stand in trusted texts of either fold.

    A block has a row for each time a task hands it over.
    """
    schema = schema_of("block bigint, gram bigint, n0 bigint, n1 bigint")
    fields = to_arrow_schema(schema)

    def counted(found):
        for block, parts in found.items():
            grams, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
            grams, place = np.unique(grams, return_inverse=True)
            sums = [np.bincount(place, counts[:, k], len(grams)).astype(np.int64) for k in (0, 1)]
            yield record(fields, [np.full(len(grams), block), grams, *sums])

    def run(batches):
        found, held = {}, 0
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("block")))
            fold = np.where(np.asarray(batch.column("trusted").cast(pa.int8())) == 1, np.asarray(batch.column("fold")), 2)
            number, piece = pieces(batch)
            for lo, hi in runs(number, piece):
                units, offsets = symbols(raw_texts(batch.column("text").slice(lo, hi - lo)))
                for at, grams in gram_chunks(units, offsets):
                    of = fold[lo:hi][np.searchsorted(offsets, np.arange(at, at + len(grams)), side="right") - 1]
                    own, place = np.unique(grams, return_inverse=True)
                    found.setdefault(number[lo], []).append((own, np.stack([np.bincount(place, of == k, len(own)) for k in (0, 1)], 1).astype(np.int32)))
                    held += len(own)
                if held > HELD_GRAMS:
                    yield from counted(found)
                    found, held = {}, 0
        yield from counted(found)
    return stage(blocks.select("block", "text", "fold", "trusted").mapInArrow(run, schema), "quality-grams")


def gram_levels(grams: DataFrame) -> list[DataFrame]:
    """For each order, lowest first: gram, c0, c1, c2, its count in each model.

    N-grams of the highest order count by occurrence, those of each lower order by the different n-grams they end. N-grams that no
    trusted text has are there with counts of 0: they are what the documents ask for.
    """
    level = stage(grams.groupBy("gram").agg(F.sum("n1").alias("c0"), F.sum("n0").alias("c1")).withColumn("c2", F.col("c0") + F.col("c1")), "gram-counts")
    levels = [level]
    for order in range(ORDER - 1, 0, -1):
        level = stage(level.groupBy(suffix(order).alias("gram")).agg(*[F.count_if(F.col(f"c{m}") > 0).alias(f"c{m}") for m in range(MODELS)]), "gram-level")
        levels.insert(0, level)
    return levels


def suffix(order: int):
    return F.col("gram").bitwiseAND(F.lit((1 << (BITS * order)) - 1))


def discounts(level: DataFrame) -> list[list[float]]:
    """Three discounts for each model, from how many n-grams of the order have counts of one to four."""
    row = level.agg(*[F.count_if(F.col(f"c{m}") == k).alias(f"n{m}_{k}") for m in range(MODELS) for k in (1, 2, 3, 4)]).first()
    out = []
    for m in range(MODELS):
        n = [row[f"n{m}_{k}"] for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
        out.append([max(0.0, min(k, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 for k in (1, 2, 3)])
    return out


def log_probabilities(levels: list[DataFrame]) -> DataFrame:
    """gram, log0, log1, log2: log probability of the last symbol of every n-gram of the highest order in each model.

    Each order is joined with the sums of its contexts and with the probabilities of the order below.
    """
    every = range(MODELS)
    below = None
    for order, level in enumerate(levels, 1):
        cuts = [F.when(F.col(f"c{m}") >= 3, d[2]).when(F.col(f"c{m}") == 2, d[1]).when(F.col(f"c{m}") == 1, d[0]).otherwise(0.0)
                for m, d in enumerate(discounts(level))]
        rows = level.select("*", F.shiftrightunsigned("gram", BITS).alias("context"), *[cut.alias(f"cut{m}") for m, cut in enumerate(cuts)])
        contexts = rows.groupBy("context").agg(*[F.sum(f"{c}{m}").alias(f"{to}{m}") for m in every for c, to in (("c", "total"), ("cut", "freed"))])
        rows = rows.join(contexts, "context")
        if below is not None:
            rows = rows.join(below, suffix(order - 1) == F.col("lower")).drop("lower")
        p = [F.when(F.col(f"total{m}") > 0, (F.col(f"c{m}") - F.col(f"cut{m}")) / F.col(f"total{m}")
                    + F.col(f"freed{m}") / F.col(f"total{m}") * (F.col(f"p{m}") if below is not None else F.lit(BASE)))
             .otherwise(F.col(f"p{m}") if below is not None else F.lit(BASE)).alias(f"p{m}") for m in every]  # a context never seen leaves all to the order below
        below = rows.select(F.col("gram").alias("lower"), *p)
    return below.select(F.col("lower").alias("gram"), *[F.log(F.greatest(f"p{m}", F.lit(1e-12))).cast("float").alias(f"log{m}") for m in every])


def perplexities(blocks: DataFrame, grams: DataFrame) -> DataFrame:
    """doc_id, row_key, lang, trusted, perplexity (of a symbol; null for a text without any), unseen (of trusted rows, by the model without them)."""
    fields = to_arrow_schema(schema_of(f"{ROW}, perplexity double, unseen double"))

    def scores(own: pa.Table, gram: np.ndarray, logs: list[np.ndarray]) -> pa.RecordBatch:
        fold, trusted = own["fold"].to_numpy(), own["trusted"].cast(pa.int8()).to_numpy() == 1
        units, offsets = symbols(raw_texts(own["text"]))
        sums = np.zeros((2, own.num_rows))
        for at, numbers in gram_chunks(units, offsets):
            place = np.searchsorted(gram, numbers)
            row = np.searchsorted(offsets, np.arange(at, at + len(numbers)), side="right") - 1
            sums[0] += np.bincount(row, logs[MODELS - 1][place], own.num_rows)
            sums[1] += np.bincount(row, np.where(fold[row] == 0, logs[0][place], logs[1][place]), own.num_rows)
        length = np.diff(offsets)
        values = np.where(length > 0, np.round(np.exp(-sums / np.maximum(length, 1)), 6), np.nan)
        values[1][~trusted] = np.nan
        columns = [own[c].combine_chunks() for c in ("doc_id", "row_key", "lang", "trusted")]
        return record(fields, [*columns, *(pa.array(v, from_pandas=True) for v in values)])

    def score(sent: pa.Table, asked: pa.Table) -> pa.Table:
        gram, first = np.unique(asked["gram"].to_numpy(), return_index=True)
        logs = [asked[f"log{m}"].to_numpy()[first] for m in range(MODELS)]
        return pa.Table.from_batches([scores(pa.ipc.open_stream(piece.as_buffer()).read_all(), gram, logs) for piece in sent["rows"]], fields)

    asked = grams.select("block", "gram").join(log_probabilities(gram_levels(grams)), "gram")
    return stage(packed(blocks).groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(score, f"{ROW}, perplexity double, unseen double"), "perplexity")


def thresholds(trusted: DataFrame, quantile: float) -> tuple[DataFrame, float | None]:
    """lang_key, threshold; and the one over all languages. trusted: lang_key, unseen.

    The quantile of log perplexity in a language, which with few rows leans on the quantile over all languages, each row measured
    from the median of its own.
    """
    rows = trusted.select("lang_key", F.log("unseen").alias("log"))
    sizes = rows.groupBy("lang_key").agg(F.count(F.lit(1)).alias("rows"))
    own = stage(exact_quantiles(rows, ["lang_key"], "log", {"middle": 0.5, "own": quantile}).join(sizes, "lang_key"), "quality-quantiles")
    apart = join_counted(rows, own, "lang_key").select(F.explode(F.array(
        F.struct(F.lit("log").alias("kind"), F.col("log").alias("value")),
        F.struct(F.lit("apart").alias("kind"), (F.col("log") - F.col("middle")).alias("value")))).alias("r")).select("r.*")
    over = {r["kind"]: r["q"] for r in exact_quantiles(apart, ["kind"], "value", {"q": quantile}).collect()}  # two rows
    if not over:
        return own.select("lang_key", F.lit(None).cast("double").alias("threshold")), None
    lean = (F.col("rows") * F.col("own") + POOL_ROWS * (F.col("middle") + F.lit(over["apart"]))) / (F.col("rows") + POOL_ROWS)
    return own.select("lang_key", F.exp(lean).alias("threshold")), float(np.exp(over["log"]))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str = "lang", label_col: str = "quality", row_col: str | None = None) -> DataFrame:
    """Every row with its perplexity under a model of the trusted texts and whether it passes.

    Trusted are the rows whose label is 1; all of them are counted. Returns doc_id, lang, trusted, perplexity, threshold, kept. The
    threshold of a language is a quantile of the perplexities of its trusted rows, each by a model of the other half of the trusted
    rows: a text that a model has counted looks better to it than others as good. A language without trusted rows takes the
    quantile over all of them; with no trusted row at all everything with text is kept. Null languages form one language. Null
    and empty texts have no perplexity and are not kept. Ties with the threshold pass; repeated rows are judged alike; other columns are ignored,
    but a key of the rows, row_col (a distinct long, best one that rises along the files), is kept.
    """
    source = docs if row_col else keyed(docs)
    rows = texts(source, id_col, text_col, lang_col, row_col or "_row").withColumnRenamed(lang_col, "lang").withColumnRenamed(row_col or "_row", "row_key")
    known = labels.filter(F.col(f"`{label_col}`") == 1).select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).filter(
        "doc_id IS NOT NULL").distinct().withColumn("trusted", F.lit(True))
    marked = join_counted(rows, known, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    marked = marked.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int"))
    blocks = with_block(marked)
    scored = perplexities(blocks, block_grams(blocks)).withColumn("lang_key", F.coalesce("lang", F.lit("")))
    limits, every = thresholds(scored.filter("unseen IS NOT NULL").select("lang_key", "unseen"), quantile)
    judged = join_counted(scored, limits, "lang_key", "left").withColumn("threshold", F.coalesce("threshold", F.lit(every).cast("double")))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return judged.select(*([F.col("row_key").alias(row_col)] if row_col else []), "doc_id", "lang", "trusted", "perplexity", "threshold", kept.alias("kept"))
