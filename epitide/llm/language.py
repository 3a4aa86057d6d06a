"""Language identification: blended-spectrum presence kernel, Nystroem landmarks, one-versus-rest kernel ridge regression."""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from ..session import stage
from .common import arrow_map, join_counted, share, texts

ORDERS = (1, 2, 3, 4)  # bytes of lower-cased text, blended
BITS = 14  # presence bits of all orders together
LANDMARKS = 24  # of each language
FIT_ROWS = 600  # rows of each language that the regression is fitted on, chosen by a hash of the id
RIDGE = 1e-3
BATCH_ROWS = 256
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # features x landmarks, columns divided by the root of their size
    weights: np.ndarray  # landmarks x languages


def presence(piece: T.Slice, lo: int, hi: int) -> np.ndarray:
    """0/1 matrix of the features of rows lo..hi of a slice."""
    part = T.Slice(lo, hi, piece.data[piece.offsets[lo]:piece.offsets[hi]], piece.offsets[lo:hi + 1] - piece.offsets[lo])
    out = np.zeros((hi - lo, 1 << BITS), np.float32)
    for n in ORDERS:
        packed, at = T.byte_grams(part, n)
        out[part.text_of(at), T.bucketed(packed, BITS, n)] = 1.0
    return out


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Shared features over the root of both sizes, for every row and landmark in one matrix product."""
    return (rows @ landmarks) / np.sqrt(np.maximum(rows.sum(axis=1), 1.0))[:, None]


def fit(train: DataFrame) -> Model:
    """train: doc_id, text, lang, none of them null. A bounded sample of each language is encoded in tasks and solved here."""
    counts = stage(train.groupBy("lang").count(), "language-counts")  # a row for each language: no text is shuffled
    rates = counts.select("lang", (F.lit(float(FIT_ROWS)) / F.col("count")).alias("rate"))
    chosen = join_counted(train, rates, "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)) < F.col("rate") * float(1 << 30))
    ddl = "lang string, features binary"

    def encode(batch):
        for piece in T.slices(batch.column("text")):
            for lo in range(0, piece.hi - piece.lo, BATCH_ROWS):
                hi = min(lo + BATCH_ROWS, piece.hi - piece.lo)
                bits = np.packbits(presence(piece, lo, hi).astype(bool), axis=1)
                yield (batch.column("lang").slice(piece.lo + lo, hi - lo), [b.tobytes() for b in bits])
    rows = sorted(((r["lang"], r["features"]) for r in arrow_map(chosen.select("lang", "text"), ddl, encode).toArrow().to_pylist()))
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)))
    x = np.unpackbits(np.array([np.frombuffer(f, np.uint8) for _, f in rows]), axis=1).astype(np.float32)
    of = np.array([languages.index(lang) for lang, _ in rows])
    picks = np.concatenate([own[np.linspace(0, len(own) - 1, min(LANDMARKS, len(own))).astype(int)]
                            for own in (np.flatnonzero(of == k) for k in range(len(languages)))])
    landmarks = x[picks].T / np.sqrt(np.maximum(x[picks].sum(axis=1), 1.0))
    values, vectors = np.linalg.eigh(kernel(x[picks], landmarks).astype(float))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6 * max(values.max(), 1e-6)))
    phi = kernel(x, landmarks) @ whiten
    y = (of[:, None] == np.arange(len(languages))).astype(float)
    even = 1 / np.bincount(of)[of]  # every language weighs the same
    gram = (phi * even[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1])
    return Model(languages, landmarks, whiten @ np.linalg.solve(gram, (phi * even[:, None]).T @ y))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    shared = share(docs.sparkSession, model)
    ddl = "doc_id bigint, lang_pred string, score double"

    def work(batch):
        model = shared()
        for piece in T.slices(batch.column("text")):
            for lo in range(0, piece.hi - piece.lo, BATCH_ROWS):
                hi = min(lo + BATCH_ROWS, piece.hi - piece.lo)
                at = piece.lo + lo
                lettered = np.array([t is not None and LETTER.search(t) is not None for t in batch.column("text").slice(at, hi - lo).to_pylist()])
                if model.languages:
                    values = kernel(presence(piece, lo, hi), model.landmarks) @ model.weights
                    best = values.argmax(axis=1)
                    top = np.clip(values[np.arange(hi - lo), best], 0.0, 1.0)
                else:
                    lettered, best, top = lettered & False, np.zeros(hi - lo, int), np.zeros(hi - lo)
                yield (batch.column("doc_id").slice(at, hi - lo), [model.languages[b] if k else UNKNOWN for b, k in zip(best, lettered, strict=True)],
                             np.round(np.where(lettered, top, 0.0), 6))
    return arrow_map(docs, ddl, work)


def identify_language(docs: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on the rows that `learn_from` (a condition on doc_id) admits and predicts every row.

    Returns doc_id, lang_pred, score. Null texts and texts without a letter are `und` with score 0; so is every row if nothing
    can be learned. Rows with a null text, language or id teach nothing. Ties go to the language that sorts first; repeated rows
    are predicted alike. An empty table gives no rows; other columns are ignored.
    """
    rows = texts(docs, id_col, text_col, lang_col)
    train = rows.withColumnRenamed(lang_col, "lang").filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & learn_from)
    return predict(rows.select("doc_id", "text"), fit(train))
