"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import arrow_fold, arrow_map, join_counted, share, texts

GRAMS = (5, 8)  # bytes of lower-cased text
BITS = 19  # features
SMOOTHING = 20.0  # rows that every feature counts as seen besides, dealt to the classes as these are
LEAST_RATIO = 1.0  # features with a smaller log-count ratio, in absolute terms, carry no weight
FIT_ROWS = 3_000  # labelled rows of each class that the linear weights are fitted on; the ratios count all of them
STEPS, RATE, DECAY = 150, 0.1, 1e-4
THRESHOLD = 0.3

COUNTS = "feature int, positive bigint, negative bigint"


@dataclass
class Model:
    weights: np.ndarray  # one for each feature, ratio included
    bias: float


def present(piece: T.Slice, carries: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every feature present in a text, once each, ordered by row; only those that `carries` marks."""
    keys = []
    for n in GRAMS:
        packed, at = T.byte_grams(piece, n)
        feature = T.bucketed(packed, BITS, n)
        if carries is not None:
            chosen = np.flatnonzero(carries[feature])
            feature, at = feature[chosen], at[chosen]
        keys.append((piece.text_of(at) << BITS) | feature)
    both = np.unique(np.concatenate(keys))
    return both >> BITS, both & ((1 << BITS) - 1)


def log_count_ratios(train: DataFrame) -> tuple[np.ndarray, int, int]:
    """Ratio of every feature from how many toxic and other rows have it, and the rows of each kind, over all rows."""
    size = 1 << BITS

    def add(state, batch):
        label = np.asarray(batch.column("label"))
        for piece in T.slices(batch.column("text")):
            row, feature = present(piece)
            toxic = label[piece.lo:piece.hi][row] == 1
            state[0] += np.bincount(feature[toxic], minlength=size)
            state[1] += np.bincount(feature[~toxic], minlength=size)

    def finish(state):
        seen = np.flatnonzero(state.any(axis=0))
        yield (seen.astype(np.int32), state[0][seen], state[1][seen])
    folded = arrow_fold(train, COUNTS, lambda: np.zeros((2, size), np.int64), add, finish)
    sums = folded.groupBy("feature").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative")).toArrow()
    rows = train.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") != 1)).first()
    positive, negative = np.zeros(size), np.zeros(size)
    positive[sums["feature"]], negative[sums["feature"]] = sums["positive"], sums["negative"]
    share = (rows[0] + 1) / (rows[0] + rows[1] + 2)
    ratios = np.log((positive + SMOOTHING * share) / (negative + SMOOTHING * (1 - share)) * (1 - share) / share)
    return np.where(np.abs(ratios) >= LEAST_RATIO, ratios, 0.0), rows[0], rows[1]


def fit(train: DataFrame) -> Model:
    """train: doc_id, text, label (1 toxic, 0 not). No rows of either kind give a model that scores everything 0."""
    ratios, n_positive, n_negative = log_count_ratios(train)
    if not n_positive or not n_negative:
        return Model(np.zeros(1 << BITS, np.float32), -30.0 if not n_positive else 30.0)
    carries = ratios != 0
    share = F.when(F.col("label") == 1, FIT_ROWS / n_positive).otherwise(FIT_ROWS / n_negative)
    chosen = train.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < share * float(1 << 30))
    ddl = "label int, features binary"

    def encode(batch):
        label = np.asarray(batch.column("label"))
        for piece in T.slices(batch.column("text")):
            row, feature = present(piece, carries)
            first = np.searchsorted(row, np.arange(piece.hi - piece.lo + 1))
            yield (label[piece.lo:piece.hi].astype(np.int32),
                         [feature[a:b].astype(np.int32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)])
    rows = sorted(arrow_map(chosen, ddl, encode).toArrow().to_pylist(), key=lambda r: (r["label"], r["features"]))
    y = np.array([r["label"] for r in rows], float)
    lists = [np.frombuffer(r["features"], np.int32) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
    used, column = np.unique(np.concatenate(lists), return_inverse=True)
    x = ratios[used][column]
    importance = np.where(y == 1, n_positive / max(1, y.sum()), n_negative / max(1, (1 - y).sum()))
    importance /= importance.sum()
    w, bias = np.zeros(len(used)), float(np.log(n_positive / n_negative))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):  # full-batch Adam on the weighted logistic loss
        z = bias + np.bincount(row, weights=w[column] * x, minlength=len(rows))
        error = importance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        gradient = np.r_[np.bincount(column, weights=error[row] * x, minlength=len(used)) + DECAY * w, error.sum()]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w * ratios[used]
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every whole text."""
    shared = share(docs.sparkSession, model)
    ddl = "doc_id bigint, score double, predicted int"

    def work(batch):
        model = shared()
        carries = model.weights != 0
        for piece in T.slices(batch.column("text")):
            row, feature = present(piece, carries)
            z = model.bias + np.bincount(row, weights=model.weights[feature], minlength=piece.hi - piece.lo)
            p = np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 9)
            yield (batch.column("doc_id").slice(piece.lo, piece.hi - piece.lo), p, (p >= threshold).astype(np.int32))
    return arrow_map(docs, ddl, work)


def held_out(doc_id="doc_id"):
    """The fold that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             threshold: float = THRESHOLD) -> DataFrame:
    """Fits on the labelled rows outside the held-out fold and scores every row.

    Returns doc_id, score (0 to 1), predicted. Null and empty texts have no features and score as the bias alone. Rows without a
    label or id teach nothing; several labels of an id count as toxic if one does. Repeated rows are scored alike. Without labels
    of both kinds every row gets the one score that is known (0 if there are no labels). Other columns are ignored.
    """
    rows = texts(docs, id_col, text_col)
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    train = join_counted(rows.filter(~held_out()), known, "doc_id")
    return score(rows, fit(train), threshold)
