"""Removal of long byte strings that occur more than once in a corpus, over a content-defined parse of every text.

A rolling hash triggers a phrase: of the hashes in a stretch of SPAN positions the least one is the trigger, so where a text is cut
depends on nothing but the bytes there, and no stretch goes without. Strings of the asked length fall into classes by the phrase that
their trigger begins; the classes of all texts form the dictionary. Classes that occur once are settled, as are ranges of strings whose
whole surroundings occur twice. The rest, which lies at the edges of repeated passages, is cut finer and counted again.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import textops as T
from .common import arrow_map, join_counted

LENGTH = 200  # bytes
GRAM = 12  # bytes under the rolling hash
SPAN = 128  # positions that share a trigger at most
STEPS = (16, 1)  # ranges of strings that are counted after those of SPAN
PIECE_BYTES = 1 << 20  # that are parsed at a time
ROWS = 1_000  # surroundings that are hashed at a time
SMALL_DOCS = 200_000  # documents whose short lists of ranges are broadcast; more are joined by a shuffle

#: A range of k strings from byte `start` on: what all of them share, what they cover together, and how far before their trigger.
LEVEL = "phrase bigint, cover bigint, doc bigint, start int, k int, ahead int"


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For every stretch of `width` entries the place of its least one, the first of equals."""
    best, place, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        later = best[step:] < best[:-step]
        place = np.where(later, place[step:], place[:-step])
        best = np.where(later, best[step:], best[:-step])
        size += step
    return place


def parsed(piece: T.Slice, length: int, span: int) -> Iterator[tuple[np.ndarray, ...]]:
    """row, start, k, ahead, phrase, cover of every range of strings with a common trigger."""
    if len(piece.data) < length:
        return
    prefix = T.prefix_hash(piece.data)
    at = np.arange(len(piece.data) - GRAM + 1)
    hashes = (T.span_hash(prefix, at, at + GRAM) >> np.uint64(32)).astype(np.uint32)
    trigger = least_places(hashes, span)
    inside = np.ones(len(piece.data) - length + 1, bool)
    for cut in piece.offsets[1:-1].tolist():
        inside[max(0, cut - length + 1):cut] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return
    of = trigger[starts]
    first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (starts[1:] != starts[:-1] + 1)])
    low, high, of = starts[first], starts[np.r_[first[1:] - 1, len(starts) - 1]], of[first]
    row = piece.text_of(low)
    cover = T.span_hash(prefix, low, high + length) ^ T.mix((of - low).astype(np.uint64))
    yield row, low - piece.offsets[row], high - low + 1, of - low, T.span_hash(prefix, of, of + length - span + 1), cover


def pieces(piece: T.Slice, length: int) -> Iterator[tuple[T.Slice, int]]:
    """A slice as it is, or one long text in parts that overlap, each with the place where it begins."""
    if piece.hi - piece.lo > 1 or len(piece.data) <= PIECE_BYTES + length:
        yield piece, 0
        return
    for begin in range(0, len(piece.data) - length + 1, PIECE_BYTES):
        part = piece.data[begin:begin + PIECE_BYTES + length - 1]
        yield T.Slice(piece.lo, piece.hi, part, np.array([0, len(part)])), begin


def first_level(rows: DataFrame, length: int, span: int) -> DataFrame:
    def work(batch):
        doc = np.asarray(batch.column("doc"))
        for whole in T.slices(batch.column("text"), PIECE_BYTES):
            for piece, begin in pieces(whole, length):
                for row, start, k, ahead, phrase, cover in parsed(piece, length, span):
                    yield T.signed(phrase), T.signed(cover), doc[piece.lo + row], (start + begin).astype(np.int32), k.astype(np.int32), ahead.astype(np.int32)
    return arrow_map(rows, LEVEL, work)


def cut_finer(context: np.ndarray, k: np.ndarray, ahead: np.ndarray, length: int, step: int):
    """Ranges of at most `step` strings out of each row's k strings: row, first string, strings, distance, phrase, cover.

    context has the bytes from the first string of a row on. Ranges end where the distance to the trigger is a multiple of `step`,
    so equal strings fall into ranges alike.
    """
    powers, inverses = T.POWERS.tables(context.shape[1] + 1)
    prefix = np.zeros((len(context), context.shape[1] + 1), np.uint64)
    np.cumsum(T.BYTE_CODES[context] * powers[:context.shape[1]], axis=1, out=prefix[:, 1:])
    farthest, nearest = ahead // step, (ahead - k + 1) // step
    n = farthest - nearest + 1
    row = np.repeat(np.arange(len(k)), n)
    q = np.repeat(farthest, n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    first = np.maximum(0, ahead[row] - step * q - step + 1)
    last = np.minimum(k[row] - 1, ahead[row] - step * q)
    core = ahead[row] - step * q  # the nearest string's trigger distance; all of the range hold what begins there

    def hashed(begin, end):
        return T.mix((prefix[row, end] - prefix[row, begin]) * inverses[begin])
    phrase = hashed(core, core + length - step + 1)
    cover = hashed(first, last + length) ^ T.mix((ahead[row] - first - step * q).astype(np.uint64) + np.uint64(1))
    return row, first, last - first + 1, ahead[row] - first, phrase, cover


def finer_level(rows: DataFrame, open_ranges: DataFrame, length: int, step: int) -> DataFrame:
    """The open ranges cut into ranges of `step` strings, from the texts they lie in."""
    lists = open_ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "k", "ahead")).alias("ranges"))
    joined = join_counted(rows.drop("doc_id"), stage(lists, "repeat-ranges"), "doc", most=SMALL_DOCS)

    def work(batch):
        doc = np.asarray(batch.column("doc"))
        lists = batch.column("ranges")
        bounds = np.asarray(lists.offsets)
        values = lists.values
        start, k, ahead = (np.asarray(values.field(f)).astype(np.int64) for f in ("start", "k", "ahead"))
        for piece in T.slices(batch.column("text")):
            n = np.diff(bounds[piece.lo:piece.hi + 1])
            own = slice(bounds[piece.lo], bounds[piece.hi])
            of = np.repeat(np.arange(piece.hi - piece.lo), n)
            begin = piece.offsets[of] + start[own]
            for lo in range(0, len(of), ROWS):
                part = slice(lo, lo + ROWS)
                o, s, c, a = of[part], start[own][part], k[own][part], ahead[own][part]
                at = begin[part][:, None] + np.arange(int(c.max()) + length - 1)
                context = piece.data[np.minimum(at, len(piece.data) - 1)]
                row, first, count, distance, phrase, cover = cut_finer(context, c, a, length, step)
                yield (T.signed(phrase), T.signed(cover), doc[piece.lo + o[row]], (s[row] + first).astype(np.int32), count.astype(np.int32), distance.astype(np.int32))
    return arrow_map(joined, LEVEL, work)


def settled(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges all of whose strings occur again, and ranges that have to be cut finer.

    A phrase that occurs once has no repeated string. A cover that occurs twice has nothing else. What is left is open, and with it
    one range of each repeated cover of the same phrase, since an open string may equal one of those.
    """
    level = stage(level, "repeat-level")
    phrases = stage(level.groupBy("phrase").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("phrase"), "repeat-phrases")
    twice = stage(level.join(phrases, "phrase"), "repeat-twice")
    covers = stage(twice.groupBy("phrase", "cover", "k", "ahead").agg(
        F.count(F.lit(1)).alias("times"), F.min("doc").alias("doc"), F.min_by("start", "doc").alias("start")), "repeat-covers")
    repeated = twice.join(covers.filter("times > 1").select("phrase", "cover"), ["phrase", "cover"], "left_semi")
    unsure = stage(covers.filter("times = 1").select("phrase").distinct(), "repeat-unsure")
    return (repeated.select("doc", "start", "k"),
            covers.join(unsure, "phrase", "left_semi").select("doc", "start", "k", "ahead"))


def merged(ranges: DataFrame, length: int) -> DataFrame:
    """doc, bounds: begin and end of every maximal run of covered bytes, in order."""
    lists = ranges.groupBy("doc").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("k") + (length - 1)).alias("end"))).alias("spans"))

    def work(batch):
        spans = batch.column("spans")
        bounds = np.asarray(spans.offsets)
        begins, ends = (np.asarray(spans.values.field(f)) for f in ("start", "end"))
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            order = np.argsort(begins[a:b], kind="stable")
            begin, reach = begins[a:b][order], np.maximum.accumulate(ends[a:b][order])
            new = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
            out.append(np.stack([begin[new], reach[np.r_[new[1:] - 1, len(reach) - 1]]], axis=1).reshape(-1).tolist())
        yield batch.column("doc"), out
    return arrow_map(lists, "doc bigint, bounds array<int>", work)


def repeated_spans(rows: DataFrame, length: int = LENGTH, span: int = SPAN, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """rows: doc, text. doc, bounds of every text with bytes that a repeated string of `length` bytes covers."""
    repeated, unsure = settled(first_level(rows, length, span))
    for step in steps:
        more, unsure = settled(finer_level(rows, unsure, length, step))
        repeated = repeated.unionByName(more)
    return merged(repeated, length)


def drop_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the bytes covered by strings of `length` UTF-8 bytes that begin anywhere else too, in the same text or another.

    Returns doc_id, n_bytes, n_removed, spans (begin and end of the maximal removed runs, in bytes), kept (the other bytes). All
    strings are judged on the input and none crosses texts. Null texts count as empty; texts shorter than `length` lose nothing.
    Rows with equal texts, and repeated rows, repeat each other. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # a row is known by its id and text together: ids may be missing or repeat
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col(f"`{id_col}`").cast("long"), text).alias("doc"))
    spans = stage(repeated_spans(rows, length), "repeat-spans")
    ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<begin: int, end: int>>, kept binary"

    def work(batch):
        bounds = batch.column("bounds")
        for piece in T.slices(batch.column("text")):
            removed, spans, kept = [], [], []
            for row, own in enumerate(bounds.slice(piece.lo, piece.hi - piece.lo).to_pylist()):
                data = piece.data[piece.offsets[row]:piece.offsets[row + 1]]
                cuts = list(zip((own or [])[::2], (own or [])[1::2], strict=True))
                edges = [0, *(own or []), len(data)]
                kept.append(b"".join(data[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"begin": a, "end": b} for a, b in cuts])
                removed.append(sum(b - a for a, b in cuts))
            yield batch.column("doc_id").slice(piece.lo, piece.hi - piece.lo), np.diff(piece.offsets), removed, spans, kept
    return arrow_map(join_counted(rows, spans, "doc", "left", SMALL_DOCS), ddl, work)
