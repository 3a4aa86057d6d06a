"""Periodic runs of words: segments are split at words too rare to join a run, what survives is scanned lag by lag."""
from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import arrow_map, texts
from .textops import NOT_SPACE, Slice, slices, words

LEAST = 12  # words of a run, besides two periods
GRAM = 6  # words that are compared at once; the fewest that a run has beyond its first period are 6


def coded_words(piece: Slice) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """First word of each text (one entry more), a number for each word, and the words by number. Numbers are equal where bytes are."""
    begin, end = words(piece, NOT_SPACE)
    bounds = np.searchsorted(begin, piece.offsets)
    edges = np.empty(2 * len(begin), np.int64)
    edges[::2], edges[1::2] = begin, end  # every other string is the gap behind a word
    coded = pa.LargeStringArray.from_buffers(max(0, len(edges) - 1), pa.py_buffer(edges if len(edges) else np.zeros(1, np.int64)),
                                             pa.py_buffer(np.ascontiguousarray(piece.data))).dictionary_encode()
    return bounds, coded.indices.to_numpy()[::2].astype(np.int64), coded.dictionary


def surviving(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Segments (begin, end) in which every word occurs at least twice.

    A run is two periods long, so each of its words occurs twice in it: a word that occurs once in its segment is in no run and
    splits it. The parts are counted again until nothing splits; a part shorter than a run is left out.
    """
    at = np.arange(len(codes))
    segment = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    width = int(codes.max()) + 1 if len(codes) else 1
    while True:
        long = np.bincount(segment, minlength=1)[segment] >= least if len(segment) else np.zeros(0, bool)
        at, segment = at[long], segment[long]
        if not len(at):
            return []
        _, inverse, counts = np.unique(segment * width + codes[at], return_inverse=True, return_counts=True)
        often = counts[inverse] >= 2
        if often.all():
            cut = np.flatnonzero(np.diff(segment)) + 1
            return list(zip(at[np.concatenate([[0], cut])].tolist(), (at[np.concatenate([cut - 1, [len(at) - 1]])] + 1).tolist(), strict=True))
        at, segment = at[often], segment[often]
        segment = np.concatenate([[0], np.cumsum((np.diff(at) != 1) | (np.diff(segment) != 0))]) if len(at) else segment


def alike(w: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """How many words are equal in pairs from a and b onwards (step 1) or backwards (step -1), at most `most`."""
    done, size = 0, 32
    while done < most:
        size = min(size, most - done)
        if step > 0:
            differ = w[a + done:a + done + size] != w[b + done:b + done + size]
        else:
            differ = (w[a - done - size + 1:a - done + 1] != w[b - done - size + 1:b - done + 1])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done, size = done + size, size * 4
    return most


def lag_scan(w: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of the words w.

    A run of period q is a stretch of at least max(least, 2q) - q places whose word is that q places on. Some place in it that is a
    multiple of `step` has its next words in the stretch too, so only these places are compared, by the hash of GRAM words: about
    n log n comparisons over all lags. What is found is widened word by word. The places of a run at the multiples of its period are
    that same run, and are passed over.
    """
    n = len(w)
    if n < least:
        return []
    gram = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + w[k:n - GRAM + 1 + k].astype(np.uint64)
    found, known = [], defaultdict(list)  # lag -> places of runs with a period that divides it
    for q in range(1, n // 2 + 1):
        need = max(least, 2 * q) - q
        if n - q < need:
            break
        step = need - GRAM + 1
        hits = np.flatnonzero(gram[:len(gram) - q:step] == gram[q::step])
        passed = known.pop(q, ())
        for run in passed:  # on to the next multiple of its period
            start, length, period = run
            if length >= 2 * (q + period):
                known[q + period].append(run)
        if not len(hits):
            continue
        hits *= step
        for start, length, _ in passed:
            hits = hits[(hits < start) | (hits >= start + length - q)]
        i = 0
        while i < len(hits):
            place = int(hits[i])
            left = place - alike(w, place - 1, place - 1 + q, place, -1) if place else 0
            right = place + alike(w, place, place + q, n - q - place, 1)
            if right - left >= need:
                run = (left, right - left + q, q)
                found.append(run)
                if run[1] >= 4 * q:
                    known[2 * q].append(run)
            i += max(1, int(np.searchsorted(hits[i:], right)))
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_runs(docs: DataFrame, reread: Callable[[int | None, int], np.ndarray | None] | None = None, id_col: str = "doc_id",
                  text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Every row with its runs and its text without their repetitions.

    Words are runs of other than white space. A run is a maximal stretch of words with smallest period q (words q apart are equal) of at
    least max(least, 2q) words. Returns doc_id, runs (array of start, length, period by start, then period; in words from 0) and kept
    (the words, joined by one space, without those that stand in a run behind its first period). reread(doc_id, n), where given,
    says which of the n words stands at each place, or None for the text as it is.
    Null and empty texts have no runs and nothing kept. Repeated rows come back as often as they stand. A text is worked on in one
    task, in about n log n steps; nothing is shuffled. An empty table gives no rows; other columns are ignored.
    """
    if least < 2 * GRAM:
        raise ValueError(f"a run must have at least {2 * GRAM} words")

    def work(batch):
        ids = batch.column("doc_id").to_pylist() if reread else None
        for piece in slices(batch.column("text")):
            bounds, codes, vocabulary = coded_words(piece)
            if reread:
                for row, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    if (places := reread(ids[piece.lo + row], int(hi - lo))) is not None:
                        codes[lo:hi] = codes[lo:hi][places]
            runs, kept = [[] for _ in range(piece.hi - piece.lo)], np.ones(len(codes), bool)
            for lo, hi in surviving(codes, bounds, least):
                row = int(np.searchsorted(bounds, lo, side="right")) - 1
                for start, length, period in lag_scan(codes[lo:hi], least):
                    runs[row].append((lo - int(bounds[row]) + start, length, period))
                    kept[lo + start + period:lo + start + length] = False
            ends = np.concatenate([[0], np.cumsum(kept)])[bounds].astype(np.int32)
            left = vocabulary.cast(pa.string()).take(pa.array(codes[kept]))
            yield [batch.column("doc_id").slice(piece.lo, piece.hi - piece.lo), as_structs([sorted(r, key=lambda x: (x[0], x[2])) for r in runs]),
                   pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), left), " ")]
    return arrow_map(texts(docs, id_col, text_col), "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept string", work)


def as_structs(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = np.array([r for row in rows for r in row], np.int64).reshape(-1, 3)
    parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)), parts)


def planted_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Every tenth row, by the checksum of its id, goes on periodically from some word."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places
