"""Benchmark decontamination: documents are streamed through a generalised suffix automaton of the test items."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import textops as T
from .common import arrow_map, share, texts

WINDOW = 13  # words
COVERAGE_ONE_IN = 20  # hit words of all words, as one in so many
PIECE_WORDS = 4_096  # longer items are cut into pieces that overlap by a window
BLOCK_WORDS = 100_000  # words of one automaton: what the driver builds and every task holds at once

PIECES = "item string, block int, words binary"
FOUND = "doc_id bigint, text string, spans array<int>, items array<string>, longest int"
RESULT = ("doc_id bigint, n_words bigint, n_hit bigint, longest int, items array<string>, "
          "spans array<struct<first: int, last: int>>, contaminated boolean, clean_text string")


class Automaton:
    """Suffix automaton of many word sequences, with the items behind every window and every short item."""

    def __init__(self, pieces: list[tuple[str, np.ndarray]], window: int):
        self.window = window
        self.vocabulary = np.unique(np.concatenate([w for _, w in pieces] or [np.zeros(0, np.uint64)]))
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.next, self.link, self.length = [{}], [-1], [0]
        pieces = [(item, np.searchsorted(self.vocabulary, w).tolist()) for item, w in pieces if len(w)]
        ends = [(item, ids, self._insert(ids)) for item, ids in pieces]
        self.shortest = min([window, *(len(ids) for _, ids in pieces)])
        self.items: dict[int, set[str]] = {}  # state of a window or of a whole short item -> items
        short = set()
        for item, ids, end in ends:
            if len(ids) < window:
                self.items.setdefault(end, set()).add(item)
                short.add(end)
            else:
                for _, state, _ in self._walk(ids, window):
                    self.items.setdefault(self._window_state(state), set()).add(item)
        # nearest state on the way to the root that is a whole short item, the state itself included
        self.short = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[state] = state if state in short else self.short[self.link[state]]

    def _insert(self, ids: list[int]) -> int:
        last = 0
        for c in ids:
            last = self._extend(last, c)
        return last

    def _new(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the longest string of p followed by c, taken out of q if q also holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p != -1:
            self.link[state] = self._split(p, self.next[p][c], c)
        return state

    def _walk(self, ids, least: int):
        """(position, state, matched length) wherever the longest match that ends there has at least that many words."""
        state = matched = 0
        for i, c in enumerate(ids):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                matched += 1
            if matched >= least:
                yield i, state, matched

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; -1 for words that no item has."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.known[(hashes >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            same = self.vocabulary[at] == hashes[maybe]
            out[maybe[same]] = at[same]
        return out

    def match(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit spans (first, last word), items found and the longest match among one document's words."""
        spans, items, longest = [], set(), 0
        for begin, end in runs(ids >= 0, self.shortest):
            for i, state, matched in self._walk(ids[begin:end].tolist(), self.shortest):
                i += begin
                longest = max(longest, matched)
                if matched >= self.window:
                    spans.append((i - self.window + 1, i))
                    items |= self.items[self._window_state(state)]
                whole = self.short[state]
                if whole == state and matched < self.length[state]:
                    whole = self.short[self.link[state]]
                while whole > 0:
                    spans.append((i - self.length[whole] + 1, i))
                    items |= self.items[whole]
                    whole = self.short[self.link[whole]]
        return spans, items, longest


def runs(mask: np.ndarray, least: int = 1) -> list[tuple[int, int]]:
    """Begin and end of the runs of True that have at least so many entries."""
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False]))
    return [(b, e) for b, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if e - b >= least]


def item_pieces(items: DataFrame, window: int, block_words: int) -> tuple[DataFrame, int]:
    """Items as word hashes, cut into pieces and dealt to blocks of about block_words words."""
    rows = items.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), F.col("text"))
    least = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-least // (2 * block_words)))  # a word takes two bytes or more with its separator

    def cut(batch):
        for piece in T.slices(batch.column("text")):
            begin, end = T.words(piece, T.ALNUM)
            hashes, first = T.word_hashes(piece, begin, end), T.word_counts(piece, begin)
            out = []
            for row in range(piece.hi - piece.lo):
                own = hashes[first[row]:first[row + 1]]
                step = PIECE_WORDS - window + 1
                for k in range(0, max(1, len(own) - window + 1), step):
                    if len(own):
                        part = own[k:k + PIECE_WORDS]
                        out.append((batch.column("item")[piece.lo + row].as_py(), int((part[0] ^ part[-1]) % np.uint64(blocks)), part.tobytes()))
            if out:
                yield tuple(map(list, zip(*out, strict=True)))
    return arrow_map(rows, PIECES, cut), blocks


def automaton_of(pieces: DataFrame, block: int, window: int) -> Automaton:
    found = pieces.filter(F.col("block") == block).select("item", "words").toArrow().to_pylist()
    return Automaton([(r["item"], np.frombuffer(r["words"], np.uint64)) for r in found], window)


def scan(docs: DataFrame, shared, last: bool, one_in: int) -> DataFrame:
    """Matches every text against one automaton and adds what it finds to what is known; at last sums up each document."""
    ddl = RESULT if last else FOUND

    def work(batch):
        automaton = shared()
        known = [batch.column(c).to_pylist() if c in batch.schema.names else None for c in ("spans", "items", "longest")]
        for piece in T.slices(batch.column("text")):
            begin, end = T.words(piece, T.ALNUM)
            ids = automaton.ids(T.word_hashes(piece, begin, end))
            first = T.word_counts(piece, begin)
            out = []
            for row in range(piece.hi - piece.lo):
                at = piece.lo + row
                spans, items, longest = automaton.match(ids[first[row]:first[row + 1]])
                if known[0] is not None:
                    old = known[0][at]
                    spans += list(zip(old[::2], old[1::2], strict=True))
                    items |= set(known[1][at])
                    longest = max(longest, known[2][at])
                out.append((spans, sorted(items), longest))
            ids_out = batch.column("doc_id").slice(piece.lo, piece.hi - piece.lo)
            if not last:
                yield (ids_out, batch.column("text").slice(piece.lo, piece.hi - piece.lo).cast(pa.string()),
                             [[x for s in o[0] for x in s] for o in out], [o[1] for o in out], [o[2] for o in out])
                continue
            rows = [summary(piece, row, begin[first[row]:first[row + 1]], end[first[row]:first[row + 1]], o[0], one_in) for row, o in enumerate(out)]
            yield (ids_out, [r[0] for r in rows], [r[1] for r in rows], [o[2] for o in out], [o[1] for o in out],
                         [[{"first": a, "last": b} for a, b in r[2]] for r in rows], [r[3] for r in rows], [r[4] for r in rows])
    return arrow_map(docs, ddl, work)


def summary(piece: T.Slice, row: int, begin: np.ndarray, end: np.ndarray, spans, one_in: int):
    """Words, hit words, merged spans, verdict, and the text without its spans (null if nothing was found)."""
    n = len(begin)
    if not spans:
        return n, 0, [], False, None
    hit = np.zeros(n + 1, np.int64)
    for a, b in spans:
        hit[a] += 1
        hit[b + 1] -= 1
    merged = runs(np.cumsum(hit[:n]) > 0)
    n_hit = sum(b - a for a, b in merged)
    kept, at = [], int(piece.offsets[row])
    for a, b in merged:
        kept.append(piece.data[at:begin[a]].tobytes())
        at = int(end[b - 1])
    kept.append(piece.data[at:piece.offsets[row + 1]].tobytes())
    return n, n_hit, [(a, b - 1) for a, b in merged], one_in * n_hit >= n, b"".join(kept).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, one_in: int = COVERAGE_ONE_IN, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every document with the test-item passages in it.

    Words are runs of letters A-Z a-z (lower-cased), digits and non-ASCII characters. A window is `window` words of an item in
    sequence; an item with fewer words is one window. Returns doc_id, n_words, n_hit (words inside an occurrence of a window),
    longest (longest match with any item), items (ids, sorted as text), spans (first and last word of the hit runs),
    contaminated (one in `one_in` words or more is hit), clean_text (the text without hit runs; null if there are none).
    Null and empty texts have no words and are never contaminated; items without words match nothing; a null item id reads as ''.
    Rows that repeat are judged each for itself. No documents or no items give no rows or no hits; other columns are ignored.
    Items fill automata of bounded size; several are applied one after the other, each over all documents.
    """
    rows = texts(docs, id_col, text_col)
    pieces, blocks = item_pieces(items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").alias("text")), window, block_words)
    if blocks > 1:
        pieces = stage(pieces, "item-pieces")
    for block in range(blocks):
        shared = share(docs.sparkSession, automaton_of(pieces, block, window))
        rows = scan(rows, shared, block == blocks - 1, one_in)
        if block < blocks - 1:
            rows = stage(rows, "decontaminate")
    return rows
