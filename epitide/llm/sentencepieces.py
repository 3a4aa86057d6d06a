"""Encoding and decoding with a SentencePiece model through a table of distinct marked words.

The model writes a marker for each space and one before the text. Where no piece has a marker after another character, the
pieces of a text are those of its marked words: markers and what follows them up to the next marker. So each distinct marked
word of a block of texts is segmented once, by the library, and the ids of the texts are joined back by the places of its words.
The table belongs to a block, not to the corpus: most of the different words of a corpus stand in one block only, and moving words
and places to a table of all of them and back takes more disk than the texts have.
"""
from __future__ import annotations

import re
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from .common import arrow_map, texts
from .textops import Slice, slices

MARKER = "▁"
BLOCK_BYTES = 16 << 20  # texts that share one table of words
WORDS = 50_000  # words the library is given at once
# Characters that other normalisations than the plain one change: ligature, circled digit, combining mark, wide space, tab, two spaces.
PROBE = "a  ﬁ①é　Ａ\tb "


class Pieces:
    """A model that travels as its bytes and is loaded once where it is used."""

    def __init__(self, proto: bytes):
        self.proto, self.loaded = proto, None

    def __reduce__(self):
        return Pieces, (self.proto,)

    @property
    def model(self) -> sentencepiece.SentencePieceProcessor:
        if self.loaded is None:
            self.loaded = sentencepiece.SentencePieceProcessor(model_proto=self.proto)
        return self.loaded

    def check(self) -> None:
        """Raises unless texts fall apart at the markers."""
        model = self.model
        crossing = [p for p in map(model.id_to_piece, range(len(model))) if re.search(f"[^{MARKER}]{MARKER}", p)]
        if crossing:
            raise ValueError(f"pieces cross the marker, e.g. {crossing[:3]}")
        if model.normalize(PROBE) != MARKER + PROBE.replace(" ", MARKER):
            raise ValueError("the model changes characters before it segments")

    def segment(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids of each marked word (its markers written as spaces), and the text of these ids behind other text."""
        model = self.model
        alone, front = [model.piece_to_id(MARKER)], model.encode("a")
        lead = len(model.decode(front))
        ids, decoded = [pa.array([], pa.large_list(pa.int32()))], [pa.array([], pa.large_string())]
        for at in range(0, len(words), WORDS):
            # the library puts one marker before what it is given; a lone marker is thus no text for it
            found = [i or alone for i in model.encode([w[1:] for w in words.slice(at, WORDS).to_pylist()])]
            ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
            ids.append(pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(found), np.int32, ends[-1]))))
            decoded.append(pa.array([t[lead:] for t in model.decode([front + i for i in found])], pa.large_string()))
        return pa.concat_arrays(ids), pa.concat_arrays(decoded)


def load(path: str) -> Pieces:
    """The model in a file that the driver reads; its bytes go to the tasks."""
    pieces = Pieces(Path(path).read_bytes())
    pieces.check()
    return pieces


def marked_words(piece: Slice) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """First word of each text (one entry more), the place of every word in the table, and the table of different words."""
    space = piece.data == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[piece.offsets[:-1][np.diff(piece.offsets) > 0]] = True
    begin = np.flatnonzero(begins)
    edges = np.append(begin, len(piece.data)).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(piece.data))).dictionary_encode()
    return np.searchsorted(begin, piece.offsets), coded.indices, coded.dictionary


def joined(parts: pa.Array, codes: pa.Array, bounds: np.ndarray) -> pa.Array:
    """What stands in the table for each word, set down text by text."""
    whole = parts.take(codes)
    if pa.types.is_large_list(whole.type):
        return pa.LargeListArray.from_arrays(pa.array(whole.offsets.to_numpy()[bounds]), whole.values)
    ends = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, whole.offset * 8)[bounds]
    halves = np.empty(2 * len(ends) - 1, np.int64)  # the marker before a text is no part of it: a text is cut into its first byte and the rest
    halves[::2], halves[1::2] = ends, np.minimum(ends[:-1] + 1, ends[1:])
    cut = pa.LargeStringArray.from_buffers(len(halves) - 1, pa.py_buffer(halves), whole.buffers()[2] or pa.py_buffer(b""))
    return cut.take(pa.array(np.arange(1, len(halves), 2)))


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, ids and decoded text of every row, as the library gives them for the whole text, without begin or end ids.

    Null texts count as empty: no ids, empty text. Rows without id and repeated rows come back as often as they stand. A block holds
    whole texts, so the memory of a task follows its block or the longest text; nothing is shuffled. An empty table gives no rows; other
    columns are ignored.
    """
    def work(batch):
        text = pc.replace_substring(pc.fill_null(batch.column("text").cast(pa.large_string()), ""), MARKER, " ")
        nothing = pa.scalar("", pa.large_string())
        text = pc.if_else(pc.equal(text, nothing), nothing, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, nothing))
        for piece in slices(text, block_bytes):
            bounds, codes, table = marked_words(piece)
            ids, decoded = pieces.segment(table)
            yield [batch.column("doc_id").slice(piece.lo, piece.hi - piece.lo), joined(ids, codes, bounds), joined(decoded, codes, bounds)]
    return arrow_map(texts(docs, id_col, text_col), "doc_id bigint, ids array<int>, decoded string", work)
