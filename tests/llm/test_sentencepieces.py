"""Texts encoded through the table of marked words against the library on whole texts."""
import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from epitide.llm import queries, sentencepieces
from epitide.llm.common import table
from epitide.llm.textops import slices

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", "a ", " a", "a  b", "▁", "▁x▁", "\t\n x\r\n", "ﬁ①é́ Ａ　b", "\x00a\x00", "<s> </s><0x0A> <unk>", "日本語 テキスト",
       "🙂🙂 🙂", " ".join(["word"] * 3000), "x" * 20000, " " * 5000 + "end" + " " * 40, "same words", "same words", "a b"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def expected(model, text):
    ids = model.encode(text or "")
    return ids, model.decode(ids)


@pytest.mark.parametrize("block", [64, sentencepieces.BLOCK_BYTES])
def test_odd_texts_as_the_library(spark, model, block):
    rows = [(i if i != 4 else None, t, "x", 7) for i, t in enumerate(ODD)] + [(3, "  ", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, words string, block int")
    found = sentencepieces.encode(docs.repartition(3), sentencepieces.load(PATH), block_bytes=block).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"], r["decoded"]) for r in found)
    assert got == sorted((d is None, d or 0, *expected(model, t)) for d, t, _, _ in rows)


def test_query_against_the_library(spark, sf, model):
    want = {}
    for r in table(spark, sf, "documents").select("doc_id", "text").collect():
        ids, text = expected(model, r["text"])
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    found = queries.QUERIES["op11_sentence_pieces"](spark, sf)
    assert dict(found.dtypes)["n_tokens"] == "bigint"
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found.collect()} == want


def test_each_word_of_a_block_is_segmented_once(spark, sf):
    text = pa.array([" " + (r["text"] or "") for r in table(spark, sf, "documents").select("text").collect()], pa.large_string())
    for piece in slices(text, 1 << 16):
        bounds, codes, words = sentencepieces.marked_words(piece)
        assert len(set(words.to_pylist())) == len(words) < len(codes)
        assert "".join(words.take(codes).to_pylist()) == bytes(piece.data).decode() and bounds[-1] == len(codes)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert sentencepieces.encode(docs, sentencepieces.load(PATH)).count() == 0


def test_models_that_cross_markers_are_refused():
    class Crossing:
        def __len__(self):
            return 1

        def id_to_piece(self, i):
            return "of▁the"

    pieces = sentencepieces.Pieces(b"")
    pieces.loaded = Crossing()
    with pytest.raises(ValueError, match="cross"):
        pieces.check()
