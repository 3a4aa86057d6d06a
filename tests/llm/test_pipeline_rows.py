"""Verdicts of the pipeline are by row: null and repeated ids take no other row with them, and of a group exactly one row stays."""
from collections import Counter

import pytest

import corpus_pipeline
from epitide.llm import mixing

A, B, C = (" ".join(f"{w}{k}" for k in range(60)) for w in ("alpha", "beta", "gamma"))
NEAR_A = A.replace("alpha59", "changed")
ITEM = " ".join(f"question{k}" for k in range(40))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([("i", ITEM)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], SCHEMA)


def left(found):
    assert "_row" not in found.columns
    return Counter((r["doc_id"], r["text"]) for r in found.collect())


def test_quality_drops_rows(spark, folder):
    docs = frame(spark, [(None, A), (None, ""), (None, B), (7, C), (7, None), (7, C)])
    assert left(corpus_pipeline.quality_filter(spark, docs, folder)) == Counter([(None, A), (None, B), (7, C), (7, C)])


@pytest.mark.parametrize("files", [False, True])
def test_one_row_of_each_group_stays(spark, folder, tmp_path, files):
    docs = frame(spark, [(None, A), (None, A), (None, B), (None, B), (9, NEAR_A), (3, C), (3, C), (4, A), (4, C), (5, "")])
    if files:
        docs.repartition(4).write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    assert left(corpus_pipeline.near_dedup(spark, docs, folder)) == Counter([(4, A), (None, B), (3, C), (5, "")])


def test_contaminated_rows_go(spark, folder):
    docs = frame(spark, [(None, A), (None, ITEM), (5, ITEM), (5, B), (6, C)])
    assert left(corpus_pipeline.decontamination(spark, docs, folder)) == Counter([(None, A), (5, B), (6, C)])


def test_mixture_draws_rows(spark, folder):
    made = [(i, t, lang, source, 0) for source, lang, n in (("hot", "en", 60), ("cold", "fr", 3)) for t in (A, B) for i in [None, 1, 2, *range(3, n)]]
    docs = spark.createDataFrame(made, SCHEMA)
    want = Counter((r["doc_id"], r["source"], r["lang"]) for r in mixing.mix(docs).filter("kept").collect())
    assert Counter((r["doc_id"], r["source"], r["lang"]) for r in corpus_pipeline.mixture(spark, docs, folder).collect()) == want
