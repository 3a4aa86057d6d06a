"""The pipeline's stages, each against a plain version on its own input, and the registered queries."""
import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from epitide.llm import decontaminate, mixing, quality, queries, shards, variants
from epitide.session import stage


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["documents"] = docs
    for name, step in corpus_pipeline.STAGES:
        docs = out[name] = stage(step(spark, docs, sf), "test")
    return out


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_stages_return_documents(steps):
    for name in list(steps)[:-1]:
        assert steps[name].schema == steps["documents"].schema
    assert 0 < steps["sharding"].count() == steps["mixture"].count()


def test_quality_keeps_what_passes(steps, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = quality.quality(steps["documents"], labels).filter("kept")
    assert ids(steps["quality"]) == ids(kept)
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    assert len(good & set(ids(steps["quality"]))) >= 0.97 * len(good)


def test_one_document_of_each_group_stays(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps["quality"].collect()]
    assert ids(steps["near_dedup"]) == sorted({c for _, c in brute.near(rows, 5, 80, 100).values()})


def test_contaminated_documents_go(steps, spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in steps["near_dedup"].collect()]
    found = brute.contamination([t for _, t in rows], items, decontaminate.WINDOW)
    assert ids(steps["decontamination"]) == sorted(i for (i, _), (n, hit, _) in zip(rows, found, strict=True) if not (hit and 20 * hit >= n))


def test_mixture_keeps_what_is_drawn(steps):
    drawn = mixing.mix(steps["decontamination"])
    assert ids(steps["mixture"]) == ids(drawn.filter("kept"))


def test_shards_follow_the_tree(steps):
    placed = steps["mixture"].withColumn("want", shards.descend(F.col("doc_id"), shards.tree(corpus_pipeline.SHARDS)))
    assert steps["sharding"].join(placed.select("doc_id", "want"), "doc_id").filter("shard != want").count() == 0


def test_run_is_the_stages(steps, spark, sf):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=str) == sorted(map(tuple, steps["sharding"].collect()), key=str)


def test_empty_and_odd_documents(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some text without an id", "en", "s", 5), (3, "same text twice over", "en", "s", 5), (3, "same text twice over", "en", "s", 5)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, step in corpus_pipeline.STAGES:
            docs = stage(step(spark, docs, sf), "test")
        assert docs.count() <= len(rows)


def test_registered_queries_cover_all_rows(spark, sf):
    import __spark_entry__
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    by_word = "op12_spelling_variants"  # its rows are words, see test_variants
    words = variants.word_counts(spark.read.parquet(f"{sf}/documents.parquet"), respell=variants.slipped).count()
    for name, query in queries.QUERIES.items():
        assert query(spark, sf).count() == (words if name == by_word else n), name
