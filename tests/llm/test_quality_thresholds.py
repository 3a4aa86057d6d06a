"""Thresholds that odd trusted rows do not lift, and what they catch."""
import numpy as np
from pyspark.sql import functions as F

from epitide.llm import quality


def test_an_odd_trusted_row_does_not_lift_the_threshold(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeiounrstl"), 5)) for _ in range(300)]
    good = [(k, " ".join(rng.choice(words, 80)), "en") for k in range(200)]
    bad = [(1000 + k, "".join(rng.choice(list("QZXJVKW0123456789#%&"), 400)), "en") for k in range(20)]
    docs = spark.createDataFrame(good + bad + [(5000, "solo " + good[0][1], "fr")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in [*range(200), 1000, 5000]], "doc_id bigint, quality int")  # one bad row is trusted
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert not any(got[i]["kept"] for i, _, _ in bad[1:])
    assert np.mean([got[i]["kept"] for i, _, _ in good]) > 0.97 and got[5000]["threshold"] > 1


def test_catch_rate_and_losses_on_labelled_rows(spark):
    at = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    found = quality.quality(spark.read.parquet(f"{at}/documents.parquet"), labels).join(labels, "doc_id")
    kept = {r["quality"]: r["kept"] for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert kept[0] < 0.1 and kept[1] > 0.98, kept
