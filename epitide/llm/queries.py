"""One query for each operator, over whole tables, and the SQL of those that SQL can express."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, exact, language, minhash, mixing, periods, pii, quality, repeats, sentencepieces, shards, toxicity, variants
from .common import table

SHARDS = 8


def near_duplicates(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"), size=3, num=85, den=100)


def quality_classifier(spark, sf):
    return quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def toxic_documents(spark, sf):
    found = toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return found.withColumn("held_out", toxicity.held_out())


def listed(spans):
    """kind:start:end of every span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))))


def of_kind(kind):
    return lambda span: span["kind"] == kind


def personal_data(spark, sf):
    """The counts are of the pattern spans; the network's are counted apart."""
    found = pii.personal_data(table(spark, sf, "documents"))
    order = F.create_map(*[x for i, k in enumerate(pii.KINDS) for x in (F.lit(k), F.lit(i))])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        s["begin"].alias("begin"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select(
        "doc_id", *[F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


def repeated_passages(spark, sf):
    found = repeats.drop_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def source_mixing(spark, sf):
    return mixing.mix(table(spark, sf, "documents"))


def language_id(spark, sf):
    found = language.identify_language(table(spark, sf, "documents"), ~toxicity.held_out())
    return found.withColumn("held_out", toxicity.held_out())


def decontamination(spark, sf):
    found = decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def exact_duplicates(spark, sf):
    return exact.exact_dedup(table(spark, sf, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def sharding(spark, sf):
    placed = shards.shard_documents(table(spark, sf, "documents"), shards.tree(SHARDS), shards.tree(SHARDS, grown=1))
    return placed.withColumn("law", F.lit("key"))


def sentence_pieces(spark, sf, model=None):
    """The model is a file of the installed vocabularies unless its path is given."""
    if model is None:
        import public_tokenizers
        model = public_tokenizers.path("piece_bpe_32k.model")
    found = sentencepieces.encode(table(spark, sf, "documents"), sentencepieces.load(model))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def spelling_variants(spark, sf):
    return variants.spelling_variants(variants.word_counts(table(spark, sf, "documents"), respell=variants.slipped))


def word_runs(spark, sf):
    """The longest run is the first one by falling length, start and period."""
    found = periods.periodic_runs(table(spark, sf, "documents"), periods.planted_tail)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    length = -F.col("longest.less")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"),
        F.col("longest.period").alias("period"), F.floor(1000 * length / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_near_duplicates": near_duplicates,
    "op2_quality": quality_classifier,
    "op3_toxicity": toxic_documents,
    "op4_pii": personal_data,
    "op5_repeats": repeated_passages,
    "op6_mixing": source_mixing,
    "op7_language": language_id,
    "op8_decontamination": decontamination,
    "op9_exact_dedup": exact_duplicates,
    "op10_sharding": sharding,
    "op11_sentence_pieces": sentence_pieces,
    "op12_spelling_variants": spelling_variants,
    "op13_word_runs": word_runs,
}

ORACLES = {
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       coalesce(doc_id = max(doc_id) OVER same, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
