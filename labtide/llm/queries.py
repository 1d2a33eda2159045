"""The text queries: each applies its operator to its whole table and returns the digest of the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtide.llm import (
    centroids,
    decontaminate,
    jaccard,
    lines,
    maxent,
    mixing,
    packed,
    quality,
    repeats,
    resampling,
    rules,
    secrets,
    toxicity,
)
from labtide.llm.common import settled, shared_folder, table, train_bucket


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = settled(mixing.sizes(table(spark, sf_dir, "documents")))
    return mixing.shares(sized).select("doc_id", "size", "source_size", "target", "taken")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = secrets.statistics(docs)
    corpus, labels = secrets.planted(docs)
    scored = secrets.scan(secrets.candidates(docs, known), secrets.train(secrets.candidates(corpus, known), labels))
    return scored.select(
        "doc_id", "start", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret"
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), train_bucket("doc_id", 4) == 2
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), digest=True)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lines.with_kept_lines(docs)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), train_bucket("doc_id", 5) == 0
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), train_bucket("doc_id", 5) == 1
    found = maxent.score(docs, *maxent.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.report(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (table(spark, sf_dir, name).select(key, "text") for name, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    weights = resampling.gains(resampling.bucket_counts(docs), resampling.bucket_counts(target))
    found = resampling.resampled(resampling.scores(docs, weights))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/packed-{uuid.uuid4().hex}"
    packed.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    found = packed.read(spark, path, dict(docs.dtypes)["doc_id"])
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = centroids.kept(table(spark, sf_dir, "embeddings"))
    fitted = centroids.fit(vectors)
    found = centroids.with_inertia(settled(centroids.assign(vectors, fitted)))
    digests = F.array(*[F.lit(centroids.digest(c)) for c in fitted] or [F.lit("")])
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
        F.element_at(digests, F.col("cluster") + 1).alias("centroid_sha256"),
    )


QUERIES = {
    "op1_mixture": op1_mixture,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality": op3_quality,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality_rules": op10_quality_rules,
    "op11_resampling": op11_resampling,
    "op12_packed_ids": op12_packed_ids,
    "op13_centroids": op13_centroids,
}
