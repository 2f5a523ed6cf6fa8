"""Registered queries of the training-data operators: each applies one operator with production
parameters to its whole table and derives the digest columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, fim, jaccard, licenses, maxent, quality, rules, simhash, suffix, urls, warc, whitening
from tessera.llm.common import load
from tessera.session import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents", "doc_id", "text")
    labels = load(spark, sf, "labels", "doc_id", "quality")
    held = quality.held_out("doc_id", 5, 0)
    model = quality.fit(spark, docs, labels.where(~held))
    out = docs.select("doc_id", held.alias("held_out"), quality.score(spark, model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents", "doc_id", "text")
    out = bpe.encode_decode(docs, VOCABULARY, public_tokenizers.PATTERN)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_warc_archive(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(spark, load(spark, sf, "pages", "page_id", "url", "html"), path)
    return warc.reconstruct(spark, path).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
                                                F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")


def op4_benchmark_contamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.find(spark, load(spark, sf, "documents", "doc_id", "text"), load(spark, sf, "benchmark", "item_id", "text"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op5_simhash_groups(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(spark, load(spark, sf, "documents", "doc_id", "text"), shingle=3, distance=3)


def op6_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(spark, load(spark, sf, "pages", "page_id", "url"))


def op7_exact_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.repeated_bytes(spark, load(spark, sf, "documents", "doc_id", "text"), length=400)


def op8_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.scan(spark, load(spark, sf, "documents", "doc_id", "text"))
    names = F.array_join(F.transform("notices", lambda n: n["license"]), ", ")
    edits = F.array_join(F.flatten(F.transform("notices", lambda n: n["differences"])), " ")
    return found.select("doc_id", "n_blocks", F.size("notices").alias("n_notices"), names.alias("licenses"),
                        F.array_join(F.transform("notices", lambda n: n["begin"].cast("string")), ",").alias("begins"), edits.alias("differences"))


def op9_maxent_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents", "doc_id", "text")
    held = quality.held_out("doc_id", 7, 2)
    out = maxent.score(spark, docs, ~held)
    return out.select("doc_id", quality.held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_quality_votes(spark: SparkSession, sf: str) -> DataFrame:
    out = rules.score(spark, load(spark, sf, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_whitened_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    out = whitening.whiten(spark, load(spark, sf, "embeddings", "vec_id", "embedding"), components=8)
    return out.withColumn("deviation", F.col("deviation").cast("long"))


def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    out = fim.with_restored(fim.transform(load(spark, sf, "documents", "doc_id", "text")))
    return out.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
                      F.sha2("fim.output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_jaccard_groups(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.similar_documents(spark, load(spark, sf, "documents", "doc_id", "text"), shingle=4, at=85, of=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_warc_archive": op3_warc_archive,
    "op4_benchmark_contamination": op4_benchmark_contamination,
    "op5_simhash_groups": op5_simhash_groups,
    "op6_url_rules": op6_url_rules,
    "op7_exact_substrings": op7_exact_substrings,
    "op8_license_scan": op8_license_scan,
    "op9_maxent_scores": op9_maxent_scores,
    "op10_quality_votes": op10_quality_votes,
    "op11_whitened_embeddings": op11_whitened_embeddings,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_jaccard_groups": op13_jaccard_groups,
}
