"""The corpus pipeline: five operators over ``documents``, each on all that the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as Parquet
to the cluster's shared scratch folder and reads it again as the next stage's documents. All stages
but the last return the columns of ``documents``; where a text was cut, ``n_chars`` is counted anew.

Every stage takes nulls in any column, empty and very long texts, repeated rows, extra columns and empty
tables as its operator says: null and empty texts are scored like a text without content, share a
fingerprint, lose nothing and have no tokens; rows with a null id are kept by the second stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, quality, simhash, suffix
from tessera.llm.common import load, materialize

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(spark, docs, load(spark, sf_dir, "labels", "doc_id", "quality"), threshold=0.3)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the smallest id."""
    return simhash.drop_near_duplicates(spark, docs, shingle=3, distance=3)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 240 that also start elsewhere are cut from the texts: passages of over 50 words have
    about 315 bytes, the shortest some 250, and a passage is found only if it is as long as the string."""
    return _counted(suffix.remove_repeats(spark, docs, length=240), docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut from the texts; texts that are mostly such passages go."""
    items = load(spark, sf_dir, "benchmark", "item_id", "text")
    return _counted(decontaminate.remove(spark, docs, items, window=10, max_coverage=0.8), docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, checked by decoding them again."""
    out = bpe.encode_decode(docs, VOCABULARY, public_tokenizers.PATTERN)
    same = F.coalesce(F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.lit(False))
    own = [c for c in ("doc_id", "lang", "source", "text") if c in docs.columns]
    return out.select(*own, F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", same.alias("round_trip"))


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeat_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", token_stage),
]

#: Model fitting and Hamming links have no SQL form; the tests compare ``run`` with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return docs
