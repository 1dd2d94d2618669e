"""The llm queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import oracles
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.hard_negatives import mine_negatives, shifted_labels
from tidemark.llm.language import identify, of_documents
from tidemark.llm.mixing import mix_sources, quality_weights
from tidemark.llm.nbsvm import score_quality
from tidemark.llm.near_dups import near_duplicates
from tidemark.llm.outliers import quality_outliers
from tidemark.llm.packing import pack
from tidemark.llm.pii import as_line, find_pii
from tidemark.llm.reference_parse import reference_dedup
from tidemark.llm.suffix_dedup import suffix_dedup
from tidemark.llm.url_filter import filter_urls
from tidemark.llm.vector_codes import compress, digest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "n_errors", "start", "end")


def op2_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
    return quality_outliers(table(spark, sf_dir, "documents")).select(*columns)


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages count as labelled by the labels row of their own number; bad is quality 0."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), labels).withColumn("badness", F.round("badness", 9))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["rank"] < 4)
    each = [F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]  # noqa: B023
    return found.select("doc_id", *each, F.sha2(as_line(base).cast("binary"), 256).alias("base_sha256"), as_line(F.col("pii")).alias("spans"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return score_quality(table(spark, sf_dir, "documents"), labels)


def op9_reference_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(of_documents(table(spark, sf_dir, "documents"))).select("doc_id", "language", "posterior", "kept")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books, _ = compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_negatives(shifted_labels(table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_decontaminate, op2_quality_outliers, op3_near_dups, op4_url_filter, op5_personal_data, op6_suffix_dedup, op7_mixing, op8_quality_classifier, op9_reference_dedup, op10_language, op11_vector_codes, op12_packing, op13_hard_negatives)
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
