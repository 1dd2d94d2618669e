"""A corpus pipeline over documents: language, near duplicates, benchmark leaks, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Rows are told apart by
doc_id and text; near duplicates by doc_id. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.language import identify, of_documents
from tidemark.llm.mixing import mix_sources, quality_weights
from tidemark.llm.natives import row_keys
from tidemark.llm.near_dups import near_duplicates
from tidemark.llm.pii import find_pii, masked
from tidemark.llm.worktables import save


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs without the rows whose key and more are in keys."""
    keys = save(keys.select(F.col("key").alias("_key"), F.col("more").alias("_more")).distinct(), "dropped")
    key, more = row_keys("doc_id", "text")
    return docs.withColumns({"_key": key, "_more": more}).join(keys, ["_key", "_more"], "left_anti").drop("_key", "_more")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language told with confidence stay; source is the host, its suffix that of the address."""
    return _without(docs, identify(of_documents(docs)).where(~F.col("kept")))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group stays."""
    dropped = save(near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; n_chars follows."""
    found = find_pii(docs)
    new = F.when(F.size("pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("text", masked(F.col("text"), F.col("pii"))).withColumn("n_chars", new).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, a row for each time (epoch 1, 2), with their words as size."""
    quality = quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    taken = mix_sources(docs, quality).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "size", "copies")
    taken = save(taken.groupBy("_id", "_key").agg(F.max("size").alias("size"), F.max("copies").alias("copies")), "taken")
    rows = docs.withColumn("_text", F.xxhash64("text")).join(taken, F.expr("doc_id <=> _id and _text = _key"))
    return rows.select(*docs.columns, "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("epoch"))


STAGES = [
    ("languages", languages),
    ("near_duplicates", near_duplicate_groups),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: the first two stages (posteriors, verified links) have no SQL form; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
