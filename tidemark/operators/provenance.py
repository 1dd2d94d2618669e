"""Artifacts, their manifests and what is derived from them: usable parents, states that are set once, objects stored by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATES = ("UNVALIDATED", "PASS", "FAIL", "QUARANTINED")
OBJECT = "sha256 string, content binary, bytes long"


class ProvenanceError(ValueError):
    """A parent that may not be built on."""


def parent_status(parents: DataFrame, artifacts: DataFrame) -> DataFrame:
    """parents(artifact_id, validation_status, sha256) with status, by artifacts(artifact_id, actual_sha256): USABLE, or what is wrong."""
    out = parents.join(artifacts.groupBy("artifact_id").agg(F.max("actual_sha256").alias("actual_sha256")), "artifact_id", "left")
    status = (
        F.when(F.coalesce("artifact_id", F.lit("")) == "", "MISSING_ARTIFACT_ID")
        .when(F.coalesce("validation_status", F.lit("")) != "PASS", "PARENT_NOT_PASS")
        .when(F.coalesce("sha256", F.lit("")) == "", "PARENT_WITHOUT_SHA256")
        .when(F.col("actual_sha256").isNull(), "PARENT_MISSING")
        .when(F.lower("actual_sha256") != F.lower("sha256"), "PARENT_HASH_MISMATCH")
        .otherwise("USABLE")
    )
    return out.withColumn("status", status)


def assert_usable(checked: DataFrame) -> None:
    """Raise unless there is a parent and all are USABLE."""
    if bad := checked.where("status <> 'USABLE'").select("artifact_id", "status").take(1):
        raise ProvenanceError(f"{bad[0].status} {bad[0].artifact_id}")
    if checked.isEmpty():
        raise ProvenanceError("NO_PARENT")


def transitions(requests: DataFrame) -> DataFrame:
    """requests(artifact_id, seq, status, reason) with outcome: an artifact's first valid request settles its state for good."""
    valid = F.col("status").isin(*STATES) & ((F.col("status") != "QUARANTINED") | (F.coalesce(F.trim("reason"), F.lit("")) != ""))
    first = F.min(F.when(valid & (F.col("status") != "UNVALIDATED"), F.col("seq"))).over(W.partitionBy("artifact_id"))
    out = requests.withColumn("_first", first)
    settled = F.coalesce(F.col("seq") > F.col("_first"), F.lit(False))
    outcome = (
        F.when(~F.coalesce(F.col("status").isin(*STATES), F.lit(False)), "INVALID_STATUS")
        .when((F.col("status") == "QUARANTINED") & (F.coalesce(F.trim("reason"), F.lit("")) == ""), "QUARANTINE_REASON_REQUIRED")
        .when(settled, "ALREADY_TERMINAL")
        .otherwise("APPLIED")
    )
    return out.withColumn("outcome", outcome).drop("_first")


def register_bytes(files: DataFrame) -> DataFrame:
    """files(path, content) as manifests of raw artifacts, not yet validated: the id follows from path and content."""
    sha = F.sha2("content", 256)
    return files.select(F.substring(F.sha2(F.concat(F.col("path"), F.lit("|"), sha), 256), 1, 32).alias("artifact_id"), "path", F.octet_length("content").cast("long").alias("byte_size"), sha.alias("sha256"), F.lit("UNVALIDATED").alias("validation_status"))


def object_outcomes(files: DataFrame, root: str) -> DataFrame:
    """sha256, content, shard and outcome of the contents of files(content) against the object table at root: NEW, KNOWN, or CORRUPT
    where what is there under the digest has another one. Only folders of the digests that come in are read."""
    spark = files.sparkSession
    new = files.where("content is not null").select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"]).withColumn("shard", F.substring("sha256", 1, 2))
    there = spark.read.schema(f"{OBJECT}, shard string").option("ignoreMissingFiles", True).parquet(root)
    held = there.join(new.select("sha256", "shard"), ["shard", "sha256"], "left_semi").groupBy("sha256").agg(F.min(F.sha2("content", 256) == F.col("sha256")).alias("sound"))
    outcome = F.when(F.col("sound").isNull(), "NEW").when(F.col("sound"), "KNOWN").otherwise("CORRUPT")
    return new.join(held, "sha256", "left").select("sha256", "content", "shard", outcome.alias("outcome"))


def store_objects(files: DataFrame, root: str) -> None:
    """Add the new contents of files(content) to the object table at root, by the first two digits of their digest; objects are never
    rewritten. The table must exist, if only empty: see new_store."""
    new = object_outcomes(files, root).where("outcome = 'NEW'")
    new.select("sha256", "content", F.octet_length("content").cast("long").alias("bytes"), "shard").write.mode("append").partitionBy("shard").parquet(root)


def new_store(spark: SparkSession, root: str) -> None:
    """An empty object table; a path that exists is an error."""
    spark.createDataFrame([], f"{OBJECT}, shard string").write.mode("errorifexists").parquet(root)
