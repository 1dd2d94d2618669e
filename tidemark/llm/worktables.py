"""Intermediate tables of an operator, written where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; on a local master without one, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    This cuts lineage: an executor lost later costs a read of these files, not a rerun. Shuffle files of the
    write go as soon as it ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that save() returned, once nothing reads them any more: what it returned later is made."""
    for t in tables:
        spark = t.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(t.saved_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
