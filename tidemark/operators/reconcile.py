"""Matching sources against each other with an explicit status for every row of either side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 300


def match_status(official: DataFrame, provider: DataFrame, keys: list[str], time: str, tolerance: int = TOLERANCE) -> DataFrame:
    """Full outer match on keys with a band on time (epoch seconds): MATCHED, TIME_CONFLICT, AMBIGUOUS, or one side only."""
    o = official.groupBy(*keys).agg(F.count("*").alias("n_official"), F.min(time).alias("official_time"))
    p = provider.groupBy(*keys).agg(F.count("*").alias("n_provider"), F.min(time).alias("provider_time"))
    both = o.join(p, keys, "full_outer")
    status = (
        F.when(F.col("n_provider").isNull(), "OFFICIAL_ONLY")
        .when(F.col("n_official").isNull(), "PROVIDER_ONLY")
        .when((F.col("n_official") > 1) | (F.col("n_provider") > 1), "AMBIGUOUS")
        .when(F.abs(F.col("official_time") - F.col("provider_time")) <= tolerance, "MATCHED")
        .otherwise("TIME_CONFLICT")
    )
    return both.withColumn("status", status)


def resolved(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """names with what their alias stands for: RESOLVED, UNRESOLVED or AMBIGUOUS, and all candidates."""
    known = aliases.groupBy("alias").agg(F.array_sort(F.collect_set("canonical_id")).alias("candidates"))
    out = names.join(known.withColumnRenamed("alias", name), name, "left")
    size = F.coalesce(F.size("candidates"), F.lit(0))
    status = F.when(size == 0, "UNRESOLVED").when(size == 1, "RESOLVED").otherwise("AMBIGUOUS")
    return out.withColumn("status", status).withColumn("canonical_id", F.when(size == 1, F.col("candidates")[0]))


def counts_by_side(before: DataFrame, through: DataFrame, key: str, n: str) -> DataFrame:
    """Full outer delta of two counts; a missing side counts as 0."""
    b, t = before.select(key, F.col(n).alias("n_before")), through.select(key, F.col(n).alias("n_through"))
    out = b.join(t, key, "full_outer").select(key, F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_through", F.lit(0)).alias("n_through"))
    return out.withColumn("delta", F.col("n_through") - F.col("n_before"))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that fails; null where all hold."""
    out = None
    for failed, reason in rules:
        out = F.when(failed, reason) if out is None else out.when(failed, reason)
    return out
