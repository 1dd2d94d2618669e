"""Stints of players on the floor: who is active when, and minutes against the official ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merged(stints: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Half-open stints of each key with those that touch or overlap made one; empty ones go."""
    w = W.partitionBy(*keys).orderBy(start, end)
    rows = stints.where(F.col(end) > F.col(start)).select(*keys, start, end)
    reached = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce((F.col(start) > reached).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def coverage(stints: DataFrame, team: str, player: str, start: str, end: str) -> DataFrame:
    """team, start, end, active: players on the floor at the middle of each interval between two neighbouring stint ends.

    A player's own stints are merged first, so a player counts once; a sweep over moments, summed up by team and moment,
    then gives what a join of intervals with stints would.
    """
    step = lambda df, s: F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(s).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-s).alias("step")))).alias("e")  # noqa: E731, ARG005
    ends = stints.select(team, step(stints, 0)).select(team, "e.*")
    moves = merged(stints, [team, player], start, end).select(team, step(stints, 1)).select(team, "e.*")
    moments = ends.unionByName(moves).groupBy(team, "at").agg(F.sum("step").alias("step"))
    w = W.partitionBy(team).orderBy("at")
    out = moments.select(team, F.col("at").alias(start), F.lead("at").over(w).alias(end), F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("active"))
    return out.where(F.col(end).isNotNull())


def against_box(box: DataFrame, stints: DataFrame, keys: Sequence[str], start: str, end: str, unit: float) -> DataFrame:
    """box with stint_minutes, the sum of the stints of its keys over unit; 0 where there are none."""
    played = stints.groupBy(*keys).agg((F.sum(F.col(end) - F.col(start)) / unit).alias("stint_minutes"))
    return box.join(played, list(keys), "left").withColumn("stint_minutes", F.coalesce("stint_minutes", F.lit(0.0)))
