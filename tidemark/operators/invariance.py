"""Proof by perturbation that features of a day don't see that day, later ones, or other entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.day_features import feature_frame

OUTCOMES = ("minutes", "points", "extras")
GAME = ("game_id", "entity_id", "event_date")
#: relative rounding error that sums of doubles may leave
NOISE = 1e-9


def mutated(games: DataFrame, where: Column) -> DataFrame:
    """games with other outcomes on the rows that where holds."""
    return games.withColumns({c: F.when(where, F.coalesce(F.col(c), F.lit(0)) + 7).otherwise(F.col(c)).cast(games.schema[c].dataType) for c in OUTCOMES})


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows of two feature frames aren't the same, outcomes aside.

    Rows meet by game, entity and day, copies in the order of their features; numbers may differ by NOISE, relative
    above 1. A row without a partner counts.
    """
    a, b = a.drop(*OUTCOMES), b.drop(*OUTCOMES)
    rest = [c for c in a.columns if c not in GAME]
    nth = F.row_number().over(W.partitionBy(*GAME).orderBy(*(F.col(c) for c in rest)))
    side = lambda df: df.select(*GAME, nth.alias("_nth"), F.struct(*rest).alias("_row"))
    both = side(a).withColumnRenamed("_row", "_a").join(side(b).withColumnRenamed("_row", "_b"), [*GAME, "_nth"], "full_outer")

    def same(c: str, kind: str) -> Column:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        near = F.coalesce(F.abs(x - y) <= NOISE * F.greatest(F.lit(1.0), F.abs(x)), F.lit(False)) if kind == "double" else F.lit(False)
        return x.eqNullSafe(y) | near

    wrong = F.col("_a").isNull() | F.col("_b").isNull()
    for c, kind in a.dtypes:
        if c in rest:
            wrong = wrong | ~same(c, kind)
    return both.agg(F.count_if(wrong).alias("failures"))


def suite(games: DataFrame, day: str, build: Callable[[DataFrame], DataFrame] = feature_frame) -> DataFrame:
    """case, failures for a builder of features by game_id, entity_id and event_date; every count must be 0."""
    d, date = F.lit(day).cast("date"), F.col("event_date")
    base = build(games)
    upto, before = date <= d, date < d
    odd = F.col("entity_id") % 2 == 1
    cases = {
        "same_day_outcome_mutation": differences(base.where(upto), build(mutated(games, date == d)).where(upto)),
        "future_outcome_mutation": differences(base.where(before), build(mutated(games, date >= d)).where(before)),
        "other_entity_mutation": differences(base.where(~odd), build(mutated(games, odd)).where(~odd)),
        "row_order": differences(base, build(games.repartition(7, F.xxhash64("game_id")))),
    }
    features = [c for c in base.columns if c not in games.columns]
    told = base.groupBy("entity_id", "event_date").agg(F.count_distinct(F.to_json(F.struct(*features))).alias("n"))
    cases["same_day_rows_share_features"] = told.agg(F.count_if(F.col("n") > 1).alias("failures"))
    cases["cold_start_has_no_history"] = base.agg(F.count_if((F.col("prior_days") == 0) & (F.col("prior_value").isNotNull() | (F.col("prior_games") != 0))).alias("failures"))
    out = None
    for name, found in cases.items():
        row = found.select(F.lit(name).alias("case"), F.col("failures").cast("long").alias("failures"))
        out = row if out is None else out.unionByName(row)
    return out
