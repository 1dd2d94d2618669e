"""Changes to a registry of identities: what is appended is checked against what is there, and nothing is remapped silently.

entities(canonical_id, entity_type, display_name), mappings(entity_type, source_name, source_id, canonical_id),
aliases(canonical_id, alias), memberships(player_id, team_id, valid_from, valid_to). Each change gives the rows it judged
with an outcome; those that are ADDED are what the table gains.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import collapsed
from tidemark.operators.identity import numbered

#: kinds of entities and the letters of their ids; fixed values
PREFIX = {"player": "P", "team": "T", "game": "G"}
MAPPED = ("entity_type", "source_name", "source_id")


def created(new: DataFrame, entities: DataFrame, order: str) -> DataFrame:
    """new(entity_type, display_name, order, ...) with canonical_id, the next numbers of each kind in `order`.

    Rows equal in order are told apart by all their columns, so that a rerun gives the same ids. Rows of another kind
    or without a name get none.
    """
    out = None
    for kind, letter in PREFIX.items():
        last = entities.where(F.col("entity_type") == kind).agg(F.coalesce(F.max(F.substring("canonical_id", 2, 20).try_cast("long")), F.lit(0)).alias("_last"))
        rows = numbered(new.where((F.col("entity_type") == kind) & (F.trim("display_name") != "")), order, "_n", new.columns)
        rows = rows.join(F.broadcast(last)).withColumn("canonical_id", F.format_string(letter + "%08d", F.col("_n") + F.col("_last"))).drop("_n", "_last")  # last is one row
        out = rows if out is None else out.unionByName(rows)
    return out


def _kinds(entities: DataFrame, column: str, name: str) -> DataFrame:
    return entities.select(F.col("canonical_id").alias(column), F.col("entity_type").alias(name))


def added_mappings(new: DataFrame, mappings: DataFrame, entities: DataFrame, order: str) -> DataFrame:
    """new(MAPPED, canonical_id, order, ...) with outcome: UNSUPPORTED_TYPE, SOURCE_REQUIRED, UNKNOWN_ID, WRONG_TYPE, CONFLICT (the
    source's id already means another entity, by the table or an earlier row), KNOWN (it already means this one) or ADDED."""
    kind = _kinds(entities, "canonical_id", "_kind")
    held = mappings.groupBy(*MAPPED).agg(F.min("canonical_id").alias("_held"))
    rows = new.withColumn("source_name", F.trim("source_name")).join(kind, "canonical_id", "left").join(held, list(MAPPED), "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    wrong = (
        F.when(~F.coalesce(F.col("entity_type").isin(*PREFIX), F.lit(False)), "UNSUPPORTED_TYPE")
        .when(blank(F.col("source_name")) | blank(F.col("source_id")), "SOURCE_REQUIRED")
        .when(F.col("_kind").isNull(), "UNKNOWN_ID")
        .when(F.col("_kind") != F.col("entity_type"), "WRONG_TYPE")
    )
    rows = rows.withColumn("_wrong", wrong)
    sound = F.when(F.col("_wrong").isNull(), F.col("canonical_id"))
    first = F.first(sound, ignorenulls=True).over(W.partitionBy(*MAPPED).orderBy(order, "canonical_id").rowsBetween(W.unboundedPreceding, 0))
    means = F.coalesce("_held", "_first")
    nth = F.count(sound).over(W.partitionBy(*MAPPED).orderBy(order, "canonical_id").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumns({"_first": first, "_nth": nth})
    outcome = F.when(F.col("_wrong").isNotNull(), F.col("_wrong")).when(means != F.col("canonical_id"), "CONFLICT").when(F.col("_held").isNotNull() | (F.col("_nth") > 1), "KNOWN").otherwise("ADDED")
    return rows.select(*new.columns, outcome.alias("outcome"))


def added_memberships(new: DataFrame, entities: DataFrame) -> DataFrame:
    """new(player_id, team_id, valid_from, valid_to, ...) with outcome: UNKNOWN_PLAYER, NOT_A_PLAYER, UNKNOWN_TEAM, NOT_A_TEAM,
    DATE_INVALID, EMPTY_SPAN (it ends before or as it begins) or ADDED. Dates may be texts; no end is open."""
    rows = new.join(_kinds(entities, "player_id", "_p"), "player_id", "left").join(_kinds(entities, "team_id", "_t"), "team_id", "left")
    day = lambda c: F.when(F.col(c).cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col(c).cast("string").try_cast("date"))
    bad = day("valid_from").isNull() | (F.col("valid_to").isNotNull() & day("valid_to").isNull())
    outcome = (
        F.when(F.col("_p").isNull(), "UNKNOWN_PLAYER")
        .when(F.col("_p") != "player", "NOT_A_PLAYER")
        .when(F.col("_t").isNull(), "UNKNOWN_TEAM")
        .when(F.col("_t") != "team", "NOT_A_TEAM")
        .when(bad, "DATE_INVALID")
        .when(day("valid_to") <= day("valid_from"), "EMPTY_SPAN")
        .otherwise("ADDED")
    )
    return rows.select(*new.columns, outcome.alias("outcome"))


def alias_index(aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """entity_type, alias in lower case with single spaces, canonical_ids in order, status: RESOLVED for one entity, else AMBIGUOUS."""
    rows = aliases.join(entities.select("canonical_id", "entity_type"), "canonical_id").withColumn("alias", collapsed("alias")).where("alias <> ''")
    by = rows.groupBy("entity_type", "alias").agg(F.array_sort(F.collect_set("canonical_id")).alias("canonical_ids"))
    return by.withColumn("status", F.when(F.size("canonical_ids") == 1, "RESOLVED").otherwise("AMBIGUOUS"))


def integrity(entities: DataFrame, mappings: DataFrame, aliases: DataFrame, memberships: DataFrame) -> DataFrame:
    """fault, n: references of the registry's tables to entities that aren't there or are of another kind, and ids given twice."""

    def refer(rows: DataFrame, column: str, wanted: Column, name: str) -> DataFrame:
        met = rows.join(_kinds(entities, column, "_kind"), column, "left")
        fault = F.when(F.col("_kind").isNull(), f"{name}_WITHOUT_ENTITY").when(F.col("_kind") != wanted, f"{name}_OF_WRONG_TYPE")
        return met.select(fault.alias("fault")).where("fault is not null")

    twice = entities.groupBy("canonical_id").count().where("count > 1").select(F.lit("ENTITY_ID_REPEATED").alias("fault"))
    remapped = mappings.groupBy(*MAPPED).agg(F.count_distinct("canonical_id").alias("n")).where("n > 1").select(F.lit("SOURCE_MAPS_TO_SEVERAL").alias("fault"))
    found = (
        refer(mappings, "canonical_id", F.col("entity_type"), "MAPPING"),
        refer(aliases, "canonical_id", F.col("_kind"), "ALIAS"),
        refer(memberships, "player_id", F.lit("player"), "MEMBERSHIP_PLAYER"),
        refer(memberships, "team_id", F.lit("team"), "MEMBERSHIP_TEAM"),
        remapped,
    )
    out = twice
    for more in found:
        out = out.unionByName(more)
    return out.groupBy("fault").agg(F.count("*").alias("n"))


def one_row_each(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several rows have, with their number: empty for a sound table."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
