"""Resolving what sources call things, and numbering what is new."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ranges of the order that numbers are given out in
RANGES = 200
#: fixed values: codes and names of the thirty teams, and other names in use
TEAMS = {
    "ATL": "Atlanta Hawks", "BKN": "Brooklyn Nets", "BOS": "Boston Celtics", "CHA": "Charlotte Hornets", "CHI": "Chicago Bulls",
    "CLE": "Cleveland Cavaliers", "DAL": "Dallas Mavericks", "DEN": "Denver Nuggets", "DET": "Detroit Pistons", "GSW": "Golden State Warriors",
    "HOU": "Houston Rockets", "IND": "Indiana Pacers", "LAC": "Los Angeles Clippers", "LAL": "Los Angeles Lakers", "MEM": "Memphis Grizzlies",
    "MIA": "Miami Heat", "MIL": "Milwaukee Bucks", "MIN": "Minnesota Timberwolves", "NOP": "New Orleans Pelicans", "NYK": "New York Knicks",
    "OKC": "Oklahoma City Thunder", "ORL": "Orlando Magic", "PHI": "Philadelphia 76ers", "PHX": "Phoenix Suns", "POR": "Portland Trail Blazers",
    "SAC": "Sacramento Kings", "SAS": "San Antonio Spurs", "TOR": "Toronto Raptors", "UTA": "Utah Jazz", "WAS": "Washington Wizards",
}
OTHER_NAMES = {"LA Clippers": "LAC", "NY Knicks": "NYK"}


class BuildError(ValueError):
    """A canonical table that can't be built; the message starts with the reason and its count."""


def team_code(c: str | Column) -> Column:
    """The code of a team given by code or name, whatever its case and spacing; null for anything else."""
    plain = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    known = {k.lower(): k for k in TEAMS} | {v.lower(): k for k, v in TEAMS.items()} | {k.lower(): v for k, v in OTHER_NAMES.items()}
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), plain)


def team_in_matchup(team: str | Column, matchup: str | Column) -> Column:
    """Whether a team is one of the two of AAA@BBB."""
    sides = [F.regexp_extract(F.trim(matchup), r"^([A-Z]{3})@([A-Z]{3})$", k) for k in (1, 2)]
    return F.coalesce(team_code(team).isin(*sides), F.lit(False))


def resolutions(registry: DataFrame) -> DataFrame:
    """registry(entity_type, source_name, source_id, canonical_id): entity_type, source_name, source_id, canonical_id where it is
    the only one, n_ids."""
    ids = registry.where("canonical_id is not null").groupBy("entity_type", "source_name", "source_id").agg(F.count_distinct("canonical_id").alias("n_ids"), F.min("canonical_id").alias("canonical_id"))
    return ids.withColumn("canonical_id", F.when(F.col("n_ids") == 1, F.col("canonical_id")))


def by_source_id(rows: DataFrame, registry: DataFrame, fields: dict[str, str], source: str) -> DataFrame:
    """rows with, for each field (column to entity type), <column>_canonical and <column>_status: RESOLVED, UNRESOLVED, AMBIGUOUS or
    NULL_REQUIRED_VALUE."""
    known = resolutions(registry.where(F.col("source_name") == source))
    for c, kind in fields.items():
        side = known.where(F.col("entity_type") == kind).select(F.col("source_id").alias("_id"), F.col("canonical_id").alias(f"{c}_canonical"), F.col("n_ids").alias("_n"))
        rows = rows.withColumn("_key", F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))).join(side, F.col("_key") == F.col("_id"), "left")
        status = F.when(F.col("_key").isNull(), "NULL_REQUIRED_VALUE").when(F.col("_n").isNull(), "UNRESOLVED").when(F.col("_n") > 1, "AMBIGUOUS").otherwise("RESOLVED")
        rows = rows.withColumn(f"{c}_status", status).drop("_key", "_id", "_n")
    return rows


def build_faults(resolved: DataFrame, fields: dict[str, str]) -> DataFrame:
    """field, status, n: what keeps resolved rows from being canonical."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"{c}_status").alias("status")) for c in fields)))
    return resolved.select(each.alias("f")).select("f.*").where("status <> 'RESOLVED'").groupBy("field", "status").agg(F.count("*").alias("n"))


def canonical(rows: DataFrame, registry: DataFrame, fields: dict[str, str], source: str) -> DataFrame:
    """rows with canonical ids in place of the source's. Fails closed: one row that doesn't resolve, and there is no table."""
    resolved = by_source_id(rows, registry, fields, source)
    if worst := build_faults(resolved, fields).orderBy("field", "status").take(1):
        raise BuildError(f"IDENTITY_{worst[0].status} {worst[0].field} n={worst[0].n}")
    return resolved.select(*(F.col(f"{c}_canonical").alias(c) if c in fields else F.col(c) for c in rows.columns))


def numbered(rows: DataFrame, order: str, name: str = "number", ties: Sequence[str] | None = None) -> DataFrame:
    """rows with their place in the order of a numeric or date column, from 1; ties by the columns `ties`, all of them if not given.

    Only rows that are equal in all of these may change places in a rerun.

    Ranges of the order are counted first, and a range is numbered by itself, so no task holds all rows. At most
    RANGES bounds come to the driver.
    """
    at, rest = F.col(order).cast("double"), [c for c in rows.columns if c != order]
    bounds = rows.agg(F.percentile_approx(at, [k / RANGES for k in range(1, RANGES)], 10000).alias("b")).first().b or []
    piece = F.lit(0) if not bounds else F.size(F.filter(F.array(*(F.lit(float(b)) for b in sorted(set(bounds)))), lambda b: b < at))
    rows = rows.withColumn("_range", piece)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", before.alias("_before"))  # a row a range
    place = F.row_number().over(W.partitionBy("_range").orderBy(order, *(rest if ties is None else ties)))
    return rows.join(F.broadcast(offsets), "_range").withColumn(name, place + F.col("_before")).drop("_range", "_before")


def minted(rows: DataFrame, order: str, prefix: str) -> DataFrame:
    """rows with canonical_id: the prefix and eight digits of their place."""
    return numbered(rows, order, "_number").withColumn("canonical_id", F.format_string(prefix + "%08d", F.col("_number"))).drop("_number")
