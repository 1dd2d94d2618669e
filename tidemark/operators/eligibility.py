"""What may be used before an event: observations known by a cutoff, days within their season, approved predictors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import OFFSET, utc_time

TIMES = ("observed_at_utc", "available_at_utc", "prediction_cutoff_utc")
#: names and parts of names that tell an outcome; fixed values
OUTCOMES = ("target", "actual", "realized", "label", "outcome")
IDENTIFIERS = ("player_id", "team_id", "game_id", "event_date", "game_date", "date", "y", *OUTCOMES)


class ContractViolation(ValueError):
    """Predictors that may not be used; the message says which and why."""


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def pregame_reason(required: Sequence[str], revised: str = "is_revised", verified: str = "revision_asof_verified") -> Column:
    """Why an observation may not be used at its cutoff, the first reason that holds; eligible_at_cutoff if none does."""
    missing = F.array_join(F.array_compact(F.array(*(F.when(blank(c), c) for c in required))), ",")
    naive = [~F.trim(F.col(c)).rlike(OFFSET) & F.try_to_timestamp(F.trim(F.col(c))).isNotNull() for c in TIMES]
    wrong = [utc_time(c).isNull() for c in TIMES]
    first = F.lit(None).cast("string")
    for n, w in reversed(list(zip(naive, wrong, strict=True))):
        first = F.when(n, "naive timestamp forbidden").when(w, "invalid ISO-8601 timestamp").otherwise(first)
    observed, available, cutoff = map(utc_time, TIMES)
    return (
        F.when(missing != "", F.concat(F.lit("missing_required:"), missing))
        .when(first.isNotNull(), F.concat(F.lit("invalid_timestamp:"), first))
        .when(available < observed, "availability_before_observation")
        .when(observed > cutoff, "observed_after_cutoff")
        .when(available > cutoff, "available_after_cutoff")
        .when(F.coalesce(F.col(revised), F.lit(False)) & ~F.coalesce(F.col(verified), F.lit(False)), "revision_asof_unverified")
        .otherwise("eligible_at_cutoff")
    )


def coalesced(rows: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """A column for each name from the first of its aliases that rows has a value in; blanks count as none."""
    there = lambda names: [F.when(~blank(n), F.col(n).cast("string")) for n in names if n in rows.columns]
    return rows.select(*(F.coalesce(*(there(names) or [F.lit(None).cast("string")])).alias(name) for name, names in aliases.items()))


def row_faults(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows with fault: MISSING_FIELD where any column is null, DUPLICATE_KEY where the key occurs again, else null."""
    counted = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    any_null = F.greatest(*(F.col(c).isNull() for c in rows.columns))
    twice = rows.join(counted, list(key), "left").withColumn("fault", F.when(any_null, "MISSING_FIELD").when(F.col("_n") > 1, "DUPLICATE_KEY"))
    return twice.drop("_n")


def calendar_window(season: str | Column, day: str | Column, windows: dict[str, tuple[str, str]], special: Sequence[tuple[str, str, str, str]]) -> Column:
    """The kind of day within a season: the first special window (season, from, to, kind) that holds it, else in or out of the season's."""
    s, d = (F.col(c) if isinstance(c, str) else c for c in (season, day))
    within = lambda a, b: d.between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    out = F.when(d.isNull(), "INVALID_DATE")
    for name, a, b, kind in special:
        out = out.when((s == name) & within(a, b), kind)
    for name, (a, b) in windows.items():
        out = out.when((s == name) & within(a, b), "IN_WINDOW_NOT_SCHEDULE_VERIFIED")
    return out.otherwise("OUTSIDE_WINDOW_REQUIRES_REVIEW")


def normal_name(c: str | Column) -> Column:
    """A column name in lower case, its other signs as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def predictor_verdict(name: str | Column) -> Column:
    """FORBIDDEN for names that tell an identity or an outcome, EMPTY for blank ones, else ALLOWED."""
    n, words = normal_name(name), "|".join(OUTCOMES)
    bad = n.isin(*IDENTIFIERS) | n.rlike(f"^({words})_|_({words})$")
    return F.when(n == "", "EMPTY").when(bad, "FORBIDDEN").otherwise("ALLOWED")


def predictors(rows: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Just the approved columns of rows, which must be there, be numbers and hold finite values; nothing is chosen by itself."""
    if not allowed:
        raise ContractViolation("no approved predictors")
    names = rows.sparkSession.createDataFrame([(n,) for n in allowed], "name string").select("name", normal_name("name").alias("plain"), predictor_verdict("name").alias("verdict")).collect()
    if len({r.plain for r in names}) < len(allowed):
        raise ContractViolation("approved predictors collide")
    for r in names:
        if r.verdict != "ALLOWED":
            raise ContractViolation(f"forbidden predictor {r.name}")
        if r.name not in rows.columns:
            raise ContractViolation(f"missing predictor {r.name}")
    kinds = dict(rows.select(*allowed).dtypes)
    if odd := [n for n, k in kinds.items() if not k.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))]:
        raise ContractViolation(f"non-numeric predictors {odd}")
    values = [F.col(n).cast("double") for n in allowed]
    infinite = F.greatest(*(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) for v in values), F.lit(False))
    if not rows.where(infinite).isEmpty():
        raise ContractViolation("missing or non-finite predictor value")
    return rows.select(*allowed)
