"""Realised outcomes of games, built only from rows that keep their contract; and frames of paired methods, checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IDENTITY = ("game_id", "event_date", "player_id", "team_id")
STATS = ("pts", "reb", "ast", "fg3m")
#: targets by statistic, and the most minutes a game has; fixed values
TARGETS = {"min": "target_minutes", "pts": "target_points", "reb": "target_rebounds", "ast": "target_assists", "fg3m": "target_3pm"}
MOST_MINUTES = 60


class TargetError(ValueError):
    """Rows that break the target contract; the message has the codes and their counts."""


def _number(c: str) -> Column:
    """A number given as text or number; NaN and text are missing."""
    x = F.trim(F.col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def judged(rows: DataFrame) -> DataFrame:
    """rows(IDENTITY, min, STATS) with faults, the codes that a row breaks in order.

    A DUPLICATE_OUTCOME is every row whose game and player another row has too.
    """
    if absent := [c for c in (*IDENTITY, "min", *STATS) if c not in rows.columns]:
        raise TargetError(f"MISSING_COLUMNS {','.join(absent)}")
    minutes = _number("min")
    day = F.to_date(F.col("event_date").cast("string").try_cast("timestamp"))
    copies = F.count("*").over(W.partitionBy("game_id", "player_id"))
    total = sum((F.coalesce(_number(c), F.lit(0.0)) for c in STATS), F.lit(0.0))
    blank = F.lit(False)
    for c in IDENTITY:
        blank = blank | F.col(c).isNull()
    checks = [
        (blank, "IDENTITY_NULL"),
        (F.col("event_date").isNotNull() & day.isNull(), "EVENT_DATE_INVALID"),
        (copies > 1, "DUPLICATE_OUTCOME"),
        (minutes.isNull(), "MINUTES_MISSING"),
        (minutes < 0, "MINUTES_NEGATIVE"),
        (minutes > MOST_MINUTES, "MINUTES_ABOVE_BOUND"),
        *((_number(c).isNull(), f"{c.upper()}_MISSING") for c in STATS),
        *((_number(c) < 0, f"{c.upper()}_NEGATIVE") for c in STATS),
        ((minutes == 0) & (total > 0), "ZERO_MINUTES_WITH_STATS"),
    ]
    return rows.withColumn("faults", F.array_compact(F.array(*(F.when(c, name) for c, name in checks))))


def fault_counts(rows: DataFrame) -> DataFrame:
    """fault, n over rows of judged()."""
    return rows.select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


def targets(rows: DataFrame) -> DataFrame:
    """Outcomes of sound rows of judged(): identity, target_played and the targets."""
    sound = rows.where(F.size("faults") == 0)
    named = [_number(c).alias(t) for c, t in TARGETS.items()]
    day = F.to_date(F.col("event_date").cast("string").try_cast("timestamp")).alias("event_date")
    out = sound.select("game_id", day, "player_id", "team_id", *named)
    return out.withColumn("target_played", (F.col("target_minutes") > 0).cast("int"))


def build_targets(rows: DataFrame) -> DataFrame:
    """targets() of all rows. Fails closed: one fault, and there is no table."""
    found = judged(rows)
    if worst := fault_counts(found).orderBy("fault").collect():  # one row a code
        raise TargetError(" ".join(f"{r.fault}={r.n}" for r in worst))
    return targets(found)


#: what a method's rows must hold; fixed values
NUMBERS = ("actual", "estimate", "lower", "upper", "covered", "abs_error")
SHARED = ("actual", "estimate", "role_change_flag", "history_group", "volatility_group")
NEAR = 1e-7


def paired_faults(frame: DataFrame, keys: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """fault, n over a frame(keys, method, NUMBERS, role_change_flag, history_group, volatility_group) of paired methods.

    Rows: DATE_INVALID, UNEXPECTED_METHOD, <NUMBER>_INVALID, BOUNDS_INVALID, NOT_BINARY, ERROR_INCONSISTENT,
    COVERAGE_INCONSISTENT. Keys: DUPLICATE_METHOD_ROW, UNPAIRED, and <FIELD>_DIFFERS where methods with one row each
    disagree on what they share. Each is counted once a row or key; a sound frame gives no row.
    """
    value = {c: F.trim(F.col(c).cast("string")).try_cast("double") for c in NUMBERS}
    finite = {c: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) for c, v in value.items()}
    whole = F.lit(True)
    for c in NUMBERS:
        whole = whole & F.coalesce(finite[c], F.lit(False))
    inside = value["actual"].between(0, MOST_MINUTES) & value["estimate"].between(0, MOST_MINUTES) & (value["lower"] <= value["upper"])
    covered = ((value["actual"] >= value["lower"]) & (value["actual"] <= value["upper"])).cast("double")
    binary = value["covered"].isin(0.0, 1.0) & F.coalesce(F.col("role_change_flag").isin(0, 1), F.lit(False))
    day = F.to_date(F.col("event_date").cast("string").try_cast("timestamp"))
    off = F.abs(value["abs_error"] - F.abs(value["actual"] - value["estimate"])) > NEAR + 1e-5 * F.abs(value["actual"] - value["estimate"])
    checks = [
        (day.isNull(), "DATE_INVALID"),
        (~F.coalesce(F.col("method").isin(*methods), F.lit(False)), "UNEXPECTED_METHOD"),
        *((~F.coalesce(finite[c], F.lit(False)), f"{c.upper()}_INVALID") for c in NUMBERS),
        (whole & ~inside, "BOUNDS_INVALID"),
        (whole & ~binary, "NOT_BINARY"),
        (whole & off, "ERROR_INCONSISTENT"),
        (whole & (value["covered"] != covered), "COVERAGE_INCONSISTENT"),
    ]
    rows = frame.select(F.explode(F.array_compact(F.array(*(F.when(c, name) for c, name in checks)))).alias("fault"))
    own = F.when(F.col("method").isin(*methods), F.col("method"))
    # whether values differ is told by the least and the greatest, and methods by a mark each: no row is repeated by distinct counts
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in SHARED}
    marks = [F.coalesce(F.max((F.col("method") == m).cast("int")), F.lit(0)) for m in dict.fromkeys(methods)]
    by = frame.groupBy(*keys).agg(F.count(own).alias("_n"), sum(marks[1:], marks[0]).alias("_d"), *((F.min(t) != F.max(t)).alias(f"_{c}") for c, t in text.items()))
    single = (F.col("_n") == len(methods)) & (F.col("_d") == len(methods))
    of_key = [(F.col("_n") > F.col("_d"), "DUPLICATE_METHOD_ROW"), (F.col("_d") != len(methods), "UNPAIRED"), *((single & F.col(f"_{c}"), f"{c.upper()}_DIFFERS") for c in SHARED)]
    groups = by.select(F.explode(F.array_compact(F.array(*(F.when(c, name) for c, name in of_key)))).alias("fault"))
    return rows.unionByName(groups).groupBy("fault").agg(F.count("*").alias("n"))
