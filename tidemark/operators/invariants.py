"""What a snapshot of earlier days, a feature registry and a source table must hold, each as faults that can be counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.review import all_reasons

#: columns of a feature registry, and what its statuses may be; fixed values
REGISTRY = (
    "feature_name", "feature_group", "description", "source_domain", "pregame_available", "historical_available", "today_available",
    "missing_value_policy", "leakage_checked", "coverage_status", "research_status", "feature_version", "notes",
)
STATUSES = ("APPROVED_BASELINE", "RESEARCH_ONLY", "BLOCKED", "REJECTED")
COVERAGES = ("PASS", "PARTIAL", "UNPROVEN", "FAIL")
#: where a snapshot comes from; fixed values
PROVENANCE = ("parent_artifact_id", "parent_sha256", "logical_sha256", "snapshot_id")


def _day(c: Column) -> Column:
    """A day written as yyyy-MM-dd; null for anything else."""
    return F.when(c.cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$"), c.cast("string").try_cast("date"))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""


def snapshot_faults(rows: DataFrame, target: str, keys: Sequence[str], day: str, team: str, opponent: str) -> DataFrame:
    """fault, n of a snapshot's rows for a target day: INVALID_DATE, D1_LEAKAGE (not before the target), MISSING_KEY, TEAM_OPPONENT_MISSING,
    TEAM_EQUALS_OPPONENT, and DUPLICATE_KEY for each row beyond a key's first. Keys and teams are trimmed texts."""
    at = _day(F.col(day))
    missing = F.lit(False)
    for k in keys:
        missing = missing | _blank(k)
    same = F.trim(F.col(team).cast("string")) == F.trim(F.col(opponent).cast("string"))
    absent = _blank(team) | _blank(opponent)
    faults = all_reasons((at.isNull(), "INVALID_DATE"), (at >= F.lit(target).cast("date"), "D1_LEAKAGE"), (missing, "MISSING_KEY"), (absent, "TEAM_OPPONENT_MISSING"), (~absent & same, "TEAM_EQUALS_OPPONENT"))
    each = rows.select(F.explode(faults).alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))
    named = rows.where(~missing).groupBy(*(F.trim(F.col(k).cast("string")).alias(k) for k in keys)).agg((F.count("*") - 1).alias("more"))
    twice = named.agg(F.sum("more").alias("n")).where("n > 0").select(F.lit("DUPLICATE_KEY").alias("fault"), "n")
    return each.unionByName(twice)


def metadata_fault(target: str | Column) -> Column:
    """The first fault of a snapshot's metadata(contract, target_game_date, cutoff_date, as_of_time, PROVENANCE) for a target day, null for none."""
    day = _day(F.col(target) if isinstance(target, str) else target)
    as_of = F.col("as_of_time").try_cast("timestamp")
    wrong = F.when(F.coalesce(F.col("contract") != "D-1", F.lit(True)), "SNAPSHOT_CONTRACT_NOT_D1")
    wrong = wrong.when(~F.col("target_game_date").eqNullSafe(day.cast("string")), "SNAPSHOT_TARGET_DATE_MISMATCH").when(~F.col("cutoff_date").eqNullSafe(F.date_sub(day, 1).cast("string")), "SNAPSHOT_CUTOFF_MISMATCH")
    wrong = wrong.when(as_of.isNull(), "SNAPSHOT_AS_OF_INVALID").when(F.to_date(F.substring(F.trim("as_of_time"), 1, 10)) != F.date_sub(day, 1), "SNAPSHOT_AS_OF_DATE_MISMATCH")
    for c in PROVENANCE:
        wrong = wrong.when(_blank(c), f"SNAPSHOT_PROVENANCE_MISSING {c}")
    return wrong


def history_fault() -> Column:
    """The fault of an entity's history(eligible_game_count, history_status): a count is no whole number from 0 on, or the status isn't what it says."""
    n = F.col("eligible_game_count").try_cast("bigint")
    expected = F.when(n > 0, "AVAILABLE").otherwise("ZERO_HISTORY")
    return F.when(n.isNull() | (n < 0), "ENTITY_HISTORY_COUNT_INVALID").when(~F.col("history_status").eqNullSafe(expected), "ENTITY_HISTORY_STATUS_INVALID")


def governance(registry: DataFrame) -> DataFrame:
    """feature_name, code: what each row of a feature registry breaks. Absent columns are a code without a name, and nothing else is judged then.

    Truths are booleans, not texts; an approved baseline must be available before a game, in the past and today,
    checked for leakage and of coverage PASS. A repeated name is a code of every row with it.
    """
    if absent := [c for c in REGISTRY if c not in registry.columns]:
        return registry.sparkSession.createDataFrame([(None, f"MISSING_COLUMN {c}") for c in absent], "feature_name string, code string")
    registry = registry.withColumn("_copies", F.count("*").over(W.partitionBy("feature_name")))
    kinds = dict(registry.dtypes)
    truth = {c: F.col(c) if kinds[c] == "boolean" else F.lit(None).cast("boolean") for c in ("pregame_available", "historical_available", "today_available", "leakage_checked")}
    approved = F.coalesce(F.col("research_status") == "APPROVED_BASELINE", F.lit(False))
    no = lambda c: approved & (c == F.lit(False))
    codes = all_reasons(
        (_blank("feature_name"), "FEATURE_NAME_BLANK"),
        (~_blank("feature_name") & (F.col("_copies") > 1), "FEATURE_NAME_REPEATED"),
        (~F.coalesce(F.col("research_status").isin(*STATUSES), F.lit(False)), "RESEARCH_STATUS_INVALID"),
        (~F.coalesce(F.col("coverage_status").isin(*COVERAGES), F.lit(False)), "COVERAGE_STATUS_INVALID"),
        *((t.isNull(), f"{c.upper()}_NOT_BOOLEAN") for c, t in truth.items()),
        (no(truth["pregame_available"]), "APPROVED_NOT_PREGAME"),
        (no(truth["historical_available"]), "APPROVED_NOT_HISTORICAL"),
        (no(truth["today_available"]), "APPROVED_NOT_TODAY"),
        (no(truth["leakage_checked"]), "APPROVED_NOT_LEAKAGE_CHECKED"),
        (approved & ~F.col("coverage_status").eqNullSafe("PASS"), "APPROVED_WITHOUT_COVERAGE"),
    )
    return registry.select("feature_name", F.explode(codes).alias("code"))


def profile(rows: DataFrame, required: Sequence[str], game: str, player: str) -> DataFrame:
    """metric, value of a source table: rows, columns, full rows repeated, null rates, different games and players, games without exactly
    two rows, repeated player games; an absent required column is a metric of its own."""
    there = [c for c in required if c in rows.columns]
    one = rows.agg(F.count("*").alias("rows"), *(F.avg(F.col(c).isNull().cast("double")).alias(f"null_rate_{c}") for c in there), F.count_distinct(game).alias("unique_games"), F.count_distinct(player).alias("unique_players"))
    metrics = [c for c in one.columns]
    out = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics))).alias("m")).select("m.*")
    surplus = lambda keys, name: rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    pairs = rows.where(F.col(game).isNotNull()).groupBy(game).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") != 2).cast("double").alias("value")).select(F.lit("games_not_exactly_two_rows").alias("metric"), "value")
    fixed = rows.sparkSession.createDataFrame([("columns", float(len(rows.columns))), *((f"missing_column_{c}", 1.0) for c in required if c not in rows.columns)], "metric string, value double")
    for more in (fixed, surplus(rows.columns, "duplicate_full_rows"), surplus([player, game], "duplicate_player_game_keys"), pairs):
        out = out.unionByName(more)
    return out


def prior_history(rows: DataFrame, player: str, day: str, value: str) -> DataFrame:
    """rows with n_prior (rows of strictly earlier days of the player), last_prior (the latest of those days), prior_mean (of value, null
    where one of them has none) and same_day (whether the player has another row that day)."""
    one = W.partitionBy(player).orderBy(F.unix_date(day)).rangeBetween(W.unboundedPreceding, -1)
    whole = F.count(value).over(one) == F.count("*").over(one)
    out = rows.withColumns({"n_prior": F.count("*").over(one), "last_prior": F.max(day).over(one), "prior_mean": F.when(whole, F.avg(value).over(one))})
    return out.withColumn("same_day", F.count("*").over(W.partitionBy(player, day)) > 1)
