"""Joins and folds in time: as-of versions, memberships, interval sweeps, carried state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def month(at: Column) -> Column:
    """A stretch of time for the functions below: long enough to be few for a key, short enough for one task."""
    return F.date_trunc("month", at)


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: Sequence[str], tie: str, stretch: Callable[[Column], Column] = month) -> DataFrame:
    """left with values of the latest right row of its key whose time isn't later; the greatest tie wins.

    Both sides are laid in one order and the last right row is carried on, so a key's rows are never multiplied. They are
    sorted by stretch of time; what a stretch leaves to the next is carried over one row a stretch, so a key with a third
    of all rows is many tasks.
    """
    packed = F.struct(F.col(right_time).alias("t"), F.col(tie).alias("tie"), *(F.col(v) for v in values))
    r = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), packed.alias("_value"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"))
    n = left.select(F.col(key), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_value"].dataType).alias("_value"), F.struct(*left.columns).alias("_row"))
    both = r.unionByName(n).withColumn("_stretch", stretch(F.col("_t")))
    ends = both.groupBy(key, "_stretch").agg(F.max_by("_value", F.when(F.col("_side") == 0, F.struct("_t", F.col("_value.tie")))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(W.partitionBy(key).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1))
    carried_on = ends.select(F.col(key).alias("_k"), F.col("_stretch").alias("_s"), before.alias("_before"))
    w = W.partitionBy(key, "_stretch").orderBy("_t", "_side", F.col("_value.tie")).rowsBetween(W.unboundedPreceding, W.currentRow)
    held = both.withColumn("_within", F.last("_value", ignorenulls=True).over(w)).where("_side = 1")
    held = held.join(carried_on, F.col(key).eqNullSafe(F.col("_k")) & F.col("_stretch").eqNullSafe(F.col("_s")), "left").withColumn("_last", F.coalesce("_within", "_before"))
    return held.select("_row.*", *(F.col(f"_last.{v}").alias(v) for v in values))


def half_open(day: Column, start: Column, end: Column) -> Column:
    """start <= day < end, open where end is null."""
    return (day >= start) & (end.isNull() | (day < end))


def closed(day: Column, start: Column, end: Column) -> Column:
    """start <= day <= end."""
    return (day >= start) & (day <= end)


def memberships(rows: DataFrame, key: str, member: str, day: str) -> DataFrame:
    """Validity intervals [valid_from, valid_to) of what a key was a member of, from dated observations."""
    w = W.partitionBy(key).orderBy(day)
    daily = rows.groupBy(key, day).agg(F.min(member).alias(member))
    changed = daily.withColumn("_before", F.lag(member).over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col(member)))
    return changed.select(key, member, F.col(day).alias("valid_from"), F.lead(day).over(w).alias("valid_to"))


def active_counts(intervals: DataFrame, key: str, start: str, end: str, stretch: Callable[[Column], Column] = month) -> DataFrame:
    """Running number of active half-open intervals after each moment, by a sweep over their ends.

    Ends are summed up by moment, then by stretch of time: a stretch starts from the running sum of those before it, so no
    task sorts all moments of a key.
    """
    ends = intervals.select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))).alias("e"))
    steps = ends.where("e.at is not null").groupBy(key, F.col("e.at").alias("moment")).agg(F.sum("e.step").alias("step")).withColumn("_stretch", stretch(F.col("moment")))
    whole = steps.groupBy(key, "_stretch").agg(F.sum("step").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(key).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    steps = steps.join(whole.select(key, "_stretch", before.alias("_before")), [key, "_stretch"])
    return steps.select(key, "moment", (F.col("_before") + F.sum("step").over(W.partitionBy(key, "_stretch").orderBy("moment"))).alias("active"))


def carried(rows: DataFrame, scope: str, order: str, fields: dict[str, Column], resets: dict[str, Sequence[str]]) -> DataFrame:
    """Each field's latest value within scope; a field is forgotten whenever one of the fields it resets on is set."""
    w = W.partitionBy(scope).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    for name, value in fields.items():
        rows = rows.withColumn(f"_{name}", value)
    for name in fields:
        on = [F.col(f"_{r}").isNotNull() for r in resets.get(name, ())]
        group = sum((F.sum(c.cast("int")).over(w) for c in on), F.lit(0))
        rows = rows.withColumn(f"_g_{name}", group)
    for name in fields:
        in_group = W.partitionBy(scope, f"_g_{name}").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
        rows = rows.withColumn(name, F.last(f"_{name}", ignorenulls=True).over(in_group))
    return rows.drop(*(f"_{n}" for n in fields), *(f"_g_{n}" for n in fields))


def reversals(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value is below the one before."""
    before = F.lag(value, 1).over(W.partitionBy(key).orderBy(order))
    return rows.withColumn("before", before).where(F.col(value) < F.col("before"))


def around(rows: DataFrame, key: str, order: str, anchor: Column, reach: int) -> DataFrame:
    """Rows within reach places of an anchor row of their key."""
    near = F.max(anchor.cast("int")).over(W.partitionBy(key).orderBy(order).rowsBetween(-reach, reach))
    return rows.withColumn("near", near).where("near = 1").drop("near")


def snapshot(games: DataFrame, entities: DataFrame, day: str) -> DataFrame:
    """Each expected entity's history of strictly earlier days, with an explicit status where there is none."""
    past = games.where(F.col("event_date") < F.lit(day).cast("date")).groupBy("entity_id").agg(F.count("*").alias("games"), F.max("event_date").alias("last_date"))
    out = entities.join(past, "entity_id", "left").withColumn("games", F.coalesce("games", F.lit(0)))
    return out.withColumn("status", F.when(F.col("games") == 0, "ZERO_HISTORY").otherwise("OK"))


def dated_support(rows: DataFrame, members: DataFrame, key: str, day: str, claim: str) -> DataFrame:
    """rows with supports and conflicts (0 or 1): whether the memberships of their key that hold their day, both ends in, say
    what the row claims or something else. Rows that no membership holds are left out.

    members(key, member, valid_from, valid_to) is as memberships() gives it, so a day meets the latest one, and the one before
    only on the very day of a change: rows are carried along their key and never meet all of its memberships. One that
    hasn't ended holds no day yet.
    """
    w = W.partitionBy(key).orderBy("valid_from")
    known = members.select(key, F.when(F.col("valid_to").isNotNull(), F.col("member")).alias("_member"), "valid_from", F.lag("member").over(w).alias("_before"))
    out = as_of(rows, known, key, day, "valid_from", ["_member", "valid_from", "_before"], "valid_from")
    out = out.withColumn("_before", F.when(F.col(day) == F.col("valid_from"), F.col("_before"))).where("_member is not null or _before is not null")
    says = lambda f: F.greatest(*(F.coalesce(f(F.col(m)), F.lit(False)) for m in ("_member", "_before"))).cast("int")
    return out.withColumns({"supports": says(lambda m: m == F.col(claim)), "conflicts": says(lambda m: m != F.col(claim))}).drop("_member", "valid_from", "_before")


def ledger(captures: DataFrame, digest: str, order: str) -> DataFrame:
    """An append log with what each capture repeats: SUCCESS for a digest's first, DUPLICATE with the first's number.

    The first of a digest is found by partial aggregation, so one that repeats without end is no task of its own.
    """
    first = captures.groupBy(F.col(digest).alias("_digest")).agg(F.min(order).alias("_first"))
    out = captures.join(first, F.col(digest).eqNullSafe(F.col("_digest"))).drop("_digest")
    repeat = F.col(order) != F.col("_first")
    return out.withColumns({"outcome": F.when(repeat, "DUPLICATE").otherwise("SUCCESS"), "duplicate_of": F.when(repeat, F.col("_first"))}).drop("_first")
