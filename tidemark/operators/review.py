"""Integrity and agreement between records that should tell the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows under a name that are gathered in one block, and of those how many meet 8 times as many entries at once; fixed values
BLOCK, FEW = 4096, 32


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_left, n_right, status. Both sides are counted by key before they meet, so no key multiplies."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = count(left, "n_left").join(count(right, "n_right"), list(keys), "full")
    status = F.when(F.col("n_left").isNull(), "RIGHT_ONLY").when(F.col("n_right").isNull(), "LEFT_ONLY")
    return both.withColumn("status", status.when((F.col("n_left") > 1) | (F.col("n_right") > 1), "DUPLICATE").otherwise("ONE_TO_ONE"))


def named(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """rows(name, team) with status and id from registry(name, id, team): a name resolves to exactly one id, whose
    team must be among those of the registry.

    The registry's teams are checked by a semi-join, never gathered by name.
    """
    ids = registry.groupBy("name").agg(F.count_distinct("id").alias("_n"), F.min("id").alias("id"))
    teams = registry.select("name", "team").distinct().withColumn("_same", F.lit(True))
    out = rows.join(ids, "name", "left").join(teams, ["name", "team"], "left")
    status = F.when(F.col("_n").isNull(), "NO_ID").when(F.col("_n") > 1, "SEVERAL_IDS").when(F.col("_same"), "MATCHED").otherwise("TEAM_CONFLICT")
    return out.withColumn("status", status).withColumn("id", F.when(F.col("_n") == 1, F.col("id"))).drop("_n", "_same")


def under_any_name(rows: DataFrame, names: str, entries: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Distinct `keep` of rows and entries(name) where one of the row's names is the entry's.

    Rows and entries under a name are dealt to blocks, and each two blocks meet in a cell of their own, so no name is
    gathered in one task. A pair with several names in common is left to the first of them, so none is shuffled to be
    told apart.
    """
    left, right = [c for c in keep if c in rows.columns], [c for c in keep if c not in rows.columns]
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def listed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        sets = df.where("name is not null").select(F.struct(*columns).alias("_row"), "name").groupBy("_row").agg(F.array_sort(F.collect_set("name")).alias("_names"))
        each = sets.select("_row", "_names", F.explode("_names").alias("name"))
        return each.select("_row", "name", F.filter("_names", lambda x: x < F.col("name")).alias("_before"))

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("name").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias(name))

    def gathered(df: DataFrame, n: str, at: str, *more: str) -> DataFrame:
        dealt = df.join(F.broadcast(large), "name", "left").withColumns({c: F.coalesce(c, one) for c in ("_l_n", "_r_n")})
        return dealt.groupBy("name", *more, F.pmod(F.xxhash64("_row"), F.col(n)).alias(at), "_before").agg(F.collect_list("_row").alias("_rows"))

    def parts(of: str, size: int) -> Column:
        return F.explode(F.transform(F.sequence(zero, F.floor(F.greatest(F.size(of) - 1, zero) / size)), lambda i: F.slice(of, (i * size + 1).cast("int"), size)))

    every = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    l, r = listed(rows.withColumn("name", F.explode(names)), left), listed(entries, right)
    # only names of several blocks: at most one for each BLOCK rows of either side
    large = count(l, "_l_n").join(count(r, "_r_n"), "name", "full").where("_l_n > 1 or _r_n > 1").select("name", *(F.coalesce(c, one).alias(c) for c in ("_l_n", "_r_n")))
    l = gathered(l, "_l_n", "_l_at", "_r_n").withColumn("_r_at", every("_r_n"))
    l = l.select("name", "_l_at", "_r_at", "_before", parts("_rows", FEW).alias("_rows"))
    r = gathered(r, "_r_n", "_r_at", "_l_n").groupBy("name", "_r_at", "_l_n").agg(F.collect_list(F.struct("_before", "_rows")).alias("_classes")).withColumn("_l_at", every("_l_n"))
    # small tables that become a large one: a fixed number of parts, which isn't cut down by their size; several a core, as cells differ in size
    spark, cell = rows.sparkSession, ["name", "_l_at", "_r_at"]
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    met = l.repartition(spread, *cell).join(r.repartition(spread, *cell), cell)
    first = F.filter("_classes", lambda c: ~F.arrays_overlap(c["_before"], F.col("_before")))
    met = met.select("_rows", F.flatten(first["_rows"]).alias("_entries"))
    # whole-stage code holds all pairs that come of one row, so these are few
    met = met.select("_rows", parts("_entries", 8 * FEW).alias("_entries")).select(F.explode("_rows").alias("_a"), "_entries")
    return met.select(*(F.col(f"_a.{c}") for c in left), F.inline("_entries")).select(*keep)


def agreement(rows: DataFrame, key: str, reading: str, readings: Sequence, value: str) -> DataFrame:
    """key, agreement: whether a value is told by all readings, by two, or by one only; MISSING if a reading is.

    Readings are counted for each value first, so a key is summed up from its values.
    """
    told = F.bit_or(F.when(F.col(reading) == readings[0], 1).otherwise(0))
    for i, r in enumerate(readings[1:], 1):
        told = told + F.bit_or(F.when(F.col(reading) == r, 1 << i).otherwise(0))
    each = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(told.alias("_told"))
    out = each.groupBy(key).agg(F.bit_or("_told").alias("_any"), F.max(F.bit_count("_told")).alias("_most"))
    kind = F.when(F.col("_any") != (1 << len(readings)) - 1, "MISSING").when(F.col("_most") == len(readings), "ALL_AGREE")
    return out.select(key, kind.when(F.col("_most") > 1, "TWO_AGREE").otherwise("NONE_AGREE").alias("agreement"))


def backed(rows: DataFrame, others: DataFrame, key: str, row_id: str, value: str, within: float) -> DataFrame:
    """rows with `backed`: whether one of others with the key has a value less than `within` away.

    Values meet by cells `within` wide, each row looking into its own and the two beside it: an equi-join whose
    work follows the rows near each other, not all of a key.
    """
    cell = F.floor(F.col(value) / within)
    near = rows.select(key, row_id, F.col(value).alias("_v"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    there = others.select(key, F.col(value).alias("_w"), cell.alias("_cell"))
    found = near.join(there, [key, "_cell"]).where(F.abs(F.col("_v") - F.col("_w")) < within).select(row_id).distinct().withColumn("backed", F.lit(True))
    return rows.join(found, row_id, "left").withColumn("backed", F.coalesce("backed", F.lit(False)))


def all_reasons(*checks: tuple[Column, str]) -> Column:
    """The names of all checks that hold, in their order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in checks)))


def paired(rows: DataFrame, keys: Sequence[str], method: str, methods: int, actual: str, tolerance: float = 1e-7) -> DataFrame:
    """One row of counts: keys, keys without one row of each method, keys whose actual values differ."""
    by = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(method).alias("d"), (F.max(actual) - F.min(actual)).alias("spread"))
    return by.agg(F.count("*").alias("n_pairs"), F.count_if((F.col("n") != methods) | (F.col("d") != methods)).alias("n_unpaired"), F.count_if(F.col("spread") > tolerance).alias("n_actuals_differ"))
