"""Validation: every rule becomes a column, every violation a row; nothing is dropped silently."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    column: str
    nullable: bool = False
    least: float | None = None
    most: float | None = None
    allowed: tuple[str, ...] | None = None

    def codes(self) -> list[Column]:
        c = F.col(self.column)
        found = [] if self.nullable else [F.when(c.isNull(), "NULL_NOT_ALLOWED")]
        if self.least is not None:
            found.append(F.when(c < self.least, "VALUE_BELOW_MINIMUM"))
        if self.most is not None:
            found.append(F.when(c > self.most, "VALUE_ABOVE_MAXIMUM"))
        if self.allowed is not None:
            found.append(F.when(~c.isin(*self.allowed), "VALUE_NOT_ALLOWED"))
        return [F.struct(F.lit(self.column).alias("column"), code.alias("code")) for code in found]


def missing_columns(df: DataFrame, rules: Sequence[Rule]) -> list[tuple[str, str]]:
    """Schema issues: absent columns and columns the contract doesn't know."""
    named = {r.column for r in rules}
    return [(c, "MISSING_COLUMN") for c in sorted(named - set(df.columns))] + [(c, "SCHEMA_DRIFT_EXTRA_COLUMN") for c in df.columns if c not in named]


def violations(df: DataFrame, rules: Sequence[Rule], key: Sequence[str]) -> DataFrame:
    """A row for each broken rule: the key, column, code."""
    all_codes = F.array(*(s for r in rules if r.column in df.columns for s in r.codes()))
    return df.select(*key, F.explode(F.filter(all_codes, lambda s: s["code"].isNotNull())).alias("v")).select(*key, "v.column", "v.code")


def enforce(found: DataFrame) -> None:
    """Fail closed: raise with the first violations."""
    if rows := found.take(5):
        raise ValueError(f"contract violated: {[r.asDict() for r in rows]}")


def duplicates(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows after the first of their key, with their number."""
    return df.withColumn("copy", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("copy > 1")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    each = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns), *(F.countDistinct(c).alias(f"{c}_distinct") for c in columns))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("null_rate"), F.col(f"{c}_distinct").alias("n_distinct")) for c in columns))).alias("x")
    return each.select(cells).select("x.*")


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts of rows that only one side has, repeats included; both 0 for equal sets."""
    only = lambda a, b, name: a.exceptAll(b).agg(F.count("*").alias(name))
    return only(left, right, "only_left").join(only(right, left, "only_right"))


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), "|").alias("values")).where("n_values > 1")


@dataclass(frozen=True)
class Typed(Rule):
    """A rule with the declared type of a column that may come as text: string, bigint, double, boolean, date or timestamp."""

    kind: str = "string"

    def value(self, df: DataFrame) -> Column:
        """The column as its type; null where it has none."""
        c = F.col(self.column)
        if df.schema[self.column].dataType.simpleString() != "string" or self.kind == "string":
            return c.try_cast(self.kind)
        return F.trim(c).try_cast(self.kind)

    def found(self, df: DataFrame) -> list[Column]:
        """Codes in order; what isn't of the type is not judged further."""
        raw, value = F.col(self.column), self.value(df)
        numeric = self.kind in ("bigint", "double")
        blank = raw.isNull() | (F.isnan(raw) if df.schema[self.column].dataType.simpleString() in ("double", "float") else F.lit(False))
        of_kind = ~blank & value.isNotNull()
        codes = [] if self.nullable else [F.when(blank, "NULL_NOT_ALLOWED")]
        codes.append(F.when(~blank & value.isNull(), "TYPE_MISMATCH"))
        if self.allowed is not None:
            codes.append(F.when(of_kind & ~value.cast("string").isin(*self.allowed), "VALUE_NOT_ALLOWED"))
        if numeric and self.least is not None:
            codes.append(F.when(of_kind & (value < self.least), "VALUE_BELOW_MINIMUM"))
        if numeric and self.most is not None:
            codes.append(F.when(of_kind & (value > self.most), "VALUE_ABOVE_MAXIMUM"))
        return codes


def checked(df: DataFrame, rules: Sequence[Typed], key: Sequence[str] = (), order: Sequence[str] = (), extras: bool = False) -> DataFrame:
    """df with issues (code, column) and validation_status, PASS or QUARANTINED; no row is dropped.

    Every row names the columns that the table lacks and, unless extras are allowed, those the contract doesn't know. A
    row whose whole key is given and was seen before, in `order`, is a DUPLICATE_PRIMARY_KEY.
    """
    issue = lambda code, column: F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit(column).alias("column")))
    codes = [issue(F.lit(code), c) for c, code in missing_columns(df, rules) if code == "MISSING_COLUMN" or not extras]
    codes += [issue(code, r.column) for r in rules if r.column in df.columns for code in r.found(df)]
    if key and all(k in df.columns for k in key):
        whole = F.lit(True)
        for k in key:
            whole = whole & F.col(k).isNotNull()
        nth = F.row_number().over(W.partitionBy(*key).orderBy(*(order or key)))
        codes.append(issue(F.when(whole & (nth > 1), "DUPLICATE_PRIMARY_KEY"), "|".join(key)))
    out = df.withColumn("issues", F.array_compact(F.array(*codes)))
    return out.withColumn("validation_status", F.when(F.size("issues") == 0, "PASS").otherwise("QUARANTINED"))


def quarantined(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of checked() that pass, without their marks, and those that don't, with them."""
    return rows.where("validation_status = 'PASS'").drop("issues", "validation_status"), rows.where("validation_status <> 'PASS'")
