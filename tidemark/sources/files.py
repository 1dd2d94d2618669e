"""Reading CSV and JSON sources that must have a given shape, and writing tables with a manifest."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

MARK = "\ufeff"
#: bytes of a file that its header is looked for in
HEAD = 65536


class SourceError(ValueError):
    """A source that doesn't have its shape; the first word of the message is the code."""


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """The columns of a CSV with header, as strings; a byte order mark is no part of the first name.

    An empty source raises SOURCE_SCHEMA_EMPTY, a missing column SOURCE_SCHEMA_MISSING and, with exact, a column
    too many SOURCE_SCHEMA_EXTRA. Only the header is read here.
    """
    head = spark.read.text(path).limit(1).collect()
    if not head or not head[0][0].lstrip(MARK).strip():
        raise SourceError("SOURCE_SCHEMA_EMPTY")
    names = spark.read.option("header", True).csv(path).columns
    names = [n.lstrip(MARK) for n in names]
    if missing := [c for c in columns if c not in names]:
        raise SourceError(f"SOURCE_SCHEMA_MISSING {','.join(missing)}")
    if exact and (extra := [c for c in names if c not in columns]):
        raise SourceError(f"SOURCE_SCHEMA_EXTRA {','.join(extra)}")
    schema = StructType([StructField(n, StringType()) for n in names])
    return spark.read.schema(schema).options(header=True, enforceSchema=True, mode="PERMISSIVE").csv(path).select(*columns)


def strict_numbers(rows: DataFrame, numbers: Sequence[str], most: dict[str, float]) -> DataFrame:
    """Violations (column, code, n) of rows whose numbers must be given, finite, not negative and at most `most`."""
    checks = []
    for c in numbers:
        value = F.trim(F.col(c)).try_cast("double")
        bad = F.when(F.coalesce(F.trim(c), F.lit("")) == "", "BLANK").when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "NOT_FINITE").when(value < 0, "NEGATIVE")
        if c in most:
            bad = bad.when(value > most[c], "ABOVE_MAXIMUM")
        checks.append(F.struct(F.lit(c).alias("column"), bad.alias("code")))
    found = rows.select(F.explode(F.array(*checks)).alias("v")).select("v.*").where("code is not null")
    return found.groupBy("column", "code").agg(F.count("*").alias("n"))


def write_with_manifest(df: DataFrame, path: str, **facts: str) -> dict:
    """Write df as Parquet, columns in name order, and then its manifest as JSON beside it.

    A path that exists is never overwritten. The manifest comes last, so a table without one is not finished; its
    digest is of the rows, whatever their order or files.
    """
    df = df.select(*sorted(df.columns))
    df.write.mode("errorifexists").parquet(path)
    manifest = {**facts, **logical_digest(df.sparkSession.read.parquet(path)), "columns": df.columns}
    one = df.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
    one.coalesce(1).write.mode("errorifexists").text(f"{path}.manifest")
    return manifest


def read_with_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The table at path if its rows are those that its manifest names, else SourceError DIGEST_MISMATCH."""
    manifest = json.loads(spark.read.text(f"{path}.manifest").first()[0])
    df = spark.read.parquet(path)
    if logical_digest(df) != {k: manifest[k] for k in ("rows", "digest")}:
        raise SourceError("DIGEST_MISMATCH")
    return df


def logical_digest(df: DataFrame) -> dict:
    """Number of rows and a digest that doesn't depend on their order: sums of two hashes of each row as JSON."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    part = lambda at: F.conv(F.substring(F.sha2(row, 256), at, 15), 16, 10).cast("decimal(38,0)")
    got = df.agg(F.count("*").alias("n"), F.sum(part(1)).alias("a"), F.sum(part(16)).alias("b")).first()
    return {"rows": got.n, "digest": f"{got.a or 0}-{got.b or 0}"}


def unnest(rows: DataFrame, column: str, schema: str, *path: str) -> DataFrame:
    """JSON in column, opened along path: each step is a field that holds an array; a row for each last element.

    Other columns stay; what isn't JSON of this schema gives no row.
    """
    rest = [c for c in rows.columns if c != column]
    at = rows.withColumn("_at", F.from_json(column, schema))
    for step in path:
        at = at.select(*rest, F.explode(f"_at.{step}").alias("_at"))
    return at.select(*rest, "_at.*")


def headed_rows(rows: DataFrame, column: str) -> DataFrame:
    """JSON {headers, rowSet} as a map of strings for each row of the set; `whole` tells rows as long as headers."""
    got = rows.withColumn("_t", F.from_json(column, "headers array<string>, rowSet array<array<string>>"))
    got = got.select(*(c for c in rows.columns if c != column), F.col("_t.headers").alias("_h"), F.explode("_t.rowSet").alias("_r"))
    return _mapped(got)


def first_row_heads(rows: DataFrame, column: str) -> DataFrame:
    """JSON array of arrays whose first one names the fields, as headed_rows."""
    got = rows.withColumn("_t", F.from_json(column, "array<array<string>>")).where(F.size("_t") > 0)
    got = got.select(*(c for c in rows.columns if c != column), F.col("_t")[0].alias("_h"), F.explode(F.slice("_t", F.lit(2), F.size("_t"))).alias("_r"))
    return _mapped(got)


def _mapped(rows: DataFrame) -> DataFrame:
    whole = F.size("_h") == F.size("_r")
    return rows.withColumn("whole", whole).withColumn("fields", F.when(whole, F.map_from_arrays("_h", "_r"))).drop("_h", "_r")


def embedded_json(html: str | Column, script_id: str) -> Column:
    """The JSON text of a page's script element with this id; null where there is none."""
    return F.nullif(F.regexp_extract(html, rf'(?s)<script[^>]*\bid="{script_id}"[^>]*>(.*?)</script>', 1), F.lit(""))


def fields_named(json_text: str | Column, name: str) -> Column:
    """All string values of the fields called name at any depth of a JSON text, in order, escapes undone.

    A field is told by its quoted name before a colon, so no recursion over the document is needed.
    """
    raw = F.regexp_extract_all(json_text, F.lit(rf'"{name}"\s*:\s*("(?:[^"\\]|\\.)*")'), 1)
    return F.transform(raw, lambda s: F.from_json(F.concat(F.lit('{"v":'), s, F.lit("}")), "v string")["v"])


def canonical_json(rows: DataFrame, column: str) -> Column:
    """A struct column as compact JSON with the fields of every level in name order, nulls written."""

    def sorted_fields(c: Column, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*(sorted_fields(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))))
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
            return F.transform(c, lambda x: sorted_fields(x, kind.elementType))
        return c

    return F.to_json(sorted_fields(F.col(column), rows.schema[column].dataType), {"ignoreNullFields": "false"})


def _header(first: bytes, strict: bool = False) -> tuple[str, ...]:
    """Names of a CSV's first line."""
    line = first.decode("utf-8-sig", errors="strict" if strict else "ignore").split("\n", 1)[0].rstrip("\r")
    return tuple(next(csv.reader([line]), ()))


def snapshot_scan(spark: SparkSession, path: str, manifest: dict, columns: Sequence[str], numbers: Sequence[str], most: dict[str, float], key: Sequence[str], differ: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of canonical CSV files that a manifest {sha256 of each file by name, row_count} vouches for.

    What the files as a whole break raises SourceError: PARENT_HASH_MISMATCH, INVALID_OR_DUPLICATE_HEADER,
    CANONICAL_SCHEMA_MISMATCH, CANONICAL_CSV_UNREADABLE, MANIFEST_ROW_COUNT_MISMATCH. faults(code, column, n) has what
    single rows break: EXTRA_CSV_VALUES, NULL_CANONICAL_FIELD, INVALID_NUMERIC, OUT_OF_RANGE (negative, not finite or above
    most), DUPLICATE_KEY, SAME_TEAM_AND_OPPONENT (the two columns of differ). rows are texts, trimmed, with numbers as doubles.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha"), F.substring("content", 1, HEAD).alias("head"), "path")
    seen = {r.name: r for r in files.collect()}  # one row a file: its name, digest and first bytes
    if {n: r.sha for n, r in seen.items()} != {n: s.lower() for n, s in manifest["sha256"].items()}:
        raise SourceError("PARENT_HASH_MISMATCH")
    heads = {}
    for name, r in sorted(seen.items()):
        try:
            heads[name] = _header(bytes(r["head"]), strict=len(r["head"]) < HEAD)
        except UnicodeDecodeError as wrong:
            raise SourceError(f"CANONICAL_CSV_UNREADABLE {name}") from wrong
        if not heads[name] or len(set(heads[name])) != len(heads[name]):
            raise SourceError(f"INVALID_OR_DUPLICATE_HEADER {name}")
        if set(heads[name]) != set(columns):
            raise SourceError(f"CANONICAL_SCHEMA_MISMATCH {name}")
    parts = []
    for order in sorted(set(heads.values())):
        named = [r["path"] for n, r in seen.items() if heads[n] == order]
        schema = StructType([StructField(c, StringType()) for c in (*order, "_corrupt")])
        parts.append(spark.read.schema(schema).options(header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").csv(named).select(*columns, "_corrupt"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    if rows.count() != manifest["row_count"]:
        raise SourceError("MANIFEST_ROW_COUNT_MISMATCH")
    value = {c: F.trim(F.col(c)).try_cast("double") for c in numbers}
    blank = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) == "" for c in columns}
    wide = F.col("_corrupt").isNotNull() & ~F.greatest(*blank.values())
    codes = [(wide, "EXTRA_CSV_VALUES", "")]
    codes += [(blank[c], "NULL_CANONICAL_FIELD", c) for c in columns]
    for c in numbers:
        out = F.isnan(value[c]) | (F.abs(value[c]) == float("inf")) | (value[c] < 0) | (value[c] > most.get(c, float("inf")))
        codes += [(~blank[c] & value[c].isNull(), "INVALID_NUMERIC", c), (out, "OUT_OF_RANGE", c)]
    if differ:
        codes.append((F.trim(differ[0]) == F.trim(differ[1]), "SAME_TEAM_AND_OPPONENT", "|".join(differ)))
    found = rows.select(F.explode(F.array_compact(F.array(*(F.when(t, F.struct(F.lit(code).alias("code"), F.lit(c).alias("column"))) for t, code, c in codes)))).alias("f")).select("f.*")
    twice = rows.groupBy(*(F.trim(c).alias(c) for c in key)).count().where("count > 1").select(F.lit("DUPLICATE_KEY").alias("code"), F.lit("|".join(key)).alias("column"), F.explode(F.sequence(F.lit(2).cast("long"), "count"))).drop("col")
    faults = found.unionByName(twice).groupBy("code", "column").agg(F.count("*").alias("n"))
    return rows.select(*(value[c].alias(c) if c in numbers else F.trim(c).alias(c) for c in columns)), faults
