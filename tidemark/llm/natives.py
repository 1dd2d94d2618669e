"""Column expressions shared by the operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bits of the map in screened(): 8 MB
SCREEN_BITS = 1 << 26


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def word_line(text: str | Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, joined by one space; null has none."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def word_count(line: str | Column) -> Column:
    """Words in a word_line."""
    line = F.col(line) if isinstance(line, str) else line
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("long")


def screened(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose column may be among keys, ahead of a join on it: none is missed, few others stay.

    What goes to every task is a bitmap of SCREEN_BITS hashed values, the same size for any number of keys; far
    more keys than bits only let more rows through.
    """
    spot = F.pmod(F.xxhash64(F.lit(1), column), F.lit(SCREEN_BITS))
    bits = keys.groupBy(F.bitmap_bucket_number(spot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("_bits"))
    at = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("_bucket", F.bitmap_bucket_number(spot)).join(F.broadcast(bits), "_bucket")  # at most SCREEN_BITS / 32768 + 1 rows of 4 KB
    return marked.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("_bucket", "_bits")


def row_keys(*columns: str) -> list[Column]:
    """key and more: 96 bits that tell rows with different columns apart."""
    return [F.xxhash64(*columns).alias("key"), F.hash(*columns).alias("more")]
