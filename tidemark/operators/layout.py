"""Words of a page as lines and lanes, and the clues next to a row.

A page is the unit of work: it holds some hundred words, however many pages there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE_WIDTH = 841.95


def lines(words: DataFrame, page: Sequence[str], y: str, tie: str, tolerance: float, anchor: str = "first") -> DataFrame:
    """words with `line`, from 0 down each page.

    A word opens a line when it lies more than tolerance below the line's anchor: its first word, or its last
    one. Lines on first words depend on all words before, so the heights of a page are folded in order; lines on last
    words are gaps between neighbours. A null y belongs to no line.
    """
    if anchor == "last":
        w = W.partitionBy(*page).orderBy(y, tie)
        opens = (F.col(y) - F.lag(y).over(w) > tolerance).cast("int")
        placed = words.where(F.col(y).isNotNull()).withColumn("_opens", F.coalesce(opens, F.lit(0)))
        out = placed.withColumn("line", F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_opens")
        return out.unionByName(words.where(F.col(y).isNull()).withColumn("line", F.lit(None).cast("long")))

    at = F.col(y).cast("double")
    pages = words.groupBy(*page).agg(F.collect_list(F.struct(at.alias("at"), F.struct(*words.columns).alias("word"))).alias("_w"))
    opened = F.aggregate(
        F.array_sort(F.array_distinct(F.filter(F.transform("_w", lambda w: w["at"]), lambda v: v.isNotNull()))),
        F.array().cast("array<double>"),
        lambda acc, v: F.when((F.size(acc) > 0) & (v - F.try_element_at(acc, F.lit(-1)) <= tolerance), acc).otherwise(F.concat(acc, F.array(v))),
    )
    # the page's fold is a row's column before its words are told apart, so it is done once a page
    folded = pages.select("_w", opened.alias("_opened")).withColumn("_w", F.explode("_w"))
    line = F.size(F.filter("_opened", lambda s: s <= F.col("_w.at"))) - 1
    return folded.select("_w.word.*", F.when(F.col("_w.at").isNotNull(), line).cast("long").alias("line"))


def lane(x: str | Column, width: str | Column, starts: Sequence[tuple[str, float]]) -> Column:
    """The lane that x falls in; starts (name, left edge) ascend and are given for a page PAGE_WIDTH wide."""
    x, width = (F.col(c) if isinstance(c, str) else c for c in (x, width))
    out = F.lit(None).cast("string")
    for name, start in starts:
        out = F.when(x >= F.lit(start) * width / F.lit(PAGE_WIDTH), name).otherwise(out)
    return out


def nearest(rows: DataFrame, page: str, y: str, is_clue: Column, values: Sequence[str]) -> DataFrame:
    """Rows that are no clue, with `values` of the page's nearest clue, named clue_*; of two as near, the upper.

    The clues above and below are carried along the page, so rows never meet every clue.
    """
    order = W.partitionBy(page).orderBy(y)
    clue = F.when(is_clue, F.struct(F.col(y).alias("y"), *(F.col(v) for v in values)))
    rows = rows.withColumn("_clue", clue)
    rows = rows.withColumn("_up", F.last("_clue", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_down", F.first("_clue", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing)))
    up_is_near = F.col("_down").isNull() | (F.col(y) - F.col("_up.y") <= F.col("_down.y") - F.col(y))
    rows = rows.where(F.col("_clue").isNull()).withColumn("_near", F.when(up_is_near, F.col("_up")).otherwise(F.col("_down")))
    return rows.select("*", *(F.col(f"_near.{v}").alias(f"clue_{v}") for v in values)).drop("_clue", "_up", "_down", "_near")


def bands(rows: DataFrame, page: str, y: str) -> DataFrame:
    """rows with the band (upper, lower) that is theirs: half way to the rows before and after, open at the ends."""
    order = W.partitionBy(page).orderBy(y)
    half = lambda other: (F.col(y) + other) / 2
    return rows.withColumn("upper", half(F.lag(y).over(order))).withColumn("lower", half(F.lead(y).over(order)))


SAME_WIDTH = 2.0
GOES_ON = 18.0


def header_lanes(words: DataFrame, names: Sequence[str]) -> DataFrame:
    """words(doc, page, width, x, y, text) below their page's header with the lane they lie in, by the left edges of the header's words.

    A page without a header takes that of the last page before it with one, if their widths differ by SAME_WIDTH at
    most; else its words have no lane. A page's header is a row of a few numbers, carried over the document's pages.
    """
    is_head = F.col("text").isin(*names)
    pages = words.groupBy("doc", "page").agg(
        F.max("width").alias("_width"),
        F.collect_set(F.when(is_head, F.struct(F.col("x"), F.col("text").alias("lane")))).alias("_heads"),
        F.max(F.when(is_head, F.col("y"))).alias("_head_y"),
    )
    own = F.when(F.size("_heads") == len(names), F.struct(F.col("_width").alias("width"), F.array_sort("_heads").alias("heads")))
    last = F.last(own, ignorenulls=True).over(W.partitionBy("doc").orderBy("page").rowsBetween(W.unboundedPreceding, 0))
    pages = pages.withColumn("_h", last)
    usable = F.when(F.abs(F.col("_h.width") - F.col("_width")) <= SAME_WIDTH, F.col("_h.heads"))
    out = words.join(pages.select("doc", "page", usable.alias("_lanes"), "_head_y"), ["doc", "page"])
    left = F.filter("_lanes", lambda h: h["x"] <= F.col("x"))
    out = out.where(F.coalesce(F.col("y") > F.col("_head_y"), F.lit(True)))
    return out.withColumn("lane", F.try_element_at(left, F.lit(-1))["lane"]).drop("_lanes", "_head_y")


def continued(words: DataFrame, reason: str, others: Sequence[str], reach: float = GOES_ON) -> DataFrame:
    """Rows of a page's words with lanes: doc, page, y, a column for each lane. A row of the reason lane alone, within `reach` below
    the row before, goes on with that row's reason."""
    text = lambda lane: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("lane") == lane, F.struct("x", "text")))), lambda w: w["text"]), " "), F.lit(""))
    rows = words.groupBy("doc", "page", "y").agg(*(text(c).alias(c) for c in (*others, reason)))
    w = W.partitionBy("doc", "page").orderBy("y")
    alone = F.greatest(*(F.col(c).isNotNull() for c in others), F.lit(False)) == F.lit(False)
    follows = alone & F.coalesce(F.col("y") - F.lag("y").over(w) <= reach, F.lit(False))
    rows = rows.withColumn("_row", F.sum((~follows).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(reason).isNotNull(), F.struct("y", F.col(reason).alias("t"))))), lambda p: p["t"]), " ")
    return rows.groupBy("doc", "page", "_row").agg(F.min("y").alias("y"), *(F.first(c, True).alias(c) for c in others), F.nullif(parts, F.lit("")).alias(reason)).drop("_row")
