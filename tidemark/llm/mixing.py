"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, -ln(u) / quality weight, with u from a digest of its doc_id, so reruns
agree. A source's target decides how many whole epochs it gives; the fraction that remains is filled in key
order: documents are sorted within the source and prefix-summed up to the budget.

Result rules: a size is the number of words [^\\x20\\x09-\\x0D]+ (null text: 0). Sources weigh by code point
order, null last. The document at the budget's edge is taken if more than half of it fits. Rows with equal
doc_id draw equal keys and are taken or left on their own; a null doc_id draws the key of the empty string.
An empty table gives an empty mix. Other columns of the input pass through untouched.

At scale: keys fall into BINS ranges a source, whose sums (at most BINS rows a source) are prefix-summed first;
only the one range at the edge of each budget is sorted, so a source with a third of all rows is no task of
its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.natives import word_count, word_line
from tidemark.llm.worktables import save

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BINS = 4096
#: quality weights of documents labelled good, labelled bad, and not labelled
GOOD, BAD, UNKNOWN = 1.0, 0.25, 0.75


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight: of labelled documents; the best label counts where there are several."""
    best = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return best.select("doc_id", F.when(F.col("q") == 1, GOOD).when(F.col("q") == 0, BAD).otherwise(UNKNOWN).alias("weight"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes(source, source_size) with target: share of all words by weight, none above most times its size.

    What a capped source gives up is reshared by weight. Sources sorted by cap over weight are capped up to a
    level, found from prefix sums over the table of sources.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    level = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = level.rowsBetween(W.unboundedPreceding, -1)
    after = level.rowsBetween(W.currentRow, W.unboundedFollowing)
    s = s.withColumn("at", (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("first", F.when(F.col("at") <= F.col("cap") / F.col("w"), F.row_number().over(level)))
    s = s.withColumn("line", F.min_by("at", "first").over(whole))
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("line") * F.col("w"), F.col("cap"))).alias("target"))


def mix_sources(documents: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row for each row of documents: doc_id, source, text_key, size, source_size, target, copies, taken.

    quality: doc_id, weight (above 0, one row a doc_id); other documents weigh UNKNOWN. copies: times that the
    mix takes the document; text_key: xxhash64 of the text, to tell rows of one doc_id apart.
    """
    docs = documents.select("doc_id", "source", F.xxhash64("text").alias("text_key"), word_count(word_line("text")).alias("size"))
    if quality is not None:
        docs = docs.join(quality.select("doc_id", "weight"), "doc_id", "left")
    else:
        docs = docs.withColumn("weight", F.lit(None).cast("double"))
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    docs = docs.withColumn("key", -F.log(u) / F.coalesce("weight", F.lit(UNKNOWN)))
    docs = docs.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(BINS * (1 - F.exp(-F.col("key")))).cast("int")))
    docs = save(docs.select("doc_id", "source", "text_key", "size", "key", "bin"), "keys")

    bins = save(docs.groupBy("source", "bin").agg(F.sum("size").alias("sum")), "bins")
    plan = targets(bins.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.try_divide("target", "source_size"))).otherwise(0).cast("long")
    plan = save(plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "plan")
    upto = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("sum").over(upto), F.lit(0)))
    bins = bins.alias("b").join(plan.alias("p"), F.expr("b.source <=> p.source")).select(
        F.col("b.source").alias("s"),
        F.col("bin").alias("k"),
        "before",
        "source_size",
        "target",
        "epochs",
        "rest",
        F.when(F.col("rest") <= 0, 0).when(F.col("before") + F.col("sum") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), 0).alias("picked"),
    )
    bins = save(bins, "ranges")
    docs = docs.join(bins, F.expr("source <=> s and bin = k")).drop("s", "k")
    edge = W.partitionBy("source").orderBy("key", "doc_id", "text_key").rowsBetween(W.unboundedPreceding, -1)
    edges = docs.where("picked is null").withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(edge), F.lit(0)))
    edges = edges.withColumn("picked", (2 * F.col("before") + F.col("size") <= 2 * F.col("rest")).cast("int"))
    docs = docs.where("picked is not null").unionByName(edges)
    docs = docs.withColumn("copies", F.col("epochs") + F.col("picked"))
    return docs.select("doc_id", "source", "text_key", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
