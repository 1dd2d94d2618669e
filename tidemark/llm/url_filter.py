"""URL filter: host and path rules first, then a path-template tree per host.

The tree is built level by level, down to the longest path. A segment with less than MIN_SHARE of its parent's
pages and fewer than PRIOR labelled ones, which its host's prior outweighs, is variable and becomes the wildcard;
any other branch whose labelled purity doesn't differ from its siblings' (two-proportion z below MERGE_Z) is merged
into the wildcard too. A template is rejected by its share of bad labelled pages,
smoothed towards its host's, which is smoothed towards the whole table's.

Result rules: the host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path
follows up to `?`, `#` or the end. Both are empty where url is null or has no `://`; such pages have no rule and
the template of the empty host. Repeated rows are judged alike. Unlabelled pages shape the tree but not purity.
Other columns of the input are ignored.

The SQL of op4_url_filter stops at DEPTH levels, the last one the rest of the path, and judges no branch under
MIN_SHARE; it gives the same rows only where paths have no more levels and no such branch has PRIOR labels.

At scale: only page_id, host and path are shuffled, never html; counts are combined before each shuffle. A node
keeps at most 1 / MIN_SHARE branches and one for each PRIOR labels; Spark broadcasts them only below its
own size limit and otherwise joins two written tables, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.natives import ascii_lower
from tidemark.llm.worktables import save

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DEPTH = 5
MIN_SHARE = 0.05
MERGE_Z = 1.96
PRIOR = 10.0
REJECT = 0.5


def host_of(url: str) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def templates(pages: DataFrame) -> DataFrame:
    """pages(host, path, bad) with template; bad: 1, 0, or null without a label."""
    pages = pages.withColumn("template", F.lit(""))
    parts, level = F.split("path", "/"), 0
    while True:
        level += 1
        pages = pages.withColumn("segment", F.get(parts, F.lit(level)))
        sums = (F.count("*").alias("n"), F.count("bad").alias("seen"), F.coalesce(F.sum("bad"), F.lit(0)).alias("worse"))
        children = save(pages.where("segment is not null").groupBy("host", "template", "segment").agg(*sums), "branches")
        parents = save(children.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("seen").alias("all_seen"), F.sum("worse").alias("all_worse")), "nodes")
        if parents.where("all_worse > 0 and all_worse < all_seen").isEmpty():  # no branch can differ here or below
            rest = F.expr(f"repeat('/*', greatest(size(split(path, '/')) - {level}, 0))")
            return pages.withColumn("template", F.concat("template", rest)).drop("segment")
        both = children.join(parents, ["host", "template"]).where((F.col("n") >= MIN_SHARE * F.col("all_n")) | (F.col("seen") >= PRIOR))
        others = F.col("all_seen") - F.col("seen")
        pooled = F.try_divide("all_worse", "all_seen")
        gap = F.try_divide("worse", "seen") - F.try_divide(F.col("all_worse") - F.col("worse"), others)
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), "seen") + F.try_divide(F.lit(1.0), others)))
        differs = F.coalesce(F.try_divide(F.abs(gap), error) >= MERGE_Z, F.lit(False))
        own = save(both.where(differs).select("host", "template", "segment", F.lit(True).alias("own")), "kept_branches")
        pages = pages.join(own, ["host", "template", "segment"], "left")
        step = F.when(F.col("segment").isNull(), "").when(F.col("own"), F.concat(F.lit("/"), "segment")).otherwise("/*")
        pages = pages.withColumn("template", F.concat("template", step)).drop("segment", "own")
        if level % DEPTH == 0:
            pages = save(pages, "levels")


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """A row for each row of pages(page_id, url): page_id, host, path, rule, verdict, template, badness.

    labelled: page_id, bad (1 or 0); where a page_id has several rows, any bad one counts.
    """
    known = labelled.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = save(pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path")).join(known, "page_id", "left"), "urls")
    placed = save(templates(seen), "placed")
    sums = (F.count("bad").alias("seen"), F.coalesce(F.sum("bad"), F.lit(0)).alias("worse"))
    by_template = save(placed.groupBy("host", "template").agg(*sums), "by_template")
    by_host = by_template.groupBy("host").agg(F.sum("seen").alias("host_seen"), F.sum("worse").alias("host_worse"))
    total = by_template.agg(F.coalesce(F.try_divide(F.sum("worse"), F.sum("seen")), F.lit(0.0)).alias("rate")).first()[0]
    host_rate = (F.col("host_worse") + PRIOR * F.lit(float(total))) / (F.col("host_seen") + PRIOR)
    badness = (F.col("worse") + PRIOR * host_rate) / (F.col("seen") + PRIOR)
    scored = save(by_template.join(by_host, "host").select("host", "template", badness.alias("badness")), "scored")
    rule, verdict = rule_of(rules)
    return placed.join(scored, ["host", "template"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("badness") >= REJECT, "block").otherwise("allow")).alias("verdict"), "template", "badness"
    )
