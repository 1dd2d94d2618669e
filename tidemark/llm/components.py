"""Connected components of an edge table: by alternating large and small stars, or in one task where the edges are few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.worktables import save

#: edges that one task takes, 1.6 MB; more of them are worked on by stars
FEW = 100_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u and root of all nodes of at most FEW edges."""
    ends = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not ends:
        return
    u, v = (np.concatenate(x) for x in zip(*ends, strict=True))
    nodes, spot = np.unique(np.concatenate([u, v]), return_inverse=True)
    up, a, b = np.arange(len(nodes)), spot[: len(u)], spot[len(u) :]
    while (up[a] != up[b]).any():
        np.minimum.at(up, np.maximum(up[a], up[b]), np.minimum(up[a], up[b]))
        while (up[up] != up).any():
            up = up[up]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[up])], names=["u", "root"])


def _is_stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then v is the least node of its component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
    return odd.isEmpty()


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """edges(a, b) of longs, in any direction, repeats allowed. Returns u, root for every node with an edge,
    root the least node it reaches.

    Each round rewrites the edges towards least neighbours and needs two aggregations and two joins of written
    tables; components of n nodes need on the order of log n rounds, stars around their least node none. Only
    one truth value a round comes to the driver. Up to FEW edges, counted first, are united in one task instead, with
    the same result.
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.count() <= few:
        return now.coalesce(1).mapInArrow(_united, "u long, root long")
    while not _is_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = save(both.groupBy("u").agg(F.min("v").alias("m")), "least").select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = save(large, "large")
        least = save(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = save(small, "edges")
    roots = now.select("u", F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("u"), "root").distinct())


def extended(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """roots(u, root) after more links(a, b); only the components that these touch are worked on."""
    if roots is None:
        return save(components(links), "roots")
    ra, rb = roots.select(F.col("u").alias("a"), F.col("root").alias("p")), roots.select(F.col("u").alias("b"), F.col("root").alias("q"))
    lifted = links.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b"))
    new = save(components(lifted), "joined")
    moved = roots.join(new.select(F.col("u").alias("root"), F.col("root").alias("to")), "root", "left").select("u", F.coalesce("to", "root").alias("root"))
    return save(moved.unionByName(new.join(roots, "u", "left_anti")), "roots")
