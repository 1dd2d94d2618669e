"""Hard-negative mining: whole score sorts for each anchor, block by block.

An anchor's score of a row is the whole inner product. In each block of rows, all scores of an anchor are sorted by
score (highest first) and id. The first k of the anchor's label are its positives; for each positive a binary search
finds where scores at or under the positive's begin, and the k entries of other labels from there on, down to the
lower limit, are its negatives. A task keeps the best k of its blocks; the tasks' lists are sorted together.

Result rules: rows whose vec_id, label or vector is null, or whose vector has null, NaN or infinite components, take
no part. Anchors are the rows whose vec_id is divisible by `every`; positives are the k best other rows of the label
(fewer, if there are fewer). Negatives satisfy low * positive <= 100 * negative <= 100 * positive, so that a positive
with a score under zero has none. Repeated rows, of the same vec_id too, are rows of their own: each counts, and each
repeated anchor gives its own lines. Vectors shorter than the longest end in zeros. Other columns are ignored.
Components of 32,768 or more, or over 1,024 of them, are refused with an error.

At scale: anchors are a stated query set against all rows. They are taken CHUNK at a time, so that what is sent to
the tasks has a fixed size; a pass over the rows then shuffles k lines for each task, anchor and positive, and no
vector. No rows are gathered by label.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.integer_vectors import finite, matrix, whole, width_of
from tidemark.llm.worktables import save

SCALE, EVERY, SHIFTED, LABELS, K, LOW = 256, 100, 7, 10, 5, 80
#: anchors of a pass, anchors and rows of a block
CHUNK, SOME, BLOCK = 8192, 512, 4096
NONE = np.iinfo(np.int64).min


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products of the rows of a and of b; by way of doubles where those are exact."""
    top = max(1, a.shape[1]) * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if top < 1 << 53 else a @ b.T


def sorted_scores(scores: np.ndarray) -> np.ndarray:
    """Order of each row of scores, highest first, ties by position: rows stand in the order of their ids."""
    n = scores.shape[1]
    if np.abs(scores).max(initial=0) < (1 << 62) // max(n, 1):  # score and position as one number
        key = np.arange(n) - scores * n
        key.sort(axis=1)
        return key % n
    return np.lexsort((np.broadcast_to(np.arange(n), scores.shape), -scores), axis=1)


class Best:
    """The k best (score, id) of each slot so far; the smaller id breaks ties."""

    def __init__(self, slots: int, k: int):
        self.score, self.id = np.full((slots, k), NONE), np.zeros((slots, k), np.int64)

    def add(self, at: slice, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        score, ids = np.concatenate([self.score[at], score], 1), np.concatenate([self.id[at], ids], 1)
        order = np.lexsort((ids, -np.maximum(score, NONE + 1)), axis=1)[:, :k]
        self.score[at], self.id[at] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)

    def batch(self) -> pa.RecordBatch:
        slot, at = np.nonzero(self.score > NONE)
        return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(self.score[slot, at]), pa.array(self.id[slot, at])], names=["slot", "score", "id"])


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """row, vec_id, label and vector of at most BLOCK rows, in the order of vec_id."""
    for batch in batches:
        for i in range(0, len(batch), BLOCK):
            part = batch.slice(i, BLOCK)
            row, ids, label = (part.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label"))
            order = np.argsort(ids, kind="stable")
            yield row[order], ids[order], label[order], matrix(part.column("vector"), width)[order]


def _positives(sent, width: int, k: int):
    """Best k rows of each anchor's own label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        best = Best(len(anchors["row"]), k)
        for row, ids, label, x in _blocks(batches, width):
            for i in range(0, len(anchors["row"]), SOME):
                at = slice(i, i + SOME)
                scores = products(anchors["vector"][at], x)
                order = sorted_scores(scores)
                mine = (label[order] == anchors["label"][at, None]) & (row[order] != anchors["row"][at, None])
                place = mine.cumsum(1)
                a, j = np.nonzero(mine & (place <= k))
                score, found = np.full((len(order), k), NONE), np.zeros((len(order), k), np.int64)
                score[a, place[a, j] - 1], found[a, place[a, j] - 1] = scores[a, order[a, j]], ids[order[a, j]]
                best.add(at, score, found)
        yield best.batch()

    return run


def _negatives(sent, width: int, k: int, low: int):
    """Best k rows of other labels between the limits of each positive; a slot is an anchor's place times k plus the positive's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        top = anchors["positive"]
        best = Best(top.size, k)
        for _, ids, label, x in _blocks(batches, width):
            for i in range(0, len(anchors["row"]), SOME):
                scores = products(anchors["vector"][i : i + SOME], x)
                order = sorted_scores(scores)
                n = len(scores)
                score, found = np.full((n, k, k), NONE), np.zeros((n, k, k), np.int64)
                for a in range(n):
                    other = order[a][label[order[a]] != anchors["label"][i + a]]
                    falling = -scores[a, other]
                    limits = top[i + a][top[i + a] > NONE]
                    begin = np.searchsorted(falling, -limits)
                    for p, (b, limit) in enumerate(zip(begin, limits, strict=True)):
                        got = other[b : b + k]
                        got = got[100 * scores[a, got] >= low * limit]
                        score[a, p, : len(got)], found[a, p, : len(got)] = scores[a, got], ids[got]
                best.add(slice(i * k, (i + n) * k), score.reshape(n * k, k), found.reshape(n * k, k))
        yield best.batch()

    return run


def _best(lines: DataFrame, k: int) -> DataFrame:
    """The k best lines of each slot over all tasks, ranked from 1."""
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "id"))
    return lines.withColumn("rank", rank).where(F.col("rank") <= k)


def mine_negatives(embeddings: DataFrame, vector: str = "embedding", scale: int = SCALE, every: int = EVERY, k: int = K, low: int = LOW, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. embeddings: vec_id, label (whole number), vector."""
    spark = embeddings.sparkSession
    rows = embeddings.where(finite(vector) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("label").cast("long"), whole(vector, scale).alias("vector"))
    rows = save(rows, "negatives_rows")  # row numbers hold from here on
    anchors = save(rows.where(F.col("vec_id") % every == 0), "negatives_anchors")
    width, after, results = max(1, width_of(rows, "vector")), -1, []
    while some := anchors.where(F.col("row") > after).orderBy("row").limit(chunk).collect():
        after = some[-1].row
        sent = {c: np.array([r[c] for r in some], np.int64) for c in ("row", "vec_id", "label")}
        sent["vector"] = np.array([(r.vector + [0] * width)[:width] for r in some], np.int64)
        first = spark.sparkContext.broadcast(sent)
        positives = _best(rows.mapInArrow(_positives(first, width, k), "slot bigint, score bigint, id bigint"), k).collect()  # at most k a row of the chunk
        first.unpersist()
        sent["positive"], names = np.full((len(some), k), NONE), np.zeros((len(some), k), np.int64)
        for r in positives:
            sent["positive"][r.slot, r["rank"] - 1], names[r.slot, r["rank"] - 1] = r.score, r.id
        named = [(int(a * k + p), int(sent["vec_id"][a]), int(names[a, p]), int(sent["positive"][a, p])) for a, p in zip(*np.nonzero(sent["positive"] > NONE), strict=True)]
        named = spark.createDataFrame(named, "slot bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        negatives = _best(rows.mapInArrow(_negatives(spark.sparkContext.broadcast(sent), width, k, low), "slot bigint, score bigint, id bigint"), k)
        lines = negatives.join(named, "slot").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        results.append(save(lines, "negatives"))
    if not results:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return reduce(DataFrame.unionByName, results)


def shifted_labels(embeddings: DataFrame, divisor: int = SHIFTED, labels: int = LABELS) -> DataFrame:
    """Labels of rows whose vec_id is divisible by divisor become the next one, modulo labels."""
    return embeddings.withColumn("label", F.when(F.col("vec_id") % divisor == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
