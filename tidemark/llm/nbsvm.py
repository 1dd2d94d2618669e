"""Quality classifier: naive Bayes support vectors.

Features are indicators of byte 3-grams and of word-shape 2-grams (length class, case, final sign, whether the
word repeats the one before), hashed to SIZE buckets. Each indicator is scaled by the log ratio of its smoothed
counts in the two classes; a linear hinge-loss model is fitted on these by dual coordinate descent. Margins
become scores by a logistic curve fitted on rows the model did not see.

Result rules: the fit uses at most SAMPLE labelled rows (those with the least digest of their doc_id), never
those with crc32(doc_id) mod 5 = 0; every row is scored on its whole text. Null counts as empty, which has the
bias alone. Where doc_ids repeat in labels, the least label counts; null labels or doc_ids are left out. Without
labels of both classes each row scores the share of label 1 (0.5 without any). Other columns are ignored.

At scale: SAMPLE bounds what is broadcast and what the one fitting task reads; scoring is one pass without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.vectortext import U, grams, mix, pieces, word_hashes, words
from tidemark.llm.worktables import save

SIZE = 1 << 16
SAMPLE = 16_000
EPOCHS = 8
COST = 1.0
SMOOTH = 1.0
LINE = 0.3


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each row of a piece, and the bounds of the rows."""
    n = len(offsets) - 1
    of = np.repeat(np.arange(n), np.diff(offsets))
    d = data.astype(U)
    m = max(0, len(d) - 2)
    ids = mix(d[:m] | d[1 : m + 1] << U(8) | d[2 : m + 2] << U(16)) % U(SIZE)
    whole = of[:m] == of[2 : m + 2]
    starts, ends, row = words(data, offsets)
    length = np.minimum(np.ceil(np.log2(ends - starts + 1)).astype(np.int64), 7)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    caps = upper[ends] - upper[starts]
    case = np.where(caps == 0, 0, np.where(caps == 1, 1, 2))
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    sign = np.where((last < 48) | ((last > 57) & (last < 65)), last, 0).astype(np.int64)
    hashes = word_hashes(data, starts, ends)
    again = np.zeros(len(starts), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    shape = mix((length | case << 3 | sign << 5 | again << 13).astype(U))
    pair = grams(shape, 2) % U(SIZE)
    k = np.flatnonzero(row[:-1] == row[1:]) if len(row) > 1 else np.zeros(0, np.int64)
    code = np.concatenate([of[:m][whole].astype(U) * U(SIZE) + ids[whole], row[k].astype(U) * U(SIZE) + pair[k]])
    code = np.unique(code).astype(np.int64)
    return code % SIZE, np.searchsorted(code, np.arange(n + 1) * SIZE)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in pieces(batch.column("text")):
            ids, bound = features(data, offsets)
            rest = [batch.column(c).slice(i, j - i) for c in ("doc_id", "label")]
            yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "label", "features"])


def fit(rows: list[np.ndarray], labels: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Weights (bias last), then slope and intercept of the logistic curve; check marks rows kept for the curve."""
    train = np.flatnonzero(~check)
    good, bad = np.full(SIZE, SMOOTH), np.full(SIZE, SMOOTH)
    for i in train:
        (good if labels[i] else bad)[rows[i]] += 1
    ratio = np.append(np.log(good / good.sum()) - np.log(bad / bad.sum()), 1.0)
    w = np.zeros(SIZE + 1)
    sign = np.where(labels == 1, 1.0, -1.0)
    share = labels[train].mean()
    cost = COST * np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    with_bias = [np.append(r, SIZE) for r in rows]
    scale = [1 / max(1.0, np.sqrt(np.square(ratio[r]).sum())) for r in with_bias]
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(train):
            r = with_bias[i]
            x = ratio[r] * scale[i]
            gradient = sign[i] * (w[r] @ x) - 1
            new = min(max(alpha[i] - gradient / (x @ x), 0.0), cost[i])
            if new != alpha[i]:
                w[r] += (new - alpha[i]) * sign[i] * x
                alpha[i] = new
    held = np.flatnonzero(check) if len(set(labels[check])) == 2 else train
    z = np.array([w[with_bias[i]] @ ratio[with_bias[i]] * scale[i] for i in held])
    y, slope, shift = labels[held].astype(float), 1.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        v = p * (1 - p) + 1e-6
        h = np.array([[(v * z * z).sum() + 1e-2, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-2]])
        step = np.linalg.solve(h, [((p - y) * z).sum() + 1e-2 * slope, (p - y).sum() + 1e-2 * shift])
        slope, shift = slope - step[0], shift - step[1]
        if abs(step).max() < 1e-6:
            break
    return np.concatenate([ratio, w, [slope, shift]])


def _fit_group(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("order", kind="stable")
    labels = frame["label"].to_numpy()
    if len(set(labels)) < 2:
        model = np.concatenate([np.zeros(2 * SIZE + 2), [1.0, 4.0 if labels.any() else -4.0]])
    else:
        model = fit([np.asarray(x) for x in frame["features"]], labels, (frame["order"] % 5 == 0).to_numpy())
    return pd.DataFrame({"model": [model.astype(np.float64).tobytes()]})


def _score_batches(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.frombuffer(model)
        ratio, w, (slope, shift) = m[: SIZE + 1], m[SIZE + 1 : -2], m[-2:]
        both = w * ratio
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("text")):
                ids, bound = features(data, offsets)
                total = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x[ids])])[bound])  # noqa: B023, E731
                norm = np.sqrt(total(np.square(ratio)) + 1)
                z = (total(both) + both[SIZE]) / norm
                score = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(score)], names=["doc_id", "score"])

    return run


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """The fitted model from at most `sample` labelled rows (doc_id, label) of documents."""
    known = labels.where("doc_id is not null and label in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
    known = save(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")
    rows = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most `sample` rows of two numbers
    rows = save(rows.mapInArrow(_feature_batches, "doc_id long, label int, features array<int>"), "features")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample).withColumn("order", F.abs(F.xxhash64("doc_id", F.lit(1)) % 1_000_003))
    model = rows.withColumn("fit", F.lit(1)).groupBy("fit").applyInPandas(_fit_group, "model binary").collect()
    return model[0].model if model else np.concatenate([np.zeros(2 * SIZE + 2), [1.0, 0.0]]).tobytes()


def score_quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, line: float = LINE) -> DataFrame:
    """A row for each row of documents: doc_id, held_out, score, predicted. labels: doc_id, label (0 or 1)."""
    scored = documents.select("doc_id", "text").mapInArrow(_score_batches(train(documents, labels, sample)), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= line).cast("int").alias("predicted"))
