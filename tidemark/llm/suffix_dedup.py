"""Exact substring dedup by bucket-pointer refinement over a sampled suffix array.

A suffix starts in the bucket of its q-gram, a quarter of the string long. Each round of refinement sorts the
suffixes of a bucket on the bucket identifiers one q-gram further on, to the right and, as a string may begin
before its suffix, to the left; the refined identifier is the bucket of the next round. Suffixes that are alone on
both sides leave. What remains says how far a suffix can match others, and only strings within that reach are
spelled out and compared. Suffixes that agree in all they hold need no round: they form one class at once.

Only suffixes at sampled positions take part (every string holds one, at the same place wherever it occurs; the
leftmost with the least identifier owns the string). A row for every byte would shuffle eight times the input.

Result rules: texts are UTF-8 bytes, null counts as empty. A byte goes if a string of `length` bytes covers it
that also starts anywhere else. Matches never cross rows. Two equal rows are two documents, so each removes
the other's text. Strings are judged on the input. Columns of the input other than doc_id and text are ignored.
Strings are told apart by their bucket and a second identifier, 128 bits of content hashes; texts by 96 bits.

At scale: about 1/38 suffix a byte is shuffled to be counted, and those of repeated buckets are written once. The joins that follow a count are plain joins of two written tables, so adaptive execution splits a
bucket that a third of all rows share. Only texts with a repeated string move. Nothing is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.natives import row_keys, screened
from tidemark.llm.vectortext import BASE, BYTES, INVERSE, U, join_ids, mix, pieces, powers, prefix_hash, sampled, signed, substring_hash
from tidemark.llm.worktables import release, save

LENGTH = 200
#: rounds of refinement: a string is four q-grams long
ROUNDS = 3
KEYS = ["key", "more"]
#: room for the number of starts in a mark
STARTS = 1 << 20
RIGHT, LEFT = ([f"{side}{k}" for k in range(1, ROUNDS + 1)] for side in ("right", "left"))
START = {"bucket": "long", "class": "long"}
SUFFIX = START | {"key": "long", "more": "int", "pos": "int", "near": "int", "far": "int"} | dict.fromkeys(RIGHT + LEFT, "int")


def start_ids(data: np.ndarray, depth: int) -> np.ndarray:
    """Initial buckets: identifiers of the depth-grams at each position."""
    n = len(data) - depth + 1
    if n <= 0:
        return np.zeros(0, U)
    s = prefix_hash(BYTES[data])
    return mix((s[depth:] - s[:-depth]) * powers(n, INVERSE, "down"))


def gram_ids(data: np.ndarray, length: int) -> np.ndarray:
    """Identifiers of the q-grams, refined once from those of half their depth."""
    half = max(1, length // 8)
    ids = start_ids(data, half)
    return join_ids(ids, ids, half) if length // 4 > half else ids


def owned(at: np.ndarray, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings that each sampled suffix owns; last < first where there is none.

    at: sorted positions, with the bounds lo and hi of their rows. A string belongs to the leftmost suffix in it
    with the least identifier, which its content alone decides.
    """
    width = length - length // 4 + 1
    before, after, m = lo - 1, hi + width, len(at)
    for bound, step, beats in ((before, -1, np.less_equal), (after, 1, np.less)):
        open_, k = np.arange(m), step
        while len(open_):
            there = open_ + k
            open_ = open_[(there >= 0) & (there < m)]
            there = open_ + k
            near = (np.abs(at[there] - at[open_]) < width) & (lo[there] == lo[open_])
            open_, there = open_[near], there[near]
            hit = beats(ids[there], ids[open_])
            bound[open_[hit]] = at[there[hit]]
            open_, k = open_[~hit], k + step
    return np.maximum(before + 1, at - width + 1), np.minimum(np.minimum(at, hi - length), after - width)


def _suffix_batches(length: int, whole: bool):
    """A row of SUFFIX, or of START only, for each sampled suffix that owns strings: near and far tell how many bytes before it the last
    and the first of them start, class what they all hold, right and left the q-grams around it, null beyond the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = length // 4
        for batch in batches:
            keys, more = (batch.column(c).to_numpy(zero_copy_only=False) for c in KEYS)
            for i, _, data, offsets in pieces(batch.column("text")):
                ids = gram_ids(data, length)
                rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                at = sampled(ids, rows, gram, length)
                row = rows[at]
                lo, hi = offsets[row], offsets[row + 1]
                first, last = owned(at, ids[at], lo, hi, length)
                k = np.flatnonzero(last >= first)
                if not len(k):
                    continue
                at, row, lo, hi, first, last = (x[k] for x in (at, row, lo, hi, first, last))
                held = substring_hash(prefix_hash(BYTES[data]), first, last + length)
                held = mix(held ^ (at - first).astype(U) * BASE)
                if not whole:
                    yield pa.RecordBatch.from_arrays([signed(ids[at]), signed(held)], names=list(START))
                    continue
                blocks = []
                for side in (1, -1):
                    for n in range(1, ROUNDS + 1):
                        p = at + side * n * gram
                        out = (p < lo) | (p + gram > hi)
                        blocks.append(pa.array((ids[np.where(out, at, p)] >> U(32)).astype(np.uint32).view(np.int32), mask=out))
                small = [pa.array(x.astype(np.int32)) for x in (more[i + row], at - lo, at - last, at - first)]
                yield pa.RecordBatch.from_arrays([signed(ids[at]), signed(held), signed(keys[i + row]), *small, *blocks], names=list(SUFFIX))

    return run


def _marks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, bytes, values of the list column) of a batch with texts."""
    lists = batch.column(column)
    for i, j, data, offsets in pieces(batch.column("text")):
        for r in range(i, j):
            yield r, data[offsets[r - i] : offsets[r - i + 1]], lists[r].values


def _string_batches(length: int):
    """A row for each string in reach of the suffixes of a text: bucket, string, ask, key, more, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = length // 4
        for batch in batches:
            keys, more = (batch.column(c).to_numpy(zero_copy_only=False) for c in KEYS)
            for r, data, of in _marks(batch, "suffixes"):
                bucket, pos, near, far, ask = (of.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                pos, count = pos.astype(np.int64), far.astype(np.int64) - near + 1
                starts = np.repeat(pos - far - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                prefix, down = prefix_hash(BYTES[data]), powers(len(data) + 1, INVERSE, "down")
                part = [mix((prefix[starts + q + w] - prefix[starts + q]) * down[starts + q]) for q, w in ((0, gram), (gram, gram), (2 * gram, gram), (3 * gram, length - 3 * gram))]
                full = mix(mix(part[0] * BASE + part[1]) * BASE + mix(part[2] * BASE + part[3]))
                n = len(starts)
                columns = [signed(np.repeat(bucket, count)), signed(full), pa.array(np.repeat(ask, count)), signed(np.full(n, keys[r])), pa.array(np.full(n, more[r], np.int32)), pa.array(starts.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "string", "ask", *KEYS, "start"])

    return run


def _removal_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, more, out = batch.column("key"), batch.column("more"), []
            for r, data, of in _marks(batch, "marks"):
                mark = of.to_numpy(zero_copy_only=False)
                change = np.zeros(len(data) + 1, np.int64)
                np.add.at(change, mark // STARTS, 1)
                np.add.at(change, mark // STARTS + mark % STARTS + length - 1, -1)
                gone = np.cumsum(change)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                out.append((keys[r].as_py(), more[r].as_py(), int(gone.sum()), hashlib.sha256(data[~gone].tobytes()).hexdigest(), edges[::2].tolist(), edges[1::2].tolist()))
            if out:
                k, m, n, sha, starts, ends = zip(*out, strict=True)
                big = pa.list_(pa.int64())
                columns = [pa.array(k, pa.int64()), pa.array(m, pa.int32()), pa.array(n, pa.int64()), pa.array(sha), pa.array(starts, big), pa.array(ends, big)]
                yield pa.RecordBatch.from_arrays(columns, names=[*KEYS, "n_removed", "kept_sha256", "starts", "ends"])

    return run


def _reach(right: Column, left: Column, length: int) -> tuple[Column, Column]:
    """near and far after so many rounds to either side: the next q-gram may agree in all but one byte."""
    gram = length // 4
    near = F.when(right == ROUNDS, 0).otherwise(length - gram * (right + 2) + 1)
    far = F.when(left == ROUNDS, length - gram).otherwise(gram * (left + 1) - 1)
    return F.greatest("near", near), F.least("far", far)


def refined(suffixes: DataFrame, length: int) -> DataFrame:
    """suffixes(bucket, key, more, pos, near, far, ask, RIGHT, LEFT) that can still match another one in part, with
    near and far cut to that.

    A round puts a suffix into the bucket of (its bucket so far, the identifier of the q-gram one further on), for
    either side; buckets of one end that side, others are what the next round refines.
    """
    now, before = suffixes.withColumns({"r": F.col("bucket"), "l": F.col("bucket"), "right": F.lit(0), "left": F.lit(0)}), []
    for k, (to_right, to_left) in enumerate(zip(RIGHT, LEFT, strict=True)):
        pointed = lambda side, of, to: F.when((F.col(side) == k) & F.col(to).isNotNull(), F.xxhash64(F.lit(side), of, to))  # noqa: E731, B023
        now = save(now.withColumns({"r": pointed("right", "r", to_right), "l": pointed("left", "l", to_left)}), "pointed")
        release(*before)
        shared = now.select(F.explode(F.array("r", "l")).alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
        shared = save(shared.select("id"), "shared")
        before = [now, shared]
        for of, side in (("r", "right"), ("l", "left")):
            joined = now.join(shared.withColumn("met", F.lit(True)), F.col(of) == F.col("id"), "left").drop("id")
            now = joined.withColumn(side, F.when(F.col("met"), k + 1).otherwise(F.col(side))).drop("met")
        hope = lambda side: F.when(F.col(side) == k + 1, ROUNDS).otherwise(F.col(side))  # noqa: E731, B023
        near, far = _reach(hope("right"), hope("left"), length)
        now = now.where(near <= far)
    near, far = _reach(F.col("right"), F.col("left"), length)
    out = save(now.select("bucket", *KEYS, "pos", near.alias("near"), far.alias("far"), "ask").where("near <= far"), "refined")
    release(*before)
    return out


def repeated_substrings(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """For each text that loses bytes: key and more (row_keys of doc_id and text), n_removed, kept_sha256 and the
    removed runs as arrays starts, ends (byte offsets, end exclusive). Equal rows share one row of the result.

    length: bytes of the strings, a multiple of 8, at least 8.
    """
    if length < 8 or length % 8:
        raise ValueError("length must be a multiple of 8")
    rows = documents.select("text", *row_keys("doc_id", "text"))
    sampled_as = lambda kinds: rows.mapInArrow(_suffix_batches(length, kinds is SUFFIX), ", ".join(f"{c} {t}" for c, t in kinds.items()))
    buckets = sampled_as(START).groupBy("bucket").agg(F.count("*").alias("n"), (F.min("class") < F.max("class")).alias("mixed")).where("n > 1")
    buckets = save(buckets.select("bucket", "mixed"), "buckets")
    suffixes = screened(sampled_as(SUFFIX), buckets, "bucket").join(buckets, "bucket")
    suffixes = save(suffixes.withColumns({c: F.when(F.col("mixed"), F.col(c)) for c in RIGHT + LEFT}), "suffixes")
    starts = lambda df: df.select(*KEYS, ((F.col("pos") - F.col("far")).cast("long") * STARTS + F.col("far") - F.col("near") + 1).alias("mark"))
    alike, mixed = starts(suffixes.where("not mixed")), suffixes.where("mixed")
    rest = [c for c in SUFFIX if c not in START]
    counted = save(mixed.groupBy("bucket", "class").agg(F.count("*").alias("n"), F.min(F.struct(*rest)).alias("one")), "counted")
    agreed = starts(mixed.select("bucket", "class", *KEYS, "pos", "near", "far").join(counted.where("n > 1").select("bucket", "class"), ["bucket", "class"]))
    whole = save(alike.unionByName(agreed), "whole")
    # a class alone may match others in part; of a class of several one suffix stands for all
    asked = refined(counted.select("bucket", "one.*", (F.col("n") == 1).alias("ask")), length)
    grouped = save(asked.groupBy(*KEYS).agg(F.collect_list(F.struct("bucket", "pos", "near", "far", "ask")).alias("suffixes")), "asked")
    release(buckets, suffixes, counted, asked)
    spelled = screened(rows, grouped, "key").join(grouped, KEYS).mapInArrow(_string_batches(length), "bucket long, string long, ask boolean, key long, more int, start int")
    spelled = save(spelled, "strings")
    again = save(spelled.groupBy("bucket", "string").agg(F.count("*").alias("n")).where("n > 1").select("bucket", "string"), "again")
    hits = spelled.where("ask").join(again, ["bucket", "string"]).select(*KEYS, (F.col("start").cast("long") * STARTS + 1).alias("mark"))

    marks = save(whole.unionByName(hits).groupBy(*KEYS).agg(F.collect_set("mark").alias("marks")), "marks")
    release(whole, grouped, spelled, again)
    out = screened(rows, marks, "key").join(marks, KEYS).mapInArrow(_removal_batches(length), "key long, more int, n_removed long, kept_sha256 string, starts array<long>, ends array<long>")
    out = save(out.dropDuplicates(KEYS), "removed")
    release(marks)
    return out


def suffix_dedup(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row for each row of documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends."""
    removed = repeated_substrings(documents, length)
    whole = documents.select("doc_id", *row_keys("doc_id", "text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    none = F.array().cast("array<long>")
    return whole.join(removed, KEYS, "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        F.coalesce("starts", none).alias("starts"),
        F.coalesce("ends", none).alias("ends"),
    )
