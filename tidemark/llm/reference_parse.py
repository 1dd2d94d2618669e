"""Substring dedup by relative Lempel-Ziv parsing against the corpus itself.

The corpus is cut at sampled word grams; a gram that occurs once starts no reference. The phrases (windows of `window`
words) around all others are indexed under their earliest place. A document's phrases that are found there, joined to
runs that go on at one reference, are the seeds of its parse. Where a run ends though the document goes on repeating
something, the blocks of BLOCK phrases that follow at its reference are fetched. Each document is then factored
greedily from left to right: of the references that its next phrases point to, the one that it follows longest, back to
where the factor starts and on through the blocks, gives the factor; the next one starts at the first phrase after it
that occurs earlier, so also inside the words across the boundary. Words inside factors are duplicates.

Result rules: words are runs of bytes other than \\x20 and \\x09-\\x0D, unchanged; null texts have none. Earlier
means a smaller doc_id (null last), or the same document and a smaller position; texts that share a doc_id come in the
order of their hashes. Rows equal in doc_id and text count as one document and get the same result. Other columns of
the input are ignored. Phrases are told apart by 128 bits of content hashes, texts by 96.

At scale: about 1/7 of all words are shuffled as sampled grams, then only phrases of grams that occur twice
or more. Whole copies of a text are one factor that refers to the first of them, so only the first is parsed; the
copies are combined before the shuffle. Counts are combined before the shuffle; joins with them read two written tables,
so adaptive execution splits a phrase that a third of all rows share. A document gets two small blocks for each of its
runs, never a reference text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.natives import row_keys, screened, word_count, word_line
from tidemark.llm.vectortext import U, grams, mix, pieces, sampled, signed, sliding, word_hashes, words
from tidemark.llm.worktables import release, save

WINDOW = 20
GRAM = 8
#: phrases of a reference block
BLOCK = 32
LAST = (1 << 63) - 1
KEYS = ["key", "more"]
RUN = {"start": "int", "n": "int", "rdoc": "long", "rkey": "long", "rmore": "int", "rpos": "int"}


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _sampled_words(data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    starts, ends, row = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    ids = grams(hashes, gram)
    at = sampled(ids, row, gram, window)
    return hashes, row, ids, at


def _gram_batches(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, more = (batch.column(c).to_numpy(zero_copy_only=False) for c in KEYS)
            for i, _, data, offsets in pieces(batch.column("text")):
                _, row, ids, at = _sampled_words(data, offsets, window, gram)
                if len(at):
                    base = np.searchsorted(row, row[at])
                    yield pa.RecordBatch.from_arrays([signed(ids[at]), signed(keys[i + row[at]]), _ints(more[i + row[at]]), _ints(at - base)], names=["gram", *KEYS, "pos"])

    return run


def _phrase_batches(window: int, gram: int):
    """Phrases whose own sampled gram (the least in them) occurs twice or more: two hashes, doc, key, more, first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys, more = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", *KEYS))
            marks = batch.column("marks")
            for i, j, data, offsets in pieces(batch.column("text")):
                hashes, row, ids, at = _sampled_words(data, offsets, window, gram)
                m = len(hashes) - window + 1
                if m <= 0 or not len(at):
                    continue
                base = np.searchsorted(row, np.arange(j - i))
                known = np.concatenate([marks[r].values.to_numpy(zero_copy_only=False) + base[r - i] for r in range(i, j)])
                least = sliding(ids, window - gram + 1, np.minimum)
                k = np.flatnonzero((row[:m] == row[window - 1 :]) & np.isin(least, ids[known]))
                if len(k):
                    one = grams(hashes, window)[k]
                    two = grams(mix(hashes ^ U(0xA0761D6478BD642F)), window)[k]
                    r = row[k]
                    yield pa.RecordBatch.from_arrays([signed(one), signed(two), signed(docs[i + r]), signed(keys[i + r]), _ints(more[i + r]), _ints(k - base[r])], names=["one", "two", "doc", *KEYS, "pos"])

    return run


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """found(pos, rdoc, rkey, rmore, rpos) of each text as runs of phrases that go on at one reference."""
    for batch in batches:
        lists, bounds = [], [0]
        for found in batch.column("found"):
            pos, rdoc, rkey, rmore, rpos = (found.values.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            order = np.argsort(pos, kind="stable")
            pos, rdoc, rkey, rmore, rpos = (x[order] for x in (pos, rdoc, rkey, rmore, rpos))
            on = (np.diff(pos) == 1) & (np.diff(rpos) == 1) & (rkey[1:] == rkey[:-1]) & (rmore[1:] == rmore[:-1]) & (rdoc[1:] == rdoc[:-1])
            begin = np.flatnonzero(np.concatenate([[True], ~on]))
            n = np.diff(np.concatenate([begin, [len(pos)]]))
            lists.append((pos[begin], n, rdoc[begin], rkey[begin], rmore[begin], rpos[begin]))
            bounds.append(bounds[-1] + len(begin))
        if lists:
            columns = [np.concatenate(x) for x in zip(*lists, strict=True)]
            parts = [pa.array(c.astype(np.int64 if t == "long" else np.int32)) for c, t in zip(columns, RUN.values(), strict=True)]
            runs = pa.ListArray.from_arrays(pa.array(np.array(bounds, np.int32)), pa.StructArray.from_arrays(parts, names=list(RUN)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), runs], names=[*KEYS, "runs"])


def _reference_batches(window: int):
    """rkey, rmore, block and ids (32 bits of each phrase) of the wanted blocks of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, more, wanted, out = batch.column("key"), batch.column("more"), batch.column("wanted"), []
            for i, j, data, offsets in pieces(batch.column("text")):
                starts, ends, row = words(data, offsets)
                ids = _phrase_ids(word_hashes(data, starts, ends), window)
                base = np.searchsorted(row, np.arange(j - i + 1))
                for r in range(i, j):
                    lo, hi = base[r - i], base[r - i + 1] - window + 1
                    for b in wanted[r].values.to_numpy(zero_copy_only=False).tolist():
                        if lo + b * BLOCK < hi:
                            out.append((keys[r].as_py(), more[r].as_py(), b, ids[lo + b * BLOCK : min(hi, lo + (b + 1) * BLOCK)].tolist()))
            if out:
                k, m, b, ids = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(m, pa.int32()), pa.array(b, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], names=["rkey", "rmore", "block", "ids"])

    return run


def _phrase_ids(hashes: np.ndarray, window: int) -> np.ndarray:
    return (grams(hashes, window) >> U(32)).astype(np.uint32).view(np.int32)


def factors(ids: np.ndarray, runs: list[tuple], blocks: dict[tuple, np.ndarray], window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors of one document: first word, word after the last, doc_id and first word of the reference.

    ids: its phrases; runs: RUN tuples by start, each phrase in one occurs earlier; blocks: phrases of (rkey, rmore, block).
    """
    begin = [r[0] for r in runs]
    end = [r[0] + r[1] for r in runs]

    def follows(i: int, key: tuple, q: int, stop: int) -> int:
        """Phrases from i on, before stop, that are those of the reference from q on, as far as its blocks are here."""
        n = 0
        while i + n < stop:
            block = blocks.get((*key, (q + n) // BLOCK))
            skip = (q + n) % BLOCK
            if block is None or skip >= len(block):
                break
            m = min(stop - i - n, len(block) - skip)
            differs = np.flatnonzero(ids[i + n : i + n + m] != block[skip : skip + m])
            if len(differs):
                return n + int(differs[0])
            n += m
        return n

    out, k, i = [], 0, begin[0] if runs else 0
    while k < len(runs):
        # found phrases that go on without a gap from i: a factor can't be longer
        last, stop = k, end[k]
        while last + 1 < len(runs) and begin[last + 1] == stop:
            last, stop = last + 1, end[last + 1]
        best = (end[k] - i + follows(end[k], runs[k][3:5], runs[k][5] + end[k] - begin[k], stop), -k)
        tried = {(*runs[k][3:5], runs[k][5] - begin[k])}
        for other in range(k + 1, bisect_left(begin, min(i + window, stop))):
            run = runs[other]
            place = (*run[3:5], run[5] - run[0])
            back = run[0] - i
            if place in tried or run[5] < back:
                continue
            tried.add(place)
            if follows(i, run[3:5], run[5] - back, run[0]) == back:
                best = max(best, (back + run[1] + follows(end[other], run[3:5], run[5] + run[1], stop), -other))
        n, run = best[0], runs[-best[1]]
        out.append((i, i + n - 1 + window, run[2], run[5] + i - run[0]))
        k = bisect_right(end, i + n)
        i = max(i + n, begin[k]) if k < len(runs) else i
    return out


def _parse_batches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, more, runs, fetched, out = *(batch.column(c) for c in KEYS), batch.column("runs"), batch.column("fetched"), []
            for i, j, data, offsets in pieces(batch.column("text")):
                starts, ends, row = words(data, offsets)
                ids = _phrase_ids(word_hashes(data, starts, ends), window)
                for r in range(i, j):
                    lo, hi = np.searchsorted(row, [r - i, r - i + 1])
                    seeds = list(zip(*(runs[r].values.field(c).to_numpy(zero_copy_only=False).tolist() for c in range(6)), strict=True))
                    blocks = {}
                    if fetched[r].is_valid:
                        f = fetched[r].values
                        for n in range(len(f)):
                            blocks[f.field(0)[n].as_py(), f.field(1)[n].as_py(), f.field(2)[n].as_py()] = f.field(3)[n].values.to_numpy(zero_copy_only=False)
                    found = factors(ids[lo : hi - window + 1], seeds, blocks, window)
                    change = np.zeros(hi - lo + 1, np.int64)
                    np.add.at(change, [f[0] for f in found], 1)
                    np.add.at(change, [f[1] for f in found], -1)
                    gone = np.cumsum(change)[:-1] > 0
                    kept = b" ".join(data[a:b].tobytes() for a, b in zip(starts[lo:hi][~gone], ends[lo:hi][~gone], strict=True))
                    out.append((keys[r].as_py(), more[r].as_py(), int(gone.sum()), hashlib.sha256(kept).hexdigest(), *(list(x) for x in zip(*found, strict=True))))
            if out:
                k, m, n, sha, *lists = zip(*out, strict=True)
                big = pa.list_(pa.int64())
                columns = [pa.array(k, pa.int64()), pa.array(m, pa.int32()), pa.array(n, pa.int64()), pa.array(sha), *(pa.array(x, big) for x in lists)]
                yield pa.RecordBatch.from_arrays(columns, names=[*KEYS, "n_removed", "kept_sha256", "starts", "ends", "refs", "ref_starts"])

    return run


def factor_table(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """For each text whose first copy has a factor: key and more (row_keys of the text), n_removed, kept_sha256 and that
    copy's factors as arrays starts, ends (words, end exclusive), refs (doc_id of the reference), ref_starts."""
    rows = documents.select("text", *row_keys("text"), F.coalesce("doc_id", F.lit(LAST)).alias("doc"))
    sample = rows.select("text", *KEYS).mapInArrow(_gram_batches(window, gram), "gram long, key long, more int, pos int")
    place = F.struct(*KEYS, "pos")
    known = sample.groupBy("gram").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi")
    known = save(known.select("gram"), "grams")
    marks = save(sample.join(known, "gram").groupBy(*KEYS).agg(F.collect_set("pos").alias("marks")), "marks")
    firsts = screened(rows, marks, "key").groupBy(*KEYS).agg(F.min("doc").alias("doc"), F.first("text").alias("text"))
    texts = save(firsts.join(marks, KEYS).select("doc", *KEYS, "text", "marks"), "texts")
    release(known, marks)

    phrases = texts.mapInArrow(_phrase_batches(window, gram), "one long, two long, doc long, key long, more int, pos int")
    index = phrases.groupBy("one", "two").agg(F.count("*").alias("n"), F.min(F.struct("doc", *KEYS, "pos")).alias("at")).where("n > 1")
    index = save(index.select("one", "two", F.col("at.doc").alias("rdoc"), F.col("at.key").alias("rkey"), F.col("at.more").alias("rmore"), F.col("at.pos").alias("rpos")), "index")
    earlier = phrases.join(index, ["one", "two"]).where("key <> rkey or more <> rmore or pos <> rpos")
    found = earlier.groupBy(*KEYS).agg(F.collect_list(F.struct("pos", "rdoc", "rkey", "rmore", "rpos")).alias("found"))
    kinds = ", ".join(f"{c}: {t}" for c, t in RUN.items())
    runs = save(found.mapInArrow(_run_batches, f"key long, more int, runs array<struct<{kinds}>>"), "runs")
    release(index)

    # blocks that follow a run at its reference, where the document's next phrase occurs earlier too
    each = runs.select(*KEYS, F.explode(F.arrays_zip("runs", F.slice(F.concat("runs", F.array(F.lit(None).cast(f"struct<{kinds}>"))), 2, 2147483647).alias("next"))).alias("x"))
    each = each.where(F.col("x.runs.start") + F.col("x.runs.n") == F.col("x.next.start"))
    block = F.floor((F.col("x.runs.rpos") + F.col("x.runs.n")) / BLOCK).cast("int")
    requests = save(each.select(*KEYS, "x.runs.rkey", "x.runs.rmore", F.explode(F.array(block, block + 1)).alias("block")).distinct(), "requests")
    wanted = save(requests.groupBy("rkey", "rmore").agg(F.collect_set("block").alias("wanted")), "wanted")
    asked = texts.select(*KEYS, "text").join(wanted.withColumnsRenamed({"rkey": "key", "rmore": "more"}), KEYS)
    blocks = save(asked.mapInArrow(_reference_batches(window), "rkey long, rmore int, block int, ids array<int>"), "blocks")
    fetched = requests.join(blocks, ["rkey", "rmore", "block"]).groupBy(*KEYS).agg(F.collect_list(F.struct("rkey", "rmore", "block", "ids")).alias("fetched"))
    seeds = save(runs.join(fetched, KEYS, "left"), "seeds")
    release(runs, requests, wanted, blocks)
    out = texts.select(*KEYS, "text").join(seeds, KEYS).mapInArrow(
        _parse_batches(window), "key long, more int, n_removed long, kept_sha256 string, starts array<long>, ends array<long>, refs array<long>, ref_starts array<long>"
    )
    out = save(out, "factors")
    release(texts, seeds)
    return out


def reference_dedup(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each row of documents: doc_id, n_words, n_removed, kept_sha256, n_factors, starts, ends, refs."""
    parsed = factor_table(documents, window)
    doc = F.coalesce("doc_id", F.lit(LAST))
    whole = documents.select("doc_id", doc.alias("doc"), *row_keys("text"), word_line("text").alias("plain"))
    whole = save(whole.select("doc_id", "doc", *KEYS, word_count("plain").alias("n_words"), F.sha2(F.col("plain").cast("binary"), 256).alias("sha")), "whole")
    first = save(whole.groupBy(*KEYS).agg(F.min("doc").alias("first"), F.count("*").alias("rows")).where("rows > 1").select(*KEYS, "first"), "firsts")
    none = F.array().cast("array<long>")
    copy = F.coalesce(F.col("doc") > F.col("first"), F.lit(False)) & (F.col("n_words") >= window)
    lists = {"starts": F.array(F.lit(0).cast("long")), "ends": F.array("n_words"), "refs": F.array("first")}
    return whole.join(first, KEYS, "left").join(parsed, KEYS, "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, 1).otherwise(F.coalesce(F.size("starts"), F.lit(0))).alias("n_factors"),
        *(F.when(copy, of).otherwise(F.coalesce(c, none)).alias(c) for c, of in lists.items()),
    )
