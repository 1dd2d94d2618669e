"""Packing: windows filled with lexically near documents, found by a sharded BM25 index.

Documents become token ids and an end id. Each full window of a long document is a sequence of its own; the rest
goes to a shard with rests that have the same telling token (the one of greatest BM25 weight that enough documents
have). A shard has an inverted index of its rests. A seed's most telling tokens score the unused rests by BM25; they
fill the seed's window from the best on as long as they fit whole, then the best of the others is cut to fill the
gap, and what is left of it is the next seed. A shard's last window is cut at powers of two, which need no padding.

Result rules: every row of documents gets its pieces, repeated rows and doc_ids too; null text counts as empty, and
an empty text is the end id alone. The strings of special tokens in a text are ordinary text. Which rests come
together follows doc_id and tokens; rows equal in both are interchangeable. An empty table has no pieces. Other
columns are ignored.

At scale: counts of tokens over all documents have the vocabulary's size, the only thing the driver sees. Rests are
shuffled once, at most a window of ids each. Shards hold about `shard` rests whatever the tokens' frequencies: a
token with more is dealt to several shards by hash, rare ones share one. A text of any length is encoded in bounded
runs of words.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.vectortext import LOWER, SPACE, pieces, words
from tidemark.llm.worktables import release, save

WINDOW, END, SHARD = 2048, 1, 1024
#: BM25's saturation and length share; tokens of a seed that are looked up
K1, B, QUERY = 1.2, 0.75, 24
#: words encoded at once, and words remembered
RUN, KNOWN = 400_000, 1_500_000
#: signs that the tokenizer always parts from an ASCII letter before them
CLOSING = np.zeros(256, bool)
CLOSING[[ord(c) for c in ".,;:!?"]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def only_letters(word: str) -> bool:
    """Whether a word is one run of letters once the tokenizer has composed and lowered it."""
    return word.isalpha() if word.isascii() else unicodedata.normalize("NFC", word).lower().isalpha()


class WordIds:
    """Token ids of words; a word's ids do not depend on its neighbours, so each is encoded once while remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.last = np.zeros(self.size, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, new: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in another order, all their ids, and how many each has.

        Runs of letters are encoded as one text, where a last token tells each word's end.
        """
        plain, odd = [w for w in new if only_letters(w)], [w for w in new if not only_letters(w)]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(plain):  # letters that the tokenizer takes for something else
            plain, odd, ids, ends = [], new, ids[:0], ends[:0]
        made = [e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
        counts = np.concatenate([np.diff(ends, prepend=0), np.array([len(e) for e in made], np.int64)])
        return plain + odd, np.concatenate([ids, np.fromiter(chain.from_iterable(made), np.uint32)]), counts

    def of(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each word has."""
        if len(self.known) > KNOWN:
            self.forget()
        coded = strings.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if new := [w for w in names if w not in self.known]:
            new, ids, counts = self.encode(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, ids])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])
        slot = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        at = coded.indices.to_numpy()
        counts = (self.bounds[slot + 1] - self.bounds[slot])[at]
        return self.ids[spread(self.bounds[slot][at], counts)], counts


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then those of the next."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def encoded(coder: WordIds, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the rows of a piece, each with the end id, and the bounds of the rows."""
    starts, ends, row = words(data, offsets)
    cut = np.flatnonzero(CLOSING[data[ends - 1]] & (ends - starts > 1) & LETTER[data[np.maximum(ends - 2, 0)]])  # a closing sign is a word of its own
    where = cut + np.arange(1, len(cut) + 1)
    starts, row = np.insert(starts, cut + 1, ends[cut] - 1), np.insert(row, cut + 1, row[cut])
    ends = np.insert(ends, cut + 1, ends[cut])
    ends[where - 1] -= 1
    held = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = LOWER[data[~SPACE[data]]]
    ids, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for i in range(0, len(starts), RUN):
        j = min(i + RUN, len(starts))
        marks = (held[i : j + 1] - held[i]).astype(np.int64)
        strings = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(marks), pa.py_buffer(np.ascontiguousarray(letters[held[i] : held[j]])))
        got, counts = coder.of(strings)
        ids.append(got)
        sizes += np.bincount(row[i:j], counts, len(sizes)).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(bounds[-1], end, np.uint32)
    inside = np.ones(len(out), bool)
    inside[bounds[1:] - 1] = False
    out[inside] = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    return out, bounds


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_counts(ids: np.ndarray, bounds: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, token and count of the distinct tokens of each row, in that order."""
    key = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * vocabulary + ids
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first] // vocabulary, key[first] % vocabulary, np.diff(np.append(first, len(key)))


_TOKENS = "doc_id bigint, doc_tokens bigint, fulls array<bigint>, rest binary, counts array<bigint>"


def _encode(path: str, vocabulary: int, window: int, end: int):
    """Rows of documents as crc of full windows and ids of the rest; then one row of rows, tokens and rows a token has."""
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path)
        total = np.zeros(2 + vocabulary, np.int64)
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
        schema = pa.schema(list(zip(("doc_id", "doc_tokens", "fulls", "rest", "counts"), types, strict=True)))
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("text"), 1 << 23):
                ids, bounds = encoded(coder, data, offsets, end)
                sizes = np.diff(bounds)
                total[:2] += j - i, len(ids)
                total[2:] += np.bincount(token_counts(ids, bounds, vocabulary)[1], minlength=vocabulary)
                fulls = [[crc(ids[b + k * window : b + (k + 1) * window]) for k in range(s // window)] for b, s in zip(bounds, sizes, strict=False)]
                rest = [ids[b + s // window * window : b + s].astype(kind).tobytes() for b, s in zip(bounds, sizes, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(sizes), pa.array(fulls, types[2]), pa.array(rest, types[3]), pa.nulls(j - i, types[4])], schema=schema)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types[:4]), pa.array([total.tolist()], types[4])], schema=schema)

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for row in batch.column("counts"):
            x = row.values.to_numpy()
            total = x + (0 if total is None else total)
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])


class Weights:
    """BM25 weights from counts over all documents."""

    def __init__(self, counts: np.ndarray, common: int):
        n, tokens, has = counts[0], counts[1], counts[2:]
        self.idf = np.log1p((n - has + 0.5) / (has + 0.5))
        self.mean = tokens / max(n, 1)
        self.common = has >= common

    def of(self, row: np.ndarray, token: np.ndarray, count: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.idf[token] * count * (K1 + 1) / (count + K1 * (1 - B + B * sizes[row] / self.mean))


def rests(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rests, and their bounds."""
    sizes = pc.binary_length(column).to_numpy() // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _tell(weights: Weights, vocabulary: int, keep: list[str]):
    """Adds to each row its telling token: the greatest weight among tokens that enough documents have, else among all; -1 for an empty rest."""
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                ids, bounds = rests(batch.column("rest"), kind)
                row, token, count = token_counts(ids, bounds, vocabulary)
                weight = weights.of(row, token, count, np.diff(bounds)) + 1e6 * weights.common[token]
                order = np.lexsort((token, -weight, row))
                first = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])] if len(order) else order
                told = np.full(len(batch), -1, np.int32)
                told[row[first]] = token[first]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(told)], names=[*keep, "token"])

    return run


class Index:
    """Inverted index of a shard's rests."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, weights: Weights, vocabulary: int):
        row, token, count = token_counts(ids, bounds, vocabulary)
        weight = weights.of(row, token, count, np.diff(bounds))
        self.n = len(bounds) - 1
        self.rows = np.searchsorted(row, np.arange(self.n + 1))
        self.query = [t[np.lexsort((t, -w))[:QUERY]] for t, w in ((token[a:b], weight[a:b]) for a, b in zip(self.rows, self.rows[1:], strict=False))]
        order = np.argsort(token, kind="stable")
        self.names, self.lists = np.unique(token[order], return_index=True)
        self.lists = np.append(self.lists, len(order))
        self.row, self.weight = row[order], weight[order]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every rest for the seed's most telling tokens."""
        at = np.searchsorted(self.names, self.query[seed])
        found = spread(self.lists[at], self.lists[at + 1] - self.lists[at])
        return np.bincount(self.row[found], self.weight[found], self.n)


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, the largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def windows(index: Index, sizes: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (rest, start, length): all rests, each id once."""
    left, out = sizes.copy(), []
    seed, sequence, gap = -1, [], window

    def place(i: int, n: int) -> None:
        nonlocal gap
        sequence.append((i, int(sizes[i] - left[i]), n))
        left[i] -= n
        gap -= n

    while left.any():
        if seed < 0 or not left[seed]:
            seed = int(np.flatnonzero(left)[0])
        place(seed, int(left[seed]))  # under a window, as no rest is longer
        order = np.argsort(-index.scores(seed), kind="stable")
        order = order[left[order] > 0]
        while gap and len(order):
            fits = left[order] <= gap
            k = int(fits.argmax()) if fits.any() else 0
            seed = int(order[k])  # what a cut leaves is the next seed
            place(seed, min(gap, int(left[seed])))
            order = np.delete(order, k) if not left[seed] else order
        if not gap:
            out.append(sequence)
            sequence, gap = [], window
    queue = sequence[::-1]
    for size in powers(window - gap):
        part = []
        while size:
            i, start, n = queue.pop()
            take = min(n, size)
            part.append((i, start, take))
            size -= take
            if take < n:
                queue.append((i, start + take, n - take))
        out.append(part)
    return out


_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _pack(weights: Weights, vocabulary: int, window: int):
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("hash", "ascending")]).combine_chunks()
        column = lambda c: table.column(c).combine_chunks()
        docs, tokens, fulls = column("doc_id").to_pylist(), column("doc_tokens").to_pylist(), column("fulls").to_pylist()
        ids, bounds = rests(column("rest"), kind)
        base, lines = table.column("shard")[0].as_py() << 32, []
        for d, full, n in zip(docs, fulls, tokens, strict=True):
            for k, value in enumerate(full):
                lines.append((d, k * window, window, value, n, base + len(lines), 0))
        number = base + len(lines)
        for sequence in windows(Index(ids, bounds, weights, vocabulary), np.diff(bounds), window):
            offset = 0
            for i, start, length in sequence:
                at = bounds[i] + start
                lines.append((docs[i], len(fulls[i]) * window + start, length, crc(ids[at : at + length]), tokens[i], number, offset))
                offset += length
            number += 1
        names = [x.split()[0] for x in _PIECES.split(", ")]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*lines, strict=True)], names=names)

    return run


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, shard: int = SHARD) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a tokenizer file that every machine has. sequence_id holds the shard and the sequence's place
    in it.
    """
    spark = documents.sparkSession
    vocabulary = word_ids(tokenizer).size
    coded = save(documents.select("doc_id", "text").mapInArrow(_encode(tokenizer, vocabulary, window, end), _TOKENS), "packing_tokens")
    sums = coded.where("counts is not null").select("counts").mapInArrow(_sum_counts, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    counts = np.zeros(2 + vocabulary, np.int64)
    for r in sums.collect():  # at most one for each token
        counts[r["at"]] = r.n
    weights = Weights(counts, shard)
    rows = coded.where("rest is not null").select("doc_id", "doc_tokens", "fulls", "rest")
    told = rows.select("rest").mapInArrow(_tell(weights, vocabulary, []), "token int").groupBy("token").count().collect()  # at most one for each token
    begins, bounds = 0, []
    for r in sorted(told):
        bounds.append((r.token, begins, r["count"]))
        begins += r["count"]
    begin = spark.createDataFrame(bounds, "token int, begin bigint, n bigint")
    spot = F.col("begin") + F.pmod("hash", F.col("n"))
    placed = rows.mapInArrow(_tell(weights, vocabulary, rows.columns), "doc_id bigint, doc_tokens bigint, fulls array<bigint>, rest binary, token int")
    placed = placed.withColumn("hash", F.xxhash64("doc_id", "doc_tokens", "rest")).join(F.broadcast(begin), "token")  # at most a row for each token
    placed = placed.withColumn("shard", F.floor(spot / shard)).drop("token", "begin", "n")
    packed = save(placed.groupBy("shard").applyInArrow(_pack(weights, vocabulary, window), _PIECES), "packing_pieces")
    release(coded)
    return packed
