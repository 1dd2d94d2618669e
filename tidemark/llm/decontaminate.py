"""Benchmark decontamination by pigeonhole edit matching.

An item may occur with up to `budget` edits. Cut into budget + 1 pieces, at least one piece survives unedited,
so exact piece hits (an Aho-Corasick automaton over all pieces) propose places, and Myers' bit-parallel edit
distance verifies the item there.

Result rules: texts and items are lower-cased and their runs of white space become one space; offsets count
code points of that form. budget is RATE of the item's length, but no more than leaves pieces of PIECE
characters. Null or blank items and texts match nothing. Of several places the one with the least distance
counts, then the first. Repeated rows of documents share their result; rows of benchmark with equal item_id are
judged apart and the best counts. Other columns are ignored.

At scale: documents are read once for each block of BLOCK_CHARS characters of benchmark and never shuffled; a
block is what is sent to the tasks, so that its size is bounded however large the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.natives import row_keys

RATE = 0.05
PIECE = 16
BLOCK_CHARS = 2_000_000


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def budget_of(length: int) -> int:
    return max(0, min(int(length * RATE), length // PIECE - 1))


def pieces_of(item: str) -> list[tuple[int, str]]:
    """budget + 1 pieces with their offsets, as even as they can be."""
    n, k = len(item), budget_of(len(item)) + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> list[int]:
    """Least distance of pattern to any substring of text that ends after each character."""
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    top = 1 << len(pattern) - 1
    plus, minus, score, out = full, 0, len(pattern), []
    for c in text:
        e = eq.get(c, 0)
        vertical = e | minus
        horizontal = (((e & plus) + plus) ^ plus) | e
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        out.append(score)
    return out


def best_match(item: str, text: str, lo: int, hi: int) -> tuple[int, int, int]:
    """Distance, start and end of the best place of item in text[lo:hi]."""
    ends = myers(item, text[lo:hi])
    distance = min(ends, default=len(item))
    end = ends.index(distance) + 1 if ends else 0
    starts = myers(item[::-1], text[lo : lo + end][::-1])
    length = starts.index(min(starts)) + 1 if starts else 0
    return distance, lo + end - length, lo + end


def automaton(items: list[tuple[int, str]]) -> ahocorasick.Automaton:
    found: dict[str, list[tuple[int, int]]] = {}
    for k, (_, text) in enumerate(items):
        for at, piece in pieces_of(text):
            found.setdefault(piece, []).append((k, at))
    out = ahocorasick.Automaton()
    for piece, where in found.items():
        out.add_word(piece, (len(piece), where))
    out.make_automaton()
    return out


def matches(text: str, items: list[tuple[int, str]], machine: ahocorasick.Automaton) -> dict[int, tuple[int, int, int]]:
    """Best place of each item that text holds within its budget, by item_id."""
    places: dict[int, set[int]] = {}
    for end, (length, where) in machine.iter(text):
        for k, at in where:
            places.setdefault(k, set()).add(end - length + 1 - at)
    out: dict[int, tuple[int, int, int]] = {}
    for k, starts in places.items():
        item_id, item = items[k]
        n, budget = len(item), budget_of(len(item))
        lo = hi = None
        for s in [*sorted(starts), None]:
            if lo is not None and (s is None or s - budget > hi):
                if (got := best_match(item, text, max(0, lo), min(len(text), hi)))[0] <= budget:
                    out[item_id] = min(got, out.get(item_id, got))
                lo = None
            if s is not None:
                lo, hi = s - budget if lo is None else lo, s + n + budget
    return out


def _match_batches(items: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(items)
        for batch in batches:
            out = []
            for doc, key, more, text in zip(*(batch.column(c) for c in ("doc_id", "key", "more", "text")), strict=True):
                if (t := text.as_py()) and (found := matches(plain(t), items, machine)):
                    out += [(doc.as_py(), key.as_py(), more.as_py(), item, *place) for item, place in found.items()]
            if out:
                cols = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "key", "more", "item_id", "n_errors", "start", "end"])

    return run


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item it holds: doc_id, key and more (row_keys of doc_id and text),
    item_id, n_errors, start, end."""
    schema = "doc_id long, key long, more int, item_id long, n_errors int, start long, end long"
    rows = documents.select("doc_id", "text", *row_keys("doc_id", "text"))
    items = benchmark.where("trim(text) <> ''").select("item_id", "text")
    blocks = 1 + (items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // BLOCK_CHARS)
    out = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        block = [(r.item_id, t) for r in block if (t := plain(r.text))]
        if block:
            part = rows.mapInArrow(_match_batches(block), schema)
            out = part if out is None else out.unionByName(part)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out
