"""MinHash near-dedup with bottom-k sketches from one hash function.

Shingles are five words, hashed once; a document's sketch keeps its K least hashes. Documents with equal sets
form one class. Inverted lists of retained values generate the overlaps between classes, the sketch of the
union estimates their similarity and drops pairs far below the threshold, and the full sets decide.

Result rules: A-Z are lower-cased, words are runs of bytes other than \\x20 and \\x09-\\x0D. With fewer words
than a shingle has, the whole sequence is the one element; without words (or with a null text) the set is empty
and linked with nothing. Rows that share a doc_id are one node; rows without doc_id are linked with nothing
and kept. Columns of the input other than doc_id and text are ignored.

No list is cut. Each class sorts the values of its sketch from rare to frequent and enters the lists of only so
many of them that two linked classes must meet in one (prefix rule, with the rank of the value bounding what a pair
can still share). Lists of up to SHORT classes give their pairs. The classes of longer lists are taken up with their
full sets, in the same way: rank by rarity among themselves, prefix, lists. A class leaves a list in which none can
reach the threshold with it: two that first meet there share at most what either has from that rank on. So documents
that only share a template never meet. Then each list first links its members to one of them for ROUNDS rounds; lists
inside one component end. The classes that the rest connect are compared in full, those outside the largest component
of their group with all of it. The one inexact step is the sketch of a
union: a pair at the threshold falls below the least overlap it asks for with a chance of under CHANCE; sets of up to K
shingles are compared exactly.

At scale: counts are combined before the shuffle, joins with them read written tables that adaptive execution can
split. A group is dealt out in blocks, so no task holds one whole. Texts and sketches that no pair names are screened
out by a bitmap of fixed size before they would be shuffled. A text is known by its doc_id and a hash together.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components, extended
from tidemark.llm.natives import screened
from tidemark.llm.vectortext import LOWER, U, grams, mix, pieces, prefix_hash, signed, substring_hash, word_hashes, words
from tidemark.llm.worktables import save

WORDS = 5
PERCENT = 75
K = 64
SHORT = 32
ROUNDS = 2
#: lists of full sets that a class links through in one round
TRIED = 8
#: members of a block when what is left of a group is compared in full
BLOCK = 512
CHANCE = 1e-11
#: ratio of set sizes that are judged together
STEP = 1.02


def least_overlap(percent: int, k: int = K) -> int:
    """Values of k that a union's sketch shares at least, but for CHANCE, if the sets reach percent."""
    t, total = percent / 100, 0.0
    for m in range(k + 1):
        total += comb(k, m) * t**m * (1 - t) ** (k - m)
        if total > CHANCE:
            return m
    return k


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (63 bits, ascending within a row) and the bounds of each row."""
    data = LOWER[data]
    starts, ends, row = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    m = len(hashes) - size + 1
    whole = np.flatnonzero(row[:m] == row[size - 1 :]) if m > 0 else np.zeros(0, np.int64)
    value, of = grams(hashes, size)[whole], row[whole]
    n = len(offsets) - 1
    bound = np.searchsorted(row, np.arange(n + 1))
    few = np.flatnonzero((np.diff(bound) > 0) & (np.diff(bound) < size))
    if len(few):
        value = np.concatenate([value, substring_hash(prefix_hash(hashes), bound[few], bound[few + 1])])
        of = np.concatenate([of, few])
    value = value >> U(1)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    return value, np.searchsorted(of, np.arange(n + 1))


def _lists(value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.ListArray:
    n = hi - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), signed(value[at]))


def _sketch_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("text")):
                value, bound = shingle_sets(data, offsets, size)
                lo, hi = bound[:-1], bound[1:]
                total = lambda x: np.diff(np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)])[bound])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        batch.column("key").slice(i, j - i),
                        signed(hi - lo),
                        signed(total(mix(value))),
                        signed(total(mix(value ^ U(0x5851F42D4C957F2D)))),
                        _lists(value, lo, np.minimum(hi, lo + K)),
                    ],
                    names=["doc_id", "key", "n", "one", "two", "sketch"],
                )

    return run


def _set_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("text")):
                value, bound = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), _lists(value, bound[:-1], bound[1:])], names=["node", "members"])

    return run


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs(a, b) with column of table (by node) of either, as x and y."""
    one = pairs.join(table.select(F.col("node").alias("a"), F.col(column).alias("x")), "a")
    return one.join(table.select(F.col("node").alias("b"), F.col(column).alias("y")), "b")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose union sketch doesn't rule out the threshold; a union of fewer than K values is known whole."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    both = _with_both(pairs, screened(classes, named, "node"), "sketch")
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, K)
    shared = F.size(F.array_intersect(union, F.array_intersect("x", "y")))
    return both.where(F.when(F.size(union) < K, 100 * shared >= percent * F.size(union)).otherwise(shared >= least_overlap(percent))).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    shared = F.size(F.array_intersect("x", "y"))
    return _with_both(pairs, sets, "members").where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that roots doesn't already connect."""
    ra, rb = roots.select(F.col("u").alias("a"), F.col("root").alias("p")), roots.select(F.col("u").alias("b"), F.col("root").alias("q"))
    return pairs.join(ra, "a", "left").join(rb, "b", "left").where("coalesce(p, a) <> coalesce(q, b)").select("a", "b")


def ranked(each: DataFrame, keep: Column) -> DataFrame:
    """each(value, node, n, s): the rows to enter, with the list's size and the value's rank in its node from rare to
    frequent, from 0. s values a node, and keep, over n, s and rank, says which ranks enter. Values of one node never do."""
    lists = save(each.groupBy("value").agg(F.count("*").alias("size")).where("size > 1"), "lists")
    held = each.join(lists, "value").groupBy("node", "n", "s").agg(F.array_sort(F.collect_list(F.struct("size", "value"))).alias("held"))
    out = held.select("node", "n", "s", (F.col("s") - F.size("held")).alias("single"), F.posexplode("held").alias("k", "h"))
    out = out.select("h.value", "node", "n", "s", "h.size", (F.col("single") + F.col("k")).alias("rank"))
    return out.where(keep)


def reaching(entries: DataFrame, percent: int) -> DataFrame:
    """The entries(value, node, n, rank) that some other entry of their list can reach the threshold with.

    Two sets whose first common value has ranks i and j share at most min(n - i, m - j) values, and need
    percent / (100 + percent) of n + m. Sizes are put in steps of STEP, so that lists are judged by their steps' counts,
    least sizes and largest rests: none that can link is lost.
    """
    step = F.floor(F.log("n") / log(STEP)).cast("int")
    entries = entries.withColumn("_q", step)
    steps = save(entries.groupBy("value", "_q").agg(F.count("*").alias("c"), F.min("n").alias("low"), F.max(F.col("n") - F.col("rank")).alias("rest")), "steps")
    reach = ceil(log(100 / percent) / log(STEP)) + 1
    large = steps.select("value", F.col("_q").alias("big"), F.col("c").alias("big_c"), F.col("low").alias("big_low"), F.col("rest").alias("big_rest"), F.explode(F.sequence(F.col("_q") - reach, F.col("_q"))).alias("_q"))
    both = large.join(steps, ["value", "_q"]).where((F.col("_q") != F.col("big")) | (F.col("c") > 1))
    both = both.where((100 + percent) * F.least("rest", "big_rest") >= percent * (F.col("low") + F.col("big_low")))
    keep = save(both.select("value", F.explode(F.array("_q", "big")).alias("_q")).distinct(), "reaching")
    return entries.join(keep, ["value", "_q"]).drop("_q")


class _Linker:
    """Confirms pairs against the full sets of the classes they name."""

    def __init__(self, rows: DataFrame, classes: DataFrame, size: int, percent: int):
        self.rows, self.classes, self.size, self.percent = rows, classes, size, percent
        self.roots = save(classes.where("false").select(F.col("node").alias("u"), F.col("node").alias("root")), "roots")

    def sets(self, nodes: DataFrame) -> DataFrame:
        keys = save(self.classes.select("node", "key").join(nodes, "node"), "named")
        texts = screened(self.rows, keys, "key").join(keys.withColumnRenamed("node", "doc_id"), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
        return save(texts.select(F.col("doc_id").alias("node"), "text").mapInArrow(_set_batches(self.size), "node long, members array<long>"), "sets")

    def add(self, pairs: DataFrame, sets: DataFrame | None = None) -> None:
        """First one pair for each class, then what these leave between components."""
        pairs = save(likely(pairs, self.classes, self.percent), "pairs")
        if pairs.isEmpty():
            return
        if sets is None:
            sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        self._merge(confirmed(first, sets, self.percent))
        self._merge(confirmed(_across(pairs, self.roots), sets, self.percent))

    def open_lists(self, entries: DataFrame) -> DataFrame:
        """entries(value, node, ...) of the lists that still span components, with the members' root."""
        of = save(entries.join(self.roots.select(F.col("u").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
        spans = of.groupBy("value").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.count("*").alias("members")).where("p <> q")
        return save(of.join(save(spans.select("value", "members"), "spans"), "value"), "open")

    def link_frequent(self, nodes: DataFrame) -> None:
        """All links among nodes, from their full sets."""
        p = self.percent
        sets = self.sets(nodes)
        each = sets.select(F.explode("members").alias("value"), "node", F.size("members").alias("n"), F.size("members").alias("s"))
        entries = save(ranked(each, 100 * (F.col("n") - F.col("rank")) >= p * F.col("n")), "entries")
        met = save(entries.groupBy("value").agg(F.count("*").alias("c")).where("c > 1").select("value"), "met")
        entries = save(entries.join(met, "value").select("value", "node", "n", "rank", "size"), "entries")
        entries = save(reaching(entries, p), "entries")
        tried = entries.where(F.col("rank") > F.floor(F.col("n") * (100 - p) / 100) - TRIED)
        for turn in range(ROUNDS):
            open_ = self.open_lists(tried)
            if open_.isEmpty():
                break
            hub = open_.groupBy("value").agg(F.min_by(F.struct(F.col("node").alias("hub"), F.col("root").alias("other")), F.xxhash64("node", F.lit(turn))).alias("h"))
            star = open_.join(save(hub.select("value", "h.*"), "hubs"), "value").where("root <> other")
            self.add(save(star.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "star"), sets)
        self.compare(self.open_lists(entries), sets)

    def compare(self, lists: DataFrame, sets: DataFrame) -> None:
        """Links across components among classes that open lists connect, from their full sets, block by block.

        Each class outside the largest component of its group is compared with the whole group; what is shuffled is
        a copy of each set for each block of the other side, and what comes out of two blocks fewer links than they have
        classes.
        """
        if lists.isEmpty():
            return
        groups = components(lists.select(F.col("node").alias("a"), (-1 - F.col("value")).alias("b"))).select(F.col("u").alias("node"), F.col("root").alias("g"))
        of = save(lists.select("node", "root").distinct().join(groups, "node"), "groups")
        sizes = save(of.groupBy("g", "root").agg(F.count("*").alias("c")), "sizes").groupBy("g").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("inside"))
        blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        sizes = save(sizes.select("g", "main", blocks(F.col("all") - F.col("inside")).alias("lefts"), blocks(F.col("all")).alias("rights")), "blocks")
        of = save(of.join(sizes, "g").join(sets, "node"), "members")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        left = of.where("root <> main").select("g", own("lefts").alias("i"), every("rights").alias("j"), "node", "root", "members")
        right = of.where("lefts > 0").select("g", every("lefts").alias("i"), own("rights").alias("j"), "node", "root", "members")
        keys = ["g", "i", "j"]
        self._merge(left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(_linked_blocks(self.percent), "a long, b long"))

    def _merge(self, links: DataFrame) -> None:
        links = save(links, "links")
        if not links.isEmpty():
            self.roots = extended(self.roots, links)


def _linked_blocks(percent: int):
    """Links between two blocks of one group, enough to connect all that is linked."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            sizes = right["members"].map(len).to_numpy()
            values = np.concatenate(right["members"].to_list())
            order = np.argsort(values, kind="stable")
            values, owner = values[order], np.repeat(np.arange(len(right)), sizes)[order]
            nodes = right["node"].to_numpy()
            _, spot = np.unique(np.concatenate([left["root"], right["root"]]), return_inverse=True)
            part, mine = np.arange(spot.max() + 1), spot[len(left) :]  # components as far as this block has linked them
            for node, root, members in zip(left["node"], spot, left["members"], strict=False):
                lo, hi = np.searchsorted(values, members, "left"), np.searchsorted(values, members, "right")
                hits = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
                shared = np.bincount(owner[hits], minlength=len(right))
                k = np.flatnonzero(100 * shared >= percent * (sizes + len(members) - shared))
                met, once = np.unique(part[mine[k]], return_index=True)
                new = met != part[root]
                out += [(node, b) for b in nodes[k[once[new]]].tolist()]
                part[np.isin(part, met)] = part[root]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(documents: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each row of documents: doc_id, n_shingles, component_id, kept, class_id (least doc_id with an
    equal set), n_class (rows in it)."""
    rows = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    base = save(rows.mapInArrow(_sketch_batches(size), "doc_id long, key long, n long, one long, two long, sketch array<long>"), "sketches")
    known = base.where("n > 0 and doc_id is not null")
    classes = known.groupBy("one", "two").agg(F.min(F.struct("doc_id", "key")).alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
    classes = save(classes.select(F.col("least.doc_id").alias("node"), "least.key", "one", "two", "n", "sketch", "copies"), "classes")

    least = least_overlap(percent)
    each = classes.select(F.explode("sketch").alias("value"), "node", "n", F.size("sketch").alias("s"))
    left = F.col("s") - F.col("rank")
    entries = save(ranked(each, F.when(100 * F.col("n") <= percent * K, 100 * left >= percent * F.col("n")).otherwise(left >= least)), "entries")
    # a list has at most as many entries as classes have the value in their sketch
    frequent = entries.where(F.col("size") > SHORT)
    filled = save(frequent.groupBy("value").agg(F.count("*").alias("c")).where("c > 1"), "filled")
    frequent = save(frequent.join(filled, "value"), "frequent")
    columns = ["value", "node", "n", "s", "rank"]
    short = entries.where(F.col("size") <= SHORT).select(columns).unionByName(frequent.where(F.col("c") <= SHORT).select(columns))
    pairs = short.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("node", "n", "s", "rank"))).alias("of"))
    pairs = pairs.select(F.posexplode("of").alias("i", "a"), "of").select("a", F.explode(F.slice("of", F.col("i") + 2, SHORT)).alias("b"))
    small, big, rest = F.least("a.n", "b.n"), F.greatest("a.n", "b.n"), F.least(F.col("a.s") - F.col("a.rank"), F.col("b.s") - F.col("b.rank"))
    meets = (100 * small >= percent * big) & F.when(big <= K, (100 + percent) * rest >= percent * (small + big)).otherwise(rest >= least)
    pairs = pairs.where(meets).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    linker = _Linker(rows, classes, size, percent)
    linker.add(save(pairs, "overlaps"))
    heavy = save(frequent.where(F.col("c") > SHORT).select("node").distinct(), "heavy")
    if not heavy.isEmpty():
        linker.link_frequent(heavy)

    found = classes.select("one", "two", F.col("node").alias("class_id"), F.col("copies").alias("n_class"), F.col("node").alias("u")).join(linker.roots, "u", "left")
    found = save(found.select("one", "two", "class_id", "n_class", F.coalesce("root", "class_id").alias("root")), "found")
    alone = F.col("doc_id").isNotNull() & (F.col("n") == 0)
    return base.select("doc_id", "n", "one", "two").join(found, ["one", "two"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"),
        (alone | F.col("doc_id").isNull() | (F.col("doc_id") == F.col("root"))).alias("kept"),
        F.when(alone, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"),
        F.when(F.col("n") > 0, F.col("n_class")).alias("n_class"),
    )
