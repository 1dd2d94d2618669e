"""Substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np

from tidemark.llm.natives import row_keys
from tidemark.llm.reference_parse import factor_table, factors, reference_dedup
from tidemark.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, lang string, starts int, n string"


def corpus(seed):
    r = random.Random(seed)
    vocab = ["a", "of", "the", "thé", "ün", "zeta", "word", "ñandú", "x" * 9]
    text = lambda n: " ".join(r.choice(vocab) + r.choice(["", ".", "é", "-"]) for _ in range(n))
    shared = [text(60) for _ in range(4)]
    docs = [text(r.randint(0, 40)) + r.choice([" ", "\n\t", ""]) + r.choice(shared)[r.randint(0, 60) :] + " " + text(r.randint(0, 30)) for _ in range(40)]
    docs += [docs[3], docs[3], docs[5] + " tail of it", "", None, "ab" * 400, "the " * 300, shared[0] + " " + shared[0], " \n "]
    rows = [(i, t, None, 1, "x") for i, t in enumerate(docs)]
    r.shuffle(rows)
    return rows


def brute_bytes(rows, length):
    from collections import Counter

    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, window):
    texts = sorted((d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t, *_ in rows)
    seen, out = set(), []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if (g := tuple(w[i : i + window])) in seen:
                gone[i : i + window] = [True] * window
            seen.add(g)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_bytes_match_brute_force(spark):
    for seed, length in ((1, 200), (2, 48), (3, 16)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, length).collect()), key=str)
        assert got == brute_bytes(rows, length)


def test_words_match_brute_force(spark):
    for seed, window in ((1, 20), (2, 20), (3, 12)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in reference_dedup(df, window).collect()), key=str)
        assert got == brute_words(rows, window)


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "y" * 300), (1, "y" * 300), (None, "q z " * 90), (None, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup(df).collect()} == {(1, 300, 300), (None, 360, 360), (None, 0, 0)}
    assert suffix_dedup(df).count() == 4 and reference_dedup(df).count() == 4
    none = df.limit(0)
    assert suffix_dedup(none).count() == 0 and reference_dedup(none).count() == 0


def test_factors_are_earlier_and_equal(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t, *_ in rows}
    of = {(r.key, r.more): r.doc_id for r in df.groupBy(*row_keys("text")).agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "doc_id").collect()}
    seen = 0
    for r in factor_table(df, 12).collect():
        d, last = of[r.key, r.more], -1
        for a, b, ref, q in zip(r.starts, r.ends, r.refs, r.ref_starts, strict=True):
            assert b - a >= 12 and a > last and (ref, q) < (d, a)
            assert words[d][a:b] == words[ref][q : q + b - a]
            seen, last = seen + 1, a
    assert seen > 20


def test_longest_reference_wins():
    # phrases 0..9 of the document: 0-3 lie at reference 1, 1-9 at reference 2, which also holds phrase 0 just before
    ids = np.arange(100, 110, dtype=np.int32)
    blocks = {(1, 0, 0): np.array([100, 101, 102, 103, 7], np.int32), (2, 0, 0): np.arange(99, 110, dtype=np.int32)}
    runs = [(0, 2, 11, 1, 0, 0), (2, 8, 12, 2, 0, 3)]
    assert factors(ids, runs, blocks, 5) == [(0, 14, 12, 1)]
    assert factors(ids, runs, {}, 5) == [(0, 6, 11, 0), (2, 14, 12, 3)]
    assert factors(ids, [(0, 2, 11, 1, 0, 0), (6, 3, 12, 2, 0, 7)], {}, 5) == [(0, 6, 11, 0), (6, 13, 12, 7)]
