"""Packing: pieces put together again, and neighbours against plain BM25."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from tidemark.llm.packing import B, K1, QUERY, Index, Weights, pack, powers, windows

PATH = public_tokenizers.path("word_bpe_49k.json")
ROW = "doc_id long, text string, token string, shard int, hash string, length string"


def encode(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def put_together(docs, pieces, window=2048):
    """Checks that the pieces hold each id of each row once and fill sequences; returns sequences as (doc_id, length) lists."""
    ids = defaultdict(list)
    for (d, _), made in zip(docs, encode([t for _, t in docs]), strict=True):
        ids[d].append(made)
    sums, left = Counter(), defaultdict(list)
    for r in pieces.itertuples():
        fits = [made for made in ids[r.doc_id] if len(made) == r.doc_tokens and zlib.crc32(np.array(made[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert fits and r.length > 0
        sums[r.doc_id] += r.length
        left[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert sums == Counter({d: sum(map(len, x)) for d, x in ids.items()})
    for d, spans in left.items():
        copies = Counter(x for s, n, _ in spans for x in range(s, s + n))
        assert all(copies[x] == sum(x < len(m) for m in ids[d]) for x in copies)
    out = []
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all()
        total = own.length.sum()
        assert total <= window and total & (total - 1) == 0  # no padding at all
        out.append(list(zip(own.doc_id, own.length, strict=True)))
    return out


@pytest.mark.parametrize("shard", [1024, 40])
def test_pieces_hold_every_id_once(spark, shard):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(int(d), t) for d, t in zip(docs.doc_id, docs.text, strict=True)]
    made = pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3), PATH, shard=shard)
    sequences = put_together(rows, made.toPandas())
    assert sum(sum(n for _, n in s) == 2048 for s in sequences) > 0.9 * len(sequences) - 11 * (200 // shard + 1)


def test_odd_rows(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdeé'1.,ßİ") for _ in range(r.randrange(1, 9)))
    texts = [None, "", " \t", "a<|endoftext|>b", "Don't STOP\x1fnow 12345", " ".join(word() for _ in range(60_000)), "x" * 30_000, "ab " * 300_000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "a<|endoftext|>b"), (3, "other"), (None, "nobody's text")]
    made = pack(spark.createDataFrame([(d, t, "x", 1, None, "y") for d, t in docs], ROW), PATH).toPandas()
    assert made[made.doc_id.isna()].length.sum() == len(encode(["nobody's text"])[0])
    whole = made.assign(doc_id=made.doc_id.fillna(-1).astype("int64"))
    put_together([(-1 if d is None else d, t) for d, t in docs], whole)


def test_empty_table(spark):
    got = pack(spark.createDataFrame([], ROW), PATH)
    assert got.collect() == [] and got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_neighbours_match_plain_bm25():
    r = random.Random(8)
    docs = [[r.randrange(40) if r.random() < 0.6 else 40 + 10 * (i % 4) + r.randrange(10) for _ in range(r.randrange(5, 60))] for i in range(50)]
    n, has = len(docs), Counter(t for d in docs for t in set(d))
    counts = np.array([n, sum(map(len, docs)), *(has[t] for t in range(80))])
    mean = counts[1] / n

    def weight(t, d):
        c = d.count(t)
        return math.log(1 + (n - has[t] + 0.5) / (has[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(d) / mean)) if c else 0.0

    bounds = np.cumsum([0, *map(len, docs)])
    index = Index(np.concatenate([np.array(d) for d in docs]), bounds, Weights(counts, 5), 80)
    for i, d in enumerate(docs):
        query = sorted(set(d), key=lambda t: (-weight(t, d), t))[:QUERY]
        assert np.allclose(index.scores(i), [sum(weight(t, e) for t in query) for e in docs])
    packed = windows(index, np.diff(bounds), 128)
    assert Counter({i: len(d) for i, d in enumerate(docs)}) == sum((Counter({i: k}) for s in packed for i, _, k in s), Counter())
    first = packed[0]
    assert first[0][0] == 0
    gap, free = 128 - len(docs[0]), [j for j in np.argsort(-index.scores(0), kind="stable") if j]
    for j, _, k in first[1:]:
        fits = [x for x in free if len(docs[x]) <= gap]
        want = fits[0] if fits else free[0]
        assert (j, k) == (want, min(gap, len(docs[want])))
        free.remove(want)
        gap -= k
    assert powers(2048 - 1) == [1 << k for k in range(10, -1, -1)] and powers(0) == []


def test_windows_hold_like_documents(spark):
    r = random.Random(3)
    topics = [[f"{a}{b}ing" for b in "bcdfghjklm"] for a in ("ta", "po", "ri", "mu")]
    docs = [(i, " ".join(r.choice(topics[i % 4] if r.random() < 0.7 else topics[r.randrange(4)]) for _ in range(150))) for i in range(200)]
    made = pack(spark.createDataFrame([(*d, "x", 1, None, "y") for d in docs], ROW), PATH).toPandas()
    sequences = [s for s in put_together(docs, made) if sum(n for _, n in s) == 2048]
    share = [max(Counter(d % 4 for d, _ in s).values()) / len(s) for s in sequences]
    assert np.mean(share[: len(share) // 2]) > 0.8 and np.mean(share) > 0.6


def test_query_is_registered():
    assert "op12_packing" in __spark_entry__.queries()
