"""Vector codes and hard negatives against plain Python and against SQL."""

import hashlib
import math
import random

import numpy as np
import pytest
from oracle import expected, found

import __spark_entry__
from tidemark.llm.hard_negatives import mine_negatives
from tidemark.llm.vector_codes import compress, digest

ROW = "vec_id long, embedding array<float>, label int, vector string, entry int"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_hard_negatives"])
def test_query_matches_sql(spark, name, sf):
    if sf == "sf0.1" and name == "op11_vector_codes":
        sf = "sf0.01"
    d = f"/root/testdata/{sf}"
    assert found(__spark_entry__.queries()[name](spark, d)) == expected(__spark_entry__.oracle_sql()[name], d)


def odd_rows(n, width, seed, coarse):
    """Rows with ties, copies, nulls, and components that are no numbers."""
    r = random.Random(seed)
    point = lambda: [r.randrange(-2, 3) / coarse for _ in range(width)]
    rows = [(i, point(), r.choice([0, 1, 2, None]), "x", 1) for i in range(n)]
    rows += rows[:7] + [(3, point(), 1, "x", 1)]
    rows += [(n + 1, None, 1, None, None), (n + 2, [*point()[:-1], None], 1, "x", 1), (n + 3, [float("nan")] * width, 0, "x", 1), (n + 4, [float("-inf")] * width, 0, "x", 1), (None, point(), 2, "x", 1), (None, point(), None, "x", 1)]
    r.shuffle(rows)
    return rows


def sound(row):
    return row[1] is not None and all(x is not None and math.isfinite(x) for x in row[1])


def plain_codes(rows, scale, parts, entries, rounds):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label, *_ in filter(sound, rows)]
    width = max(len(v) for _, v, _ in kept)
    length = -(-width // parts)
    kept = [(i, v + [0] * (parts * length - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[r[1][p * length : (p + 1) * length] for r in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(v[p * length : (p + 1) * length], books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(v, p) for _, v, _ in kept]
            for e in range(len(books[p])):
                if members := [v[p * length : (p + 1) * length] for (_, v, _), o in zip(kept, own, strict=True) if o == e]:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out, by_label = [], {}
    for i, v, label in kept:
        code = [near(v, p) for p in range(parts)]
        error = sum(far(v[p * length : (p + 1) * length], books[p][e]) for p, e in enumerate(code))
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e in code), error, label))
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return sorted(((i, c, e, by_label[label]) for i, c, e, label in out), key=str), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("width", "coarse", "entries"), [(16, 8, 16), (13, 3, 5), (8, 1, 16)])
def test_codes_match_plain_rounds(spark, width, coarse, entries):
    rows = odd_rows(60, width, width, coarse)
    df = spark.createDataFrame(rows, ROW).repartition(3)
    coded, books, _ = compress(df, scale=16, entries=entries)
    want, sha = plain_codes(rows, 16, 8, entries, 6)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()), key=str) == want
    assert digest(books) == sha


def test_bounds_save_distances(spark):
    r = np.random.default_rng(5)
    centre = r.normal(size=(16, 16)) * 3
    rows = [(i, (centre[i % 16] + r.normal(size=16) * 0.05).tolist(), i % 3, "x", 1) for i in range(800)]
    _, _, counts = compress(spark.createDataFrame(rows, ROW))
    assert counts[0] == 800 * 8 * 16 and all(c < counts[0] / 3 for c in counts[1:])


def test_few_and_no_rows(spark):
    rows = [(5, [1.0, 2.0], None, "x", 1), (4, [3.0], 1, "x", 1), (6, None, 1, "x", 1)]
    coded, books, _ = compress(spark.createDataFrame(rows, ROW))
    assert {(r.vec_id, r.code, r.error) for r in coded.collect()} == {(4, "0000" + "00" * 6, 0), (5, "0101" + "00" * 6, 0)} and books.shape[:2] == (8, 2)
    none = spark.createDataFrame(rows[2:], ROW)
    assert compress(none)[0].collect() == [] and mine_negatives(none).collect() == []
    assert compress(none)[0].columns == ["vec_id", "label", "code", "error", "label_error"]


def plain_negatives(rows, scale, every, k, low):
    kept = [(n, i, [math.floor(scale * x) for x in v], label) for n, (i, v, label, *_) in enumerate(filter(sound, rows)) if i is not None and label is not None]
    out = []
    for n, a, v, label in kept:
        if a % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, own) for m, i, w, own in kept if m != n)
            for score, i, _ in [s for s in scored if s[2] == label][:k]:
                within = [s for s in scored if s[2] != label and low * -score <= 100 * -s[0] <= 100 * -score][:k]
                out += [(a, i, j, other, -score, -s) for j, (s, other, _) in enumerate(within, 1)]
    return sorted(out)


@pytest.mark.parametrize(("every", "chunk", "coarse"), [(10, 3, 1), (7, 100, 2), (3, 11, 4)])
def test_negatives_match_plain_sort(spark, every, chunk, coarse):
    rows = odd_rows(90, 6, every, coarse)
    df = spark.createDataFrame(rows, ROW).repartition(4)
    got = mine_negatives(df, scale=8, every=every, chunk=chunk)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == plain_negatives(rows, 8, every, 5, 80)
    assert dict(got.dtypes)["rank"] == "int"
