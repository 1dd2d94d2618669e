"""Near duplicates against brute force over all pairs."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.near_dups import near_duplicates, ranked, reaching


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {(d, len(sets[d]), find(d), find(d) == d) for d in ids}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[r.randrange(len(words))] = r.choice(vocab)
        return words

    base, passage = text(120), text(60)
    docs = [edited(base, r.randint(0, 6)) for _ in range(90)]
    docs += [passage + text(r.randint(5, 40)) for _ in range(60)]
    docs += [text(r.randint(1, 12)) for _ in range(20)] + [text(4)] * 3
    for _ in range(12):
        words = text(r.randint(8, 300))
        docs += [words, edited(words, 1), edited(words, len(words) // 25), [w.upper() for w in words]]
    texts = [r.choice([" ", "\n", " \t"]).join(w) for w in docs] + ["", None, "  "]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, 1, None) for d, t in rows], "doc_id long, text string, n int, node string").repartition(3)
        got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
        assert got == brute(rows)


def check(spark, texts):
    rows = list(enumerate(texts))
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)
    return {d: c for d, _, c, _ in got}


def test_links_by_frequent_passages_alone(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [f"{passage} " + " ".join(f"d{k}w{i}" for i in range(10)) for k in range(40)]
    got = check(spark, [*docs, passage + " x0 x1 x2 x3 x4 x5", passage + " x0"])
    assert got[41] == 40


def test_passages_in_many_classes(spark):
    for seed in (1, 2):
        r = random.Random(seed)
        passage = [f"p{i}" for i in range(60)]
        own = lambda n: [f"o{r.randrange(10**9)}" for _ in range(n)]
        docs = [own(r.randint(0, 3)) + passage[r.randint(0, 8) : 60 - r.randint(0, 8)] + own(r.randint(0, 22)) for _ in range(110)]
        docs += [passage[:50] + own(4) + passage[54 - r.randint(0, 3) :] + [f"e{r.randrange(3)}" for _ in range(r.randint(0, 9))] for _ in range(60)]
        docs += [own(30) + passage[:12] for _ in range(40)] + [passage * 3 + own(60) for _ in range(3)]
        check(spark, [" ".join(d) for d in docs])


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "A b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 2, True), ("3", 1, False), ("None", None, True)]
    assert near_duplicates(df.limit(0)).count() == 0
    # one doc_id with two texts is one node, linked through either
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (5, a + " c"), (6, b + " c"), (7, "x y z")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()} == {(1, 1), (5, 1), (6, 1), (7, 7)}


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 5), (5, 7), (9, 9)]
    for few in (0, 1000):  # by stars, and in one task
        got = {(r.u, r.root) for r in components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
        assert got == {(i, 100) for i in range(100, 161)} | {(5, 5), (7, 5)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_template_in_many_classes(spark):
    """2,000 pages of one template, each pair under the threshold but for planted ones: found exactly, and the rest never meet."""
    r = random.Random(11)
    passage = [f"p{i}" for i in range(104)]
    own = lambda n: [f"o{r.randrange(10**12)}" for _ in range(n)]
    docs = [passage[: r.randint(100, 104)] + own(r.randint(26, 34)) for _ in range(1960)]
    for k in range(0, 400, 10):
        words = list(docs[k])
        words[r.randrange(104, len(words))] = "changed"
        docs.append(words)
    rows = list(enumerate(" ".join(d) for d in docs))
    sets = [shingles(t) for _, t in rows]
    names = {g: i for i, g in enumerate(sorted(shingles(" ".join(passage))))}
    common = np.zeros((len(rows), len(names)), np.float32)
    holders, shared = defaultdict(list), Counter()
    for d, s in enumerate(sets):
        for g in s:
            if g in names:
                common[d, names[g]] = 1
            else:
                holders[g].append(d)
    for h in holders.values():
        shared.update(itertools.combinations(h, 2))
    overlap = (common @ common.T).astype(int)
    for (a, b), n in shared.items():
        overlap[a, b] += n
    sizes = np.array([len(s) for s in sets])
    links = np.argwhere(np.triu(100 * overlap >= 75 * (sizes[:, None] + sizes - overlap), 1)).tolist()
    assert 40 <= len(links) < 200
    root = list(range(len(rows)))
    for a, b in links:
        old, new = sorted((root[a], root[b]), reverse=True)
        root = [new if x == old else x for x in root]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [got[d] for d in range(len(rows))] == root
    sized = spark.createDataFrame([(v, d, len(s)) for d, s in enumerate(sets) for v in [hash(g) for g in s]], "value long, node long, n int").withColumn("s", F.col("n"))
    entries = ranked(sized, 100 * (F.col("n") - F.col("rank")) >= 75 * F.col("n"))
    met = {x.node for x in reaching(entries, 75).collect()}
    assert {x for link in links for x in link} <= met and len(met) < 300
