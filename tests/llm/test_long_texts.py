"""Texts beyond one piece of a task, repeated rows, clashing columns and empty tables, for the operators on documents."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_language import plain as plain_languages
from test_near_dups import brute as brute_near
from test_operators import base_line, counts
from test_substrings import brute_bytes, brute_words

from tidemark.llm import nbsvm
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.language import identify, of_documents
from tidemark.llm.mixing import mix_sources
from tidemark.llm.near_dups import near_duplicates
from tidemark.llm.outliers import quality_outliers
from tidemark.llm.pii import as_line, find_pii
from tidemark.llm.reference_parse import reference_dedup
from tidemark.llm.suffix_dedup import suffix_dedup
from tidemark.llm.url_filter import filter_urls
from tidemark.llm.vectortext import PIECE

#: columns of the input that operators use for themselves
DOCS = "doc_id long, text string, lang string, source string, key string, n int, value string, node string, root int, label string, size string, spans int, host string, suffix string"
REST = ("k", 1, "v", "n", 2, "x", "s", 3, "h", "u")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(21)
    words = [f"{r.choice(['house', 'baum', 'tree', 'maison', 'Über'])}{k}" for k in range(3000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    long = text(45_000)
    assert len(long.encode()) > PIECE
    passage = text(70)
    item = text(14)
    docs = [(0, long, "en", "a.com"), (1, passage + " " + text(30), "en", "a.com"), (2, long[:300_000] + " " + passage + " " + item + " tail@mail.com", "de", "b.de"), (3, "", None, None), (4, None, "en", "a.com"), (5, text(50), "de", None)]
    docs += [docs[1], docs[1], docs[3], (6, long, "fr", "a.com"), (7, "x" * (PIECE + 10), None, "b.de")]
    return docs, item


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(*d, *REST) for d in rows[0]], DOCS).repartition(3)


def test_removal_of_substrings(frame, rows):
    docs = [(d, t) for d, t, *_ in rows[0]]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(frame).collect()), key=str)
    assert got == brute_bytes(docs, 200)
    single = [x for k, x in enumerate(docs) if x not in docs[:k]]  # a doc_id that repeats has no first place
    once = frame.dropDuplicates(["doc_id", "text"])
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in reference_dedup(once).collect()), key=str)
    assert got == brute_words(single, 20)
    repeated = reference_dedup(frame).where("doc_id = 1").collect()
    assert len(repeated) == 3 and len({r.kept_sha256 for r in repeated}) == 1  # rows equal in doc_id and text are one document
    for operator in (suffix_dedup, reference_dedup, near_duplicates, quality_outliers):
        assert operator(frame.limit(0)).collect() == []


def test_near_duplicates(frame, rows):
    docs = {d: t for d, t, *_ in rows[0]}
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame).collect()]
    assert len(got) == len(rows[0]) and set(got) == brute_near(sorted(docs.items()))


def test_counts_leaks_and_personal_data(spark, frame, rows):
    docs, item = rows
    texts = {d: t for d, t, *_ in docs}
    out = quality_outliers(frame).collect()
    assert len(out) == len(docs) and all((x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == counts(texts[x.doc_id]) for x in out)
    items = spark.createDataFrame([(9, item, "x"), (9, item, "x"), (8, None, "x")], "item_id long, text string, doc_id string")
    leaks = find_leaks(frame, items).select("doc_id", "item_id").distinct().collect()
    assert [(x.doc_id, x.item_id) for x in leaks] == [(2, 9)]
    assert find_leaks(frame.limit(0), items).collect() == [] and find_leaks(frame, items.limit(0)).collect() == []
    found = find_pii(frame).select("doc_id", as_line(F.filter("pii", lambda s: s["rank"] < 4)).alias("base")).collect()
    assert len(found) == len(docs) and all(x.base == base_line("" if x.doc_id == 7 else texts[x.doc_id]) for x in found) and find_pii(frame.limit(0)).collect() == []


def test_languages(frame, rows):
    want = plain_languages(rows[0])
    got = identify(of_documents(frame)).collect()
    assert Counter(x.doc_id for x in got) == Counter(d for d, *_ in rows[0])
    for x in got:
        language, posterior, kept = want[x.doc_id]
        assert (x.language, x.kept) == (language, kept) and abs(x.posterior - posterior) < 1e-6
    assert identify(of_documents(frame.limit(0))).collect() == []


def test_mixing_and_urls_of_repeated_rows(spark, frame, rows):
    mixed = mix_sources(frame).collect()
    assert Counter(x.doc_id for x in mixed) == Counter(d for d, *_ in rows[0]) and all(0 <= x.taken <= 2 * x["size"] for x in mixed)
    assert mix_sources(frame.limit(0)).collect() == []
    pages = spark.createDataFrame([(1, "http://A.org/fr/x?y", "p"), (1, "http://A.org/fr/x?y", "p"), (2, None, "p"), (3, "no scheme", "p"), (4, "http://b.net/" + "s/" * 9 + "x" * 300_000, "p")], "page_id long, url string, host string")
    labelled = spark.createDataFrame([(1, 0), (1, 0), (4, 1)], "page_id long, bad int")
    got = filter_urls(pages, labelled).collect()
    assert Counter(x.page_id for x in got) == Counter([1, 1, 2, 3, 4]) and {(x.page_id, x.rule, x.verdict) for x in got} >= {(1, "org/fr/", "allow"), (4, "net/", "block")}
    assert {(x.host, x.path) for x in got if x.page_id in (2, 3)} == {("", "")} and filter_urls(pages.limit(0), labelled).collect() == []


def plain_scores(rows, labels, texts):
    """Scores by dictionaries: log-count ratios, dual coordinate steps, then the logistic curve by Newton's method."""
    size = nbsvm.SIZE
    good, bad = Counter(), Counter()
    train = [i for i, (_, _, check) in enumerate(rows) if not check]
    for i in train:
        (good if rows[i][1] else bad).update(rows[i][0])
    total = {x: sum(c.values()) + size * nbsvm.SMOOTH for x, c in (("g", good), ("b", bad))}
    ratio = lambda f: 1.0 if f == size else np.log((good[f] + nbsvm.SMOOTH) / total["g"]) - np.log((bad[f] + nbsvm.SMOOTH) / total["b"])
    share = sum(rows[i][1] for i in train) / len(train)

    def vector(features):
        x = {f: ratio(f) for f in [*features, size]}
        norm = max(1.0, np.sqrt(sum(v * v for v in x.values())))
        return {f: v / norm for f, v in x.items()}

    w, alpha, order = Counter(), Counter(), np.random.default_rng(7)
    dot = lambda x: sum(w[f] * v for f, v in x.items())
    x = [vector(f) for f, *_ in rows]
    for _ in range(nbsvm.EPOCHS):
        for i in order.permutation(np.array(train)).tolist():
            sign = 1.0 if rows[i][1] else -1.0
            most = nbsvm.COST * (0.5 / share if rows[i][1] else 0.5 / (1 - share))
            new = min(max(alpha[i] - (sign * dot(x[i]) - 1) / sum(v * v for v in x[i].values()), 0.0), most)
            for f, v in x[i].items():
                w[f] += (new - alpha[i]) * sign * v
            alpha[i] = new
    held = [i for i, (_, _, check) in enumerate(rows) if check]
    z, y, a, b = [dot(x[i]) for i in held], [float(rows[i][1]) for i in held], 1.0, 0.0
    for _ in range(50):
        p = [1 / (1 + np.exp(-(a * s + b))) for s in z]
        v = [q * (1 - q) + 1e-6 for q in p]
        h = np.array([[sum(k * s * s for k, s in zip(v, z, strict=True)) + 1e-2, sum(k * s for k, s in zip(v, z, strict=True))]] * 2)
        h[1] = [h[0, 1], sum(v) + 1e-2]
        step = np.linalg.solve(h, [sum((q - t) * s for q, t, s in zip(p, y, z, strict=True)) + 1e-2 * a, sum(q - t for q, t in zip(p, y, strict=True)) + 1e-2 * b])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return [1 / (1 + np.exp(-(a * dot(vector(t)) + b))) for t in texts]


def test_classifier_against_dictionaries(spark, frame):
    r = random.Random(4)
    texts = [" ".join(r.choice(["fine", "good", "words", "and", "prose"] if i % 2 else ["BUY", "now!!", "click", "$$", "and"]) for _ in range(r.randint(3, 12))) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (90, ""), (91, None), (92, "good " * 60_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int")
    order = {x.doc_id: x.order for x in labels.select("doc_id", F.abs(F.xxhash64("doc_id", F.lit(1)) % 1_000_003).alias("order")).collect()}
    held = {x.doc_id for x in labels.where(nbsvm.held_out()).collect()}
    features = lambda t: sorted(set(nbsvm.features(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0].tolist()))
    known = sorted((i for i in [*range(60), 7] if i not in held), key=lambda i: order[i])  # the repeated row is learnt from twice
    rows = [(features(texts[i]), i % 2, order[i] % 5 == 0) for i in known]
    got = nbsvm.score_quality(docs, labels).collect()
    every = {**dict(enumerate(texts)), 90: "", 91: None, 92: "good " * 60_000}
    want = dict(zip(every, plain_scores(rows, labels, [features(t) for t in every.values()]), strict=True))
    assert Counter(x.doc_id for x in got)[7] == 2 and len(got) == 64
    assert all(abs(x.score - want[x.doc_id]) < 1e-9 and x.predicted == (x.score >= nbsvm.LINE) for x in got)
    assert nbsvm.score_quality(docs.limit(0), labels).collect() == []
    assert nbsvm.score_quality(frame, frame.select("doc_id", F.lit(1).alias("label"))).count() == frame.count()
