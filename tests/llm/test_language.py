"""Posteriors against the same sums done plainly, row by row."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from tidemark.llm import language as lg


def plain(rows):
    """doc_id: (language, posterior, kept) of rows (doc_id, text, lang, source)."""
    code = lambda x: (x or "").strip().lower().split("-")[0].split("_")[0] or None
    ids = {}
    for d, t, *_ in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        ids[d] = lg._grams(raw, np.array([0, len(raw)]))[0]
    names = sorted({code(lang) for *_, lang, _ in rows} - {None})
    place, size = {x: k for k, x in enumerate(names)}, len(names)
    counts = np.full((size, lg.SIZE), 0.5)
    by_host, by_suffix, every = defaultdict(Counter), defaultdict(Counter), Counter()
    suffix = lambda s: s.rsplit(".", 1)[1] if s and "." in s else None
    for d, _, lang, source in rows:
        if code(lang):
            np.add.at(counts[place[code(lang)]], ids[d], 1)
            if source:
                by_host[source][code(lang)] += 1
                every[code(lang)] += 1
                if suffix(source):
                    by_suffix[suffix(source)][code(lang)] += 1
    model = np.log(counts / counts.sum(1, keepdims=True))
    base = [(every[x] + 1) / (sum(every.values()) + size) for x in names]
    share = lambda of, above: [(of[x] + lg.SMOOTH * a) / (sum(of.values()) + lg.SMOOTH) for x, a in zip(names, above, strict=True)]
    pointing = lambda c, right: [(math.log(right) if x == c else math.log((1 - right) / (size - 1))) if c in names else 0.0 for x in names]
    out = {}
    for d, _, lang, source in rows:
        n = len(ids[d])
        prior = [1.0] * size
        if source:
            prior = share(by_suffix[suffix(source)], base) if suffix(source) in by_suffix else base
            prior = share(by_host[source], prior) if source in by_host else prior
        total = np.array([model[k][ids[d]].sum() * min(n, lg.GRAMS) / max(n, 1) for k in range(size)]) + np.log(prior) + pointing(code(lang), lg.DECLARED_RIGHT) + pointing(lg.SUFFIXES.get(suffix(source)), lg.SUFFIX_RIGHT)
        p = 1 / np.exp(total - total.max()).sum()
        out[d] = (names[int(total.argmax())], p, n > 0 and p >= lg.SURE)
    return out


def corpus():
    r = random.Random(8)
    vocab = {"de": ["der", "und", "nicht", "straße", "über", "haus"], "en": ["the", "and", "house", "street", "over", "not"], "fr": ["la", "et", "maison", "rue", "très", "pas"], "pl": ["nie", "dom", "ulica", "jest"]}
    rows = []
    for d in range(160):
        lang = r.choice(list(vocab))
        words = " ".join(r.choice(vocab[lang]) for _ in range(r.choice([1, 2, 5, 40])))
        declared = r.choice([lang, lang, f"{lang.upper()}-XX", None, r.choice(list(vocab))])
        rows.append((d, words, declared, r.choice([f"site{r.randint(0, 4)}.{lang}", f"{lang}.example.com", "src1", None])))
    return [*rows, (500, "", "de", "x.de"), (501, None, None, "unseen.fr"), (502, "12 34", "fr", None), (503, "maison", None, "unseen.fr"), (504, "nie", None, "unseen.zz")]


def test_posteriors_match_plain_sums(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = plain(rows)
    got = {x.doc_id: x for x in lg.identify(lg.of_documents(df.repartition(5))).collect()}
    assert set(got) == set(want)
    for d, (name, p, kept) in want.items():
        assert abs(got[d].posterior - p) < 1e-9 and got[d].kept == kept
        assert got[d].language == name or p < 0.5000001


def test_suffix_and_host_decide_where_the_text_does_not(spark):
    rows = [(k, "zz", "de", f"h{k}.de") for k in range(30)] + [(100 + k, "zz", "fr", f"h{k}.fr") for k in range(30)] + [(900, "zz", None, "new.de"), (901, "zz", None, "new.fr")]
    got = {x.doc_id: x.language for x in lg.identify(lg.of_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()}
    assert (got[900], got[901]) == ("de", "fr")


def test_more_than_64_languages(spark):
    codes = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(10 * k + n, " ".join([f"{c}{c}{c} w{c}x"] * 20), c if n < 3 else None, None) for k, c in enumerate(codes) for n in range(4)]
    got = {x.doc_id: x for x in lg.identify(lg.of_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()}
    assert all(got[10 * k + 3].language == c and got[10 * k + 3].kept for k, c in enumerate(codes))
