"""Each stage of the pipeline against brute force over the rows that it gets."""

import random
import re
from collections import defaultdict

import pytest
from test_language import plain as plain_languages
from test_near_dups import brute as brute_near
from test_operators import BASE, base_line, least_distance, passes

import corpus_pipeline as cp
from tidemark.llm.decontaminate import budget_of, plain
from tidemark.llm.mixing import BAD, GOOD, UNKNOWN

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(11)
    vocab = {"en": [f"word{k}" for k in range(60)] + ["the", "and"], "de": [f"wört{k}" for k in range(60)] + ["der", "und"]}
    items = [(k, " ".join(r.choice(vocab["en"]) for _ in range(14))) for k in range(5)]
    rows = []
    for d in range(90):
        lang = r.choice(["en", "de"])
        words = [r.choice(vocab[lang]) for _ in range(r.randint(12, 90))]
        if d % 9 == 0:
            words += items[d % 5][1].split()
        if d % 7 == 0:
            words += [f"mail{d}@site.com", "call", "+49 30 1234567"]
        rows.append((d, " ".join(words), r.choice([lang, lang, None]), r.choice(["a.com", "b.de", None])))
    rows += [(100 + k, rows[k][1] + (" more" if k % 2 else ""), rows[k][2], rows[k][3]) for k in range(20)]
    rows += [(200, "", "en", None), (201, None, None, None), (202, "1 2 3", "de", "a.com")]
    root = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(d, t, lang, s, len(t or ""), "x") for d, t, lang, s in rows], DOCS)
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(d, d % 2, 0) for d in range(0, 60, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), items


def test_stages_against_brute_force(spark, tables):
    root, items = tables
    before = spark.read.parquet(f"{root}/documents.parquet")
    stages = dict(cp.STAGES)
    ids = lambda df: sorted(x.doc_id for x in df.select("doc_id").collect())
    rows = lambda df: [tuple(x) for x in df.select("doc_id", "text", "lang", "source").collect()]

    after = stages["languages"](spark, before, root)
    assert after.columns == before.columns
    assert ids(after) == sorted(d for d, (_, _, kept) in plain_languages(rows(before)).items() if kept)

    before = spark.createDataFrame(after.collect(), after.schema)
    after = stages["near_duplicates"](spark, before, root)
    assert ids(after) == sorted(d for d, _, _, kept in brute_near([(d, t) for d, t, *_ in rows(before)]) if kept)

    before = spark.createDataFrame(after.collect(), after.schema)
    after = stages["decontamination"](spark, before, root)
    leaks = {d for d, t, *_ in rows(before) for _, item in items if t and least_distance(plain(item), plain(t)) <= budget_of(len(plain(item)))}
    assert leaks and ids(after) == sorted(set(ids(before)) - leaks)

    before = spark.createDataFrame(after.collect(), after.schema)
    after = stages["personal_data"](spark, before, root)
    assert ids(after) == ids(before)
    texts = {d: t for d, t, *_ in rows(before)}
    masks = 0
    for d, t, *_ in rows(after):
        want = texts[d]
        for kind, p in BASE:
            want = re.sub(p, lambda m, kind=kind: f"[{kind.upper()}]" if passes(kind, m[0]) else m[0], want)
        assert t == want
        masks += t != texts[d]
    assert masks and {x.n_chars for x in after.where("text like '%[EMAIL]%'").collect()} == {len(t) for _, t, *_ in rows(after) if "[EMAIL]" in t}

    before = spark.createDataFrame(after.collect(), after.schema)
    after = stages["mixing"](spark, before, root).collect()
    size = {d: len(t.split()) for d, t, *_ in rows(before)}
    source = {d: s for d, _, _, s in rows(before)}
    total = defaultdict(int)
    for d, s in source.items():
        total[s] += size[d]
    weight = dict(zip(sorted(total, key=lambda s: (s is None, s or "")), (5, 2, 1), strict=False))
    left, open_, target = 1.5 * sum(total.values()), set(total), {}
    while open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > 2 * total[s]}
        if not over:
            target |= part
            break
        for s in over:
            target[s], left = 2.0 * total[s], left - 2.0 * total[s]
        open_ -= over
    times = defaultdict(list)
    for x in after:
        assert x.size == size[x.doc_id]
        times[x.doc_id].append(x.epoch)
    for s in total:
        taken = sum(size[d] * len(times[d]) for d in size if source[d] == s)
        assert abs(taken - target[s]) <= max(size.values())
        least = min(len(times[d]) for d in size if source[d] == s)
        assert all(sorted(times[d]) == list(range(1, len(times[d]) + 1)) and least <= len(times[d]) <= min(2, least + 1) for d in size if source[d] == s)
    assert (GOOD, UNKNOWN, BAD) == (1.0, 0.75, 0.25)


def test_stages_on_empty_and_odd_rows(spark, tables):
    root, _ = tables
    docs = spark.createDataFrame([(None, None, None, None, None, None), (1, "", "en", "a.com", 0, "x"), (1, "", "en", "a.com", 0, "x")], DOCS)
    for rows in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            got = stage(spark, rows, root)
            assert got.count() <= 6 and (name == "mixing" or got.columns == docs.columns)


def test_personal_data_query(spark):
    import hashlib

    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for x in __spark_entry__.queries()["op5_personal_data"](spark, sf).collect():
        line = base_line(texts[x.doc_id])
        kinds = [s.split(":")[0] for s in line.split(",") if s]
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(kinds.count(k) for k in ("email", "ip", "card", "phone"))
        assert x.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and set(line.split(",")) - {""} <= set(x.spans.split(","))
