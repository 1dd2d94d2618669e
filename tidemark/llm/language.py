"""Language identification by Bayesian evidence fusion.

Four kinds of evidence add up in log space: the text under hashed character 3-gram models, the declared markup
language, the suffix of the address, and a prior of the host. Priors come from grouped aggregation: a host's
declared languages, smoothed towards its suffix's, these towards the whole table's; a host that declares nothing has
its suffix's prior, without one that of the table.

Result rules: languages are all declared ones, lower-cased, cut at the first character that is no letter, of two or
three letters. Missing evidence (null or malformed declared language, no suffix, null host) counts for nothing. Texts
without letters are rejected, as are those whose best posterior stays below SURE. Repeated rows are judged alike.
Other columns are ignored. Without any declared language each row is rejected with language null.

At scale: one pass counts the 3-grams of all rows, SIZE numbers a language that a task meets, before anything is
shuffled, a second one scores; the model has SIZE numbers a language, whatever the input. Priors are joined by host;
Spark broadcasts them only below its own size limit, and otherwise joins two written tables that adaptive execution
can split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.natives import row_keys
from tidemark.llm.vectortext import LOWER, U, mix, pieces
from tidemark.llm.worktables import save

SIZE = 1 << 14
#: a text counts as at most so many 3-grams, as neighbours are not independent
GRAMS = 60
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.6
SMOOTH = 20.0
SURE = 0.6
KEPT = ("doc_id", "key", "more", "declared", "host", "suffix")
#: fixed values: languages that country suffixes point to
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "uk": "en", "us": "en", "au": "en", "ie": "en"}


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3-grams of letters, and bounds of the rows; whatever is no letter counts as one blank."""
    data = LOWER[data]
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    data = np.where(letter, data, 32)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    m = max(0, len(data) - 2)
    d = data.astype(U)
    ids = (mix(d[:m] | d[1 : m + 1] << U(8) | d[2 : m + 2] << U(16)) % U(SIZE)).astype(np.int64)
    good = (of[:m] == of[2 : m + 2]) & letter[1 : m + 1] & (letter[:m] | letter[2 : m + 2])
    return ids[good], np.searchsorted(of[:m][good], np.arange(len(offsets)))


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        codes = batch.column("declared").dictionary_encode()
        label, names = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
        for i, j, data, offsets in pieces(batch.column("text")):
            ids, bound = _grams(data, offsets)
            of = np.repeat(label[i:j], np.diff(bound))
            for k in np.unique(of[of >= 0]):
                found = np.bincount(ids[of == k], minlength=SIZE)
                totals[names[k]] = totals.get(names[k], 0) + found
    for name, total in totals.items():
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(total[k])], names=["declared", "gram", "n"])


def _score_batches(languages: int, model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.frombuffer(model).reshape(languages, SIZE)
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("text")):
                ids, bound = _grams(data, offsets)
                n = np.diff(bound)
                weight = np.minimum(n, GRAMS) / np.maximum(n, 1)
                score = np.stack([np.diff(np.concatenate([[0.0], np.cumsum(row[ids])])[bound]) * weight for row in logs], 1)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(score.ravel()), languages).cast(pa.list_(pa.float64()))
                rest = [batch.column(c).slice(i, j - i) for c in KEPT]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(n), lists], names=[*KEPT, "n_grams", "text_scores"])

    return run


def code_of(c: str | Column) -> Column:
    """A language code of two or three letters without its region; null where there is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(F.lower(F.trim(c)), "^([a-z]{2,3})(?![a-z])", 1), F.lit(""))


def _suffix(host: str) -> Column:
    return F.nullif(F.regexp_extract(F.lower(host), r"\.([a-z]+)$", 1), F.lit(""))


def of_documents(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text, lang, source) as evidence: lang is what was declared, source the host."""
    return documents.select("doc_id", "text", code_of("lang").alias("declared"), F.col("source").alias("host"), _suffix("source").alias("suffix"))


def of_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as evidence: the lang attribute of html, host and suffix of the address."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#:]*)", 1))
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    declared = code_of(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\slang=[\"']?([a-zA-Z-]+)", 1))
    rows = pages.select(F.col("page_id").alias("doc_id"), text.alias("text"), declared.alias("declared"), F.nullif(host, F.lit("")).alias("host"))
    return rows.withColumn("suffix", _suffix("host"))


def _tally(counts: DataFrame, *keys: str) -> DataFrame:
    """By keys: of, the count of each declared language, and n, that of all."""
    each = counts.groupBy(*keys, "declared").agg(F.sum("c").alias("c"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("declared", "c"))).alias("of"), F.sum("c").alias("n"))


def _smoothed(names: list[str], above: Column) -> Column:
    """Shares over names of a _tally row, with SMOOTH rows shared out as above says."""
    share = lambda x, b: (F.coalesce(F.try_element_at("of", x), F.lit(0)) + SMOOTH * b) / (F.col("n") + SMOOTH)
    return F.zip_with(F.array(*map(F.lit, names)), above, share)


def priors(rows: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    """Shares of declared languages over names: host, prior; suffix, above (both smoothed); and those of all rows."""
    each = rows.where(F.col("declared").isNotNull() & F.col("host").isNotNull())
    by_host = save(each.groupBy("host", "suffix", "declared").agg(F.count("*").alias("c")), "host_counts")
    total = {r.declared: r.c for r in by_host.groupBy("declared").agg(F.sum("c").alias("c")).collect()}  # a row a language
    base = F.array(*(F.lit((total.get(x, 0) + 1.0) / (sum(total.values()) + len(names))) for x in names))
    suffixes = save(_tally(by_host.where("suffix is not null"), "suffix").select("suffix", _smoothed(names, base).alias("above")), "suffix_priors")
    hosts = _tally(by_host, "host", "suffix").join(suffixes, "suffix", "left")
    return save(hosts.select("host", _smoothed(names, F.coalesce("above", base)).alias("prior")), "host_priors"), suffixes, base


def _pointing(names: list[str], code: Column, right: float) -> Column:
    """Log likelihoods over names of a source that gives code, rightly with a chance of right; zeros for other codes."""
    miss = math.log((1 - right) / max(1, len(names) - 1))
    told = F.coalesce(F.array_contains(F.array(*map(F.lit, names)), code), F.lit(False))
    return F.transform(F.array(*map(F.lit, names)), lambda x: F.when(told, F.when(code == x, math.log(right)).otherwise(miss)).otherwise(0.0))


def fused(scored: DataFrame, names: list[str]) -> DataFrame:
    """scored(declared, suffix, prior, text_scores, ...) with language and posterior from all evidence."""
    country = F.try_element_at(F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair)), F.col("suffix"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    out = scored.withColumn("totals", add(F.col("text_scores"), F.transform("prior", lambda x: F.log(x))))
    out = out.withColumn("totals", add("totals", add(_pointing(names, F.col("declared"), DECLARED_RIGHT), _pointing(names, country, SUFFIX_RIGHT))))
    out = out.withColumn("best", F.array_max("totals"))
    posterior = 1 / F.aggregate("totals", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("best")))
    language = F.element_at(F.array(*map(F.lit, names)), F.array_position("totals", F.col("best")).cast("int"))
    return out.withColumns({"language": language, "posterior": posterior})


def identify(rows: DataFrame) -> DataFrame:
    """rows(doc_id, text, declared, host, suffix), one result row each: doc_id, key and more (row_keys of doc_id and
    text), language, posterior, kept."""
    rows = rows.select("doc_id", "text", "declared", "host", "suffix", *row_keys("doc_id", "text"))
    grams = rows.where("declared is not null").select("text", "declared").mapInArrow(_train_batches, "declared string, gram int, n long")
    grams = save(grams.groupBy("declared", "gram").agg(F.sum("n").alias("n")), "grams")
    names = sorted(r.declared for r in rows.select("declared").where("declared is not null").distinct().collect())  # codes of two or three letters
    if not names:
        return rows.select("doc_id", "key", "more", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))
    place, counts = {x: k for k, x in enumerate(names)}, np.full((len(names), SIZE), 0.5)
    for r in grams.toLocalIterator():  # at most SIZE numbers a language
        counts[place[r.declared], r.gram] += r.n
    model = np.log(counts / counts.sum(1, keepdims=True))
    kinds = "doc_id long, key long, more int, declared string, host string, suffix string, n_grams long, text_scores array<double>"
    scored = save(rows.mapInArrow(_score_batches(len(names), model.tobytes()), kinds), "text_scores")
    hosts, suffixes, base = priors(rows, names)
    scored = scored.join(hosts.withColumnRenamed("host", "h"), F.col("host") == F.col("h"), "left").join(suffixes.withColumnRenamed("suffix", "s"), F.col("suffix") == F.col("s"), "left")
    nothing = F.array_repeat(F.lit(1.0), len(names))
    prior = F.when(F.col("host").isNull(), nothing).otherwise(F.coalesce("prior", "above", base))
    out = fused(scored.withColumn("prior", prior), names)
    return out.select("doc_id", "key", "more", "language", "posterior", ((F.col("n_grams") > 0) & (F.col("posterior") >= SURE)).alias("kept"))
