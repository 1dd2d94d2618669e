"""Quality rules and robust multivariate outliers.

Counts of each text become a vector of transformed statistics. For each language and source the minimum
covariance determinant is approached from three starts at once: rows are ranked by the sum of their squared robust
scores, by the largest, and by the sum of bounded ones. A concentration step takes the SHARE of the rows nearest by
the last ranking, and ranks all rows anew by the Mahalanobis distance from their mean and covariance. A start ends
when its determinant falls no more; the start with the least determinant gives the estimate. Covariances carry the
factor that makes them right for normal rows, plus squared FLOORS on the diagonal, so that statistics which
are nearly always zero leave a determinant to compare (the regularised form of the method). Rows beyond the 0.999
point of the chi-square distribution are rejected.

Result rules: words are [^\\x20\\x09-\\x0D]+, null texts have none. A cell of fewer than LEAST rows uses its
language's estimate, a language of fewer that of all rows; either is made of all rows of the language or table. Null
languages and sources are cells of their own. Repeated rows are judged alike. Columns other than doc_id, text, lang
and source are ignored. Medians and shares are found by counts on a fixed grid, so they don't depend on how
rows are dealt out; sums of doubles may differ in their last bits.

At scale: texts are read once and only the counts are kept. A step is one grouped aggregation of counts and partial
sums by cell, start and step of distance (GRID steps an octave), so a source with a third of all rows is spread like
any other and what a cell's task gets is a bounded number of grid points. A row counts in up to three cells, those that
no row uses are left out. Estimates are tables joined back; Spark broadcasts them only below its own size limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.vectortext import BYTES, grams, pieces, prefix_hash, substring_hash, word_hashes, words
from tidemark.llm.worktables import save

SHARE = 0.75
#: SHARE over what a chi-square of seven degrees has below the SHARE point of one of five
FACTOR = 1.4121
#: at most so many concentration steps
STEPS = 20
LEAST = 200
#: squared distance beyond which a row is rejected: the 0.999 point of a chi-square with five degrees of freedom
CUTOFF = 20.515
#: grid of statistics (parts of one) and of squared distances (steps an octave)
FINE, GRID = 2048, 16
STARTS = 3
NAMES = ("length", "symbols", "upper", "copies", "stops")
#: added to each statistic's standard deviation, in squares; a text may well repeat a line or hold a few signs
FLOORS = (0.05, 0.05, 0.05, 0.2, 0.05)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stops")

_SYMBOL, _UPPER, _STOP = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?"))
_CHAR = (np.arange(256) & 0xC0) != 0x80


def counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each row of a piece."""
    n = len(offsets) - 1
    starts, ends, row = words(data, offsets)
    per_row = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    inside = np.zeros(len(data) + 1, np.int64)
    inside[starts] += 1
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside)[:-1] > 0
    n_words = np.bincount(row, minlength=n)

    # lines: cut after each \n and at row bounds
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[np.flatnonzero(data == 10) + 1] = True
    begin = np.flatnonzero(cut[:-1])
    end = np.append(begin[1:], len(data))[: len(begin)]
    end = np.where((end > begin) & (data[end - 1] == 10), end - 1, end) if len(begin) else end
    word_sum = np.concatenate([[0], np.cumsum(inside)])
    has = word_sum[end] > word_sum[begin]
    begin, end = begin[has], end[has]
    line_row = np.searchsorted(offsets, begin, "right") - 1
    line = substring_hash(prefix_hash(BYTES[data]), begin, end)
    order = np.lexsort((line, line_row))
    same = (line[order][1:] == line[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    dup_lines = np.bincount(line_row[order][1:][same], minlength=n)

    repeat = np.zeros(n, np.int64)
    m = len(starts) - 4
    if m > 0:
        k = np.flatnonzero(row[:m] == row[4:])
        h = grams(word_hashes(data, starts, ends), 5)[k]
        order = np.lexsort((h, row[k]))
        same = (h[order][1:] == h[order][:-1]) & (row[k][order][1:] == row[k][order][:-1])
        hit = np.zeros(len(k), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        cover = np.zeros(len(starts) + 1, np.int64)
        cover[k[hit]] += 1
        cover[k[hit] + 5] -= 1
        repeat = np.bincount(row[np.cumsum(cover)[:-1] > 0], minlength=n)
    return [n_words, per_row(inside & _CHAR[data]), per_row(_SYMBOL[data]), dup_lines, repeat, np.bincount(line_row, minlength=n), per_row(_UPPER[data]), per_row(_STOP[data])]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in pieces(batch.column("text")):
            rest = [batch.column(c).slice(i, j - i) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(c.astype(np.int64)) for c in counts(data, offsets))], names=["doc_id", "lang", "source", *COUNTS])


def statistics() -> list[Column]:
    """The transformed vector: roots of shares, shrunk so that short texts stay near the middle."""
    share = lambda a, b, k: F.sqrt(F.col(a) / (F.col(b) + k))
    return [
        F.log((F.col("word_chars") + 50) / (F.col("n_words") + 10)),
        share("n_symbols", "word_chars", 50),
        share("n_upper", "word_chars", 50),
        share("n_dup_lines", "n_lines", 10),
        share("n_stops", "n_words", 20),
    ]


def _estimate(bins: pd.DataFrame) -> pd.DataFrame:
    """The next estimate of one cell and start, from counts and sums of its rows by grid point of distance."""
    p = len(NAMES)
    upper = np.triu_indices(p)
    bins = bins.sort_values("bin")
    reached = np.cumsum(bins["n"].to_numpy())
    inner = bins.iloc[: int(np.searchsorted(reached, SHARE * reached[-1])) + 1]
    n = inner["n"].sum()
    mean = np.sum(np.stack(inner["s"]), 0) / n
    cov = np.zeros((p, p))
    cov[upper] = np.sum(np.stack(inner["ss"]), 0) / n
    cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
    values, axes = np.linalg.eigh(FACTOR * cov)
    cov = axes @ np.diag(np.maximum(values, 0)) @ axes.T + np.diag(np.square(FLOORS))
    first = bins.iloc[0]
    row = {"cell": first["cell"], "start": first["start"], "mean": mean, "inverse": np.linalg.inv(cov).ravel(), "det": float(np.linalg.det(cov))}
    return pd.DataFrame([row])


def distance() -> Column:
    """Squared Mahalanobis distance of x from mean."""
    p = len(NAMES)
    d = [F.col("x")[i] - F.col("mean")[i] for i in range(p)]
    return sum((d[i] * d[j] * F.col("inverse")[i * p + j] * (1 if i == j else 2) for i in range(p) for j in range(i, p)), F.lit(0.0))


def _step(ranked: DataFrame) -> DataFrame:
    """ranked(cell, start, x, d): cell, start, mean, inverse and det from the SHARE of the rows with the least d."""
    p = range(len(NAMES))
    s = F.array(*(F.sum(F.col("x")[i]) for i in p)).alias("s")
    ss = F.array(*(F.sum(F.col("x")[i] * F.col("x")[j]) for i in p for j in p if j >= i)).alias("ss")
    point = F.floor(GRID * F.log2(F.greatest("d", F.lit(1e-9)))).cast("int")
    bins = ranked.withColumn("bin", point).groupBy("cell", "start", "bin").agg(F.count("*").alias("n"), s, ss)
    kinds = "cell string, start int, mean array<double>, inverse array<double>, det double"
    return save(bins.groupBy("cell", "start").applyInPandas(_estimate, kinds), "estimates")


def _medians(rows: DataFrame, values: Column) -> DataFrame:
    """cell and the medians of an array of values no less than 0, to a grid point, by counts."""
    points = rows.select("cell", F.posexplode(F.transform(values, lambda v: F.floor(v * FINE)))).groupBy("cell", "pos", "col").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cell", "pos")
    upto = points.select("cell", "pos", "col", F.sum("n").over(w.orderBy("col")).alias("upto"), F.sum("n").over(w).alias("all"))
    middle = upto.where("2 * upto >= all").groupBy("cell", "pos").agg(((F.min("col") + 0.5) / FINE).alias("v"))
    return middle.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda m: m["v"]).alias("middle"))


def concentrated(rows: DataFrame) -> DataFrame:
    """rows(cell, x): cell, mean, inverse and det of the MCD estimates. Only a truth value a step comes to the driver."""
    p = range(len(NAMES))
    middle = save(_medians(rows, F.col("x")), "medians")
    off = F.zip_with("x", "middle", lambda x, m: F.abs(x - m))
    mads = save(_medians(rows.join(middle, "cell"), off).withColumnRenamed("middle", "mad"), "mads")
    z = F.transform(F.sequence(F.lit(0), F.lit(len(NAMES) - 1)), lambda i: F.try_element_at(off, i + 1) / (1.4826 * F.try_element_at("mad", i + 1) + F.try_element_at(F.array(*map(F.lit, FLOORS)), i + 1)))
    square = lambda a, f: sum((f(F.col("z")[i]) * f(F.col("z")[i]) for i in p), F.lit(0.0))  # noqa: E731, ARG005
    ranks = F.array(square("z", lambda v: v), F.array_max("z"), square("z", F.tanh))
    scored = rows.join(middle, "cell").join(mads, "cell").withColumn("z", z).select("cell", "x", F.posexplode(ranks).alias("start", "d"))
    best = now = _step(scored)
    for _ in range(STEPS):
        new = _step(rows.join(now.select("cell", "start", "mean", "inverse"), "cell").select("cell", "start", "x", distance().alias("d")))
        old = now.select("cell", "start", F.col("det").alias("before"))
        now = save(new.join(old, ["cell", "start"]).where("det < before * (1 - 1e-9)").drop("before"), "falling")
        if now.isEmpty():
            break
        best = save(best.join(now.select("cell", "start"), ["cell", "start"], "left_anti").unionByName(now), "best")
    return save(best.groupBy("cell").agg(F.min_by(F.struct("mean", "inverse", "det"), F.struct("det", "start")).alias("e")).select("cell", "e.*"), "mcd")


def _cells(rows: DataFrame) -> DataFrame:
    """rows with cell, the finest of language and source, language, and all that has LEAST rows itself, and cells,
    all cells of the row that any row uses: each of them is estimated from all of its rows."""
    part = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), c))
    rows = rows.withColumns({"l": part("lang"), "s": part("source")})
    fine = save(rows.groupBy("l", "s").agg(F.count("*").alias("fine")), "cells")
    coarse = fine.groupBy("l").agg(F.sum("fine").alias("coarse"), (F.min("fine") < LEAST).alias("some_small"))
    small = coarse.agg(F.coalesce(F.min("coarse") < LEAST, F.lit(False))).first()[0]
    own = F.when(F.col("fine") >= LEAST, F.concat_ws("\n", "l", "s"))
    language = F.when(F.col("coarse") >= LEAST, F.col("l"))
    used = F.array_compact(F.array(own, F.when(F.col("some_small"), language), F.lit("" if small else None).cast("string")))
    names = save(fine.join(coarse, "l").select("l", "s", F.coalesce(own, language, F.lit("")).alias("cell"), used.alias("cells")), "cell_names")
    return rows.join(names, ["l", "s"]).drop("l", "s")


def quality_outliers(documents: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """A row for each row of documents: doc_id, COUNTS, base_failed, distance, kept."""
    kinds = ", ".join(f"{c} long" for c in COUNTS)
    rows = documents.select("doc_id", "text", "lang", "source").mapInArrow(_count_batches, f"doc_id long, lang string, source string, {kinds}")
    rows = save(rows.withColumn("x", F.array(*statistics())), "counts")
    rows = save(_cells(rows), "placed")
    estimates = concentrated(rows.select(F.explode("cells").alias("cell"), "x"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = rows.join(estimates, "cell").withColumn("distance", distance())
    return out.select("doc_id", *COUNTS, failed.alias("base_failed"), "distance", (~failed & (F.col("distance") <= cutoff)).alias("kept"))
