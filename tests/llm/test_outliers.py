"""Robust estimates against a plain numpy search over many starts."""

import numpy as np

from tidemark.llm.outliers import CUTOFF, FACTOR, FLOORS, SHARE, concentrated, quality_outliers

SF = "/root/testdata/sf0.01"


def plain(x, seed=0):
    """Mean, covariance and determinant of the best of 40 random starts, by whole sorts."""
    r, n = np.random.default_rng(seed), len(x)
    best = None
    for _ in range(40):
        inner = r.choice(n, min(n, 12), replace=False)
        for _ in range(60):
            mean, cov = x[inner].mean(0), FACTOR * np.cov(x[inner].T, bias=True) + np.diag(np.square(FLOORS))
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            new = np.sort(np.argsort(d, kind="stable")[: int(np.ceil(SHARE * n))])
            if np.array_equal(new, inner):
                break
            inner = new
        det = np.linalg.det(cov)
        if best is None or det < best[0]:
            best = (det, mean, cov)
    return best


def test_estimates_match_plain_search(spark):
    r = np.random.default_rng(3)
    cells = {}
    for name, n, odd in (("a", 400, 0), ("b", 600, 100), ("c", 300, 60)):
        mix = r.normal(size=(5, 5)) * 0.15
        x = 2 + r.normal(size=(n, 5)) @ mix
        x[:odd] = 4 + r.normal(size=(odd, 5)) * 0.02  # a tight group far away
        cells[name] = np.abs(x)
    rows = spark.createDataFrame([(c, v.tolist()) for c, x in cells.items() for v in x], "cell string, x array<double>")
    got = {e.cell: e for e in concentrated(rows.repartition(5)).collect()}
    assert set(got) == set(cells)
    for c, x in cells.items():
        det, mean, cov = plain(x)
        assert got[c].det <= det * 1.25  # whole grid points enter, so a few rows more than SHARE
        dist = lambda m, i: np.einsum("ij,jk,ik->i", x - m, i, x - m)  # noqa: E731, B023
        mine, theirs = dist(np.array(got[c].mean), np.array(got[c].inverse).reshape(5, 5)), dist(mean, np.linalg.inv(cov))
        sure = (theirs < 0.7 * CUTOFF) | (theirs > 1.4 * CUTOFF)
        assert np.array_equal((mine > CUTOFF)[sure], (theirs > CUTOFF)[sure])
        assert (mine[: {"a": 0, "b": 100, "c": 60}[c]] > CUTOFF).all()
    again = {e.cell: e for e in concentrated(rows.repartition(2)).collect()}
    assert all(np.allclose(again[c].inverse, got[c].inverse, rtol=1e-9) for c in cells)


def test_junk_goes_and_good_documents_stay(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = quality_outliers(spark.read.parquet(f"{SF}/documents.parquet")).join(labels, "doc_id").collect()
    bad = [r.kept for r in rows if r.quality == 0]
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1
