"""Vector code compression: codebooks of parts by Lloyd rounds with Elkan's bounds.

Each part of a row keeps an upper bound of the distance to its own entry and one lower bound for each entry. After
entries moved, the upper bound grows by the own entry's movement and each lower bound shrinks by its entry's. An
entry is passed over only where its lower bound, or half its distance to the own entry, is strictly above the upper
bound: it is then strictly farther, so that no tie is lost. What is left is compared by whole squared distances, ties
to the lower index. Bounds are 32-bit numbers rounded outwards; all distances that decide are whole numbers.

Result rules: rows whose vector is null or holds null, NaN or infinite components are dropped; every other row gets a
code, repeated vec_ids too. Null vec_ids stay and count as the largest; equal vec_ids are ordered by their vectors
when the first entries are picked. With fewer kept rows than entries, codebooks have as many entries as rows; without
rows the result is empty. Vectors shorter than the longest, and a length that is no multiple of the parts, are filled
up with zeros. Other columns are ignored; a table without label has null labels. Components of 2,048 or more,
or over 1,024 of them, are refused with an error, as their sums could leave 64 bits.

At scale: no row is shuffled. A round is one pass that writes rows with their bounds and, once a task, the sums of
its entries, a fixed number of values that the next codebook is made of; the table of the round before is deleted.
Only codebooks go through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.integer_vectors import finite, matrix, whole, width_of
from tidemark.llm.worktables import release, save

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: above the rounding error of a root in 32 bits
SLACK = 1e-6
_STATE = pa.schema([("entry", pa.list_(pa.int32())), ("upper", pa.list_(pa.float32())), ("lower", pa.list_(pa.float32())), ("sums", pa.list_(pa.int64()))])


def above(x: np.ndarray) -> np.ndarray:
    return (x * (1 + SLACK)).astype(np.float32)


def below(x: np.ndarray) -> np.ndarray:
    return (x * (1 - SLACK)).astype(np.float32)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole squared distances of rows."""
    d = a - b
    return (d * d).sum(-1)


def first_bounds(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entry, upper bound and lower bounds of each row from all distances, and how many were computed."""
    d = np.stack([squares(x, e) for e in book], 1)
    entry = d.argmin(1)  # the first of equals
    root = np.sqrt(d)
    return entry, above(root[np.arange(len(x)), entry]), below(root), d.size


def next_bounds(x: np.ndarray, book: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same from bounds that hold for this codebook, with distances only where they leave an entry open."""
    entry, upper, lower = entry.copy(), upper.copy(), lower.copy()
    half = below(np.sqrt(np.stack([squares(book, e) for e in book])) / 2)
    may = (lower <= upper[:, None]) & (half[entry] <= upper[:, None])
    may[np.arange(len(x)), entry] = False
    rows = np.flatnonzero(may.any(1))
    best = squares(x[rows], book[entry[rows]])
    upper[rows] = above(np.sqrt(best))
    lower[rows, entry[rows]] = below(np.sqrt(best))
    done = len(rows)
    for c in range(len(book)):
        own = entry[rows]
        k = np.flatnonzero((own != c) & (lower[rows, c] <= upper[rows]) & (half[own, c] <= upper[rows]))
        d = squares(x[rows[k]], book[c])
        done += len(k)
        lower[rows[k], c] = below(np.sqrt(d))
        won = (d < best[k]) | ((d == best[k]) & (c < own[k]))
        at = k[won]
        best[at], entry[rows[at]], upper[rows[at]] = d[won], c, above(np.sqrt(d[won]))
    return entry, upper, lower, done


def _round(books: np.ndarray, moved: np.ndarray | None):
    """A pass of one round: rows with new entries and bounds, then one row of sums. moved: how far each entry went."""
    parts, n, length = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, n, length + 1), np.int64)
        done, schema = 0, None
        for batch in batches:
            x = matrix(batch.column("vector"), parts * length).reshape(-1, parts, length)
            if moved is not None:
                old_entry, old_upper, old_lower = (np.asarray(batch.column(c).flatten()).reshape(len(x), parts, -1) for c in ("entry", "upper", "lower"))
            entry, upper, lower = np.zeros((len(x), parts), np.int32), np.zeros((len(x), parts), np.float32), np.zeros((len(x), parts, n), np.float32)
            for p in range(parts):
                if moved is None:
                    e, u, low, k = first_bounds(x[:, p], books[p])
                else:
                    e = old_entry[:, p, 0]
                    u = above(old_upper[:, p, 0].astype(np.float64) + moved[p][e])
                    low = below(np.maximum(old_lower[:, p].astype(np.float64) - moved[p], 0))
                    e, u, low, k = next_bounds(x[:, p], books[p], e, u, low)
                entry[:, p], upper[:, p], lower[:, p], done = e, u, low, done + k
                for c in range(n):
                    own = x[e == c, p]
                    sums[p, c, 0] += len(own)
                    sums[p, c, 1:] += own.sum(0)
            lists = lambda v, kind: pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * (v.size // max(1, len(v))), pa.array(v.ravel(), kind))
            keep = [batch.column(c) for c in ("vec_id", "label", "vector")]
            schema = pa.schema([batch.schema.field(c) for c in ("vec_id", "label", "vector")] + list(_STATE))
            yield pa.RecordBatch.from_arrays([*keep, lists(entry, pa.int32()), lists(upper, pa.float32()), lists(lower, pa.float32()), pa.nulls(len(x), pa.list_(pa.int64()))], schema=schema)
        if schema is not None:
            row = [pa.nulls(1, f.type) for f in schema][:-1] + [pa.array([[done, *sums.ravel().tolist()]], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(row, schema=schema)

    return run


def _codes(books: np.ndarray, moved: np.ndarray):
    """The last pass: entries by the same bounds, then the squared distances to them."""
    parts, n, length = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"), parts * length).reshape(-1, parts, length)
            old_entry, old_upper, old_lower = (np.asarray(batch.column(c).flatten()).reshape(len(x), parts, -1) for c in ("entry", "upper", "lower"))
            error, code = np.zeros(len(x), np.int64), np.zeros((len(x), parts), np.uint8)
            for p in range(parts):
                e = old_entry[:, p, 0]
                u = above(old_upper[:, p, 0].astype(np.float64) + moved[p][e])
                low = below(np.maximum(old_lower[:, p].astype(np.float64) - moved[p], 0))
                e = next_bounds(x[:, p], books[p], e, u, low)[0]
                code[:, p] = e
                error += squares(x[:, p], books[p][e])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def movement(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry of each part went, rounded up."""
    return np.sqrt(squares(old, new)) * (1 + SLACK)


def _summed(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, int]:
    """Sums of all tasks as Python's whole numbers: (parts, entries, 1 + length), and the distances computed."""
    parts, n, length = shape
    each = state.where("sums is not null").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    flat = np.zeros(1 + parts * n * (length + 1), object)
    for r in each.collect():  # one value for each component of each entry
        flat[r["at"]] = int(r.v)
    return flat[1:].reshape(parts, n, length + 1), flat[0]


def compress(embeddings: DataFrame, vector: str = "embedding", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Codes of all kept rows (vec_id, label, code, error, label_error), the final codebooks, distances by round.

    entries is at most 256. code has two hex digits a part; error sums squared distances over parts; label_error sums
    errors over rows of the same label, nulls together.
    """
    label = F.col("label") if "label" in embeddings.columns else F.lit(None).cast("int").alias("label")
    rows = embeddings.where(finite(vector)).select("vec_id", label, whole(vector, scale).alias("vector"))
    length = max(1, -(-width_of(rows, "vector") // parts))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    books = np.array([(r.vector + [0] * (parts * length))[: parts * length] for r in first], np.int64).reshape(len(first), parts, length).transpose(1, 0, 2)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    moved, counts, state = None, [], rows
    for _ in range(rounds if len(first) else 0):
        old = state
        kept = old if moved is None else old.where("sums is null")
        state = save(kept.mapInArrow(_round(books, moved), f"{kinds}, entry array<int>, upper array<float>, lower array<float>, sums array<bigint>"), "codes_round")
        if moved is not None:
            release(old)
        sums, done = _summed(state, books.shape)
        new = books.copy()
        for p, c in zip(*np.nonzero(sums[:, :, 0]), strict=True):
            new[p, c] = sums[p, c, 1:] // sums[p, c, 0]
        moved, books = movement(books, new), new
        counts.append(done)
    if not counts:
        none = rows.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none, books, counts
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("vector").schema)
    coded = save(state.where("sums is null").mapInArrow(_codes(books, moved), f"{kinds}, code string, error bigint"), "codes")
    release(state)
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label"), books, counts


def digest(books: np.ndarray) -> str:
    """Hex SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
