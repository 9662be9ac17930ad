"""Product codes of vectors in whole numbers, nearest entries by segment-mean lower bounds.

A vector is cut into equal parts; each part position has a codebook, and a part's code is
the number of the nearest entry. Two pieces of ``m`` numbers with sums ``s, t`` and residual
norms ``r, q`` (what is left of each around its own mean) are at least ``(s-t)^2/m +
(r-q)^2`` apart. These bounds are added up over one block, then over halves, quarters and so
on of the part; entries beyond the best distance known are filtered, and the survivors get
exact distances in whole numbers. A bound is lessened by more than rounding can add to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Rows whose parts are compared at once.
BATCH_ROWS = 4096
#: Up to this size of a component, squares and their sums fit 64 bits; beyond it Python's
#: whole numbers are used.
SMALL = 1 << 22
#: From here on no 64-bit number holds a component.
TOO_LARGE = float(1 << 62)
_ROUNDING, _SLACK = 1e-15, 1e-12


def block_sizes(width: int) -> list[int]:
    """Sizes of blocks from the whole part down to two, each half of the one before while
    that is even."""
    sizes = [width]
    while sizes[-1] % 2 == 0 and sizes[-1] > 2:
        sizes.append(sizes[-1] // 2)
    return sizes


def _means(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the blocks of the last axis over the root of their size, and residual norms."""
    blocks = x.reshape(*x.shape[:-1], -1, size)
    total = blocks.sum(-1)
    rest = size * (blocks * blocks).sum(-1) - total * total  # exact, as all are whole numbers
    return total.astype(float) / np.sqrt(size), np.sqrt(rest.astype(float) / size)


def _bound(a: tuple, i: np.ndarray, b: tuple, k: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances of pieces ``i`` and entries ``k``."""
    # what rounding can add goes with the size of what is subtracted
    d, r = (np.maximum(np.abs(u[i] - v[k]) - _ROUNDING * (np.abs(u[i]) + np.abs(v[k])), 0) for u, v in zip(a, b))
    return (d * d + r * r).sum(-1) * (1 - _SLACK)


def nearest_entries(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row of ``x``, the lowest number on ties, its squared
    distance, and how many exact distances were worked out. Both hold whole numbers."""
    n, width = x.shape
    exact = lambda i, k: ((x[i] - entries[k]) ** 2).sum(-1)
    rows = np.arange(n)
    coarse, *finer = [(_means(x, m), _means(entries, m)) for m in block_sizes(width)]
    every = np.repeat(rows, len(entries)), np.tile(np.arange(len(entries)), n)
    bound = _bound(coarse[0], every[0], coarse[1], every[1]).reshape(n, -1)
    guess = bound.argmin(1)
    known = exact(rows, guess)
    limit = known.astype(float)
    i, k = np.nonzero(bound <= limit[:, None])
    for a, b in finer:
        stays = _bound(a, i, b, k) <= limit[i]
        i, k = i[stays], k[stays]
    other = k != guess[i]
    i, k = i[other], k[other]
    far = exact(i, k)
    # of a row's survivors the nearest, then the lowest, is the last one written
    order = np.lexsort((-k, [-int(v) for v in far] if far.dtype == object else -far, i)) if len(i) else np.zeros(0, int)
    best, at = known.copy(), guess.copy()
    i, k, far = i[order], k[order], far[order]
    last = np.append(i[1:] != i[:-1], True) if len(i) else np.zeros(0, bool)
    i, k, far = i[last], k[last], far[last]
    closer = (far < known[i]) | ((far == known[i]) & (k < guess[i]))
    best[i[closer]], at[i[closer]] = far[closer], k[closer]
    return at, best, n + len(order)


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as 64-bit numbers, or Python's where squares wouldn't fit."""
    scaled = np.floor(scale * x)
    if not scaled.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    return scaled.astype(np.int64).astype(object)


def _usable(vector: Column, scale: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < TOO_LARGE))
    return vector.isNotNull() & fine


def _batches(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of rows, which of them have ``width`` components, and these as whole numbers."""
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(start, BATCH_ROWS)
            vectors = part.column("vector")
            sizes = np.diff(vectors.offsets.to_numpy())
            fits = sizes == width
            flat = vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(float)
            yield part, fits, whole_numbers(flat.reshape(-1, width), scale)


def _as_books(books: list) -> np.ndarray:
    """``parts, entries, width`` whole numbers."""
    small = max((abs(v) for part in books for entry in part for v in entry), default=0) < SMALL
    return np.array(books, dtype=np.int64 if small else object)


def _assigned(x: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part its number, values, codes and squared distances."""
    if x.dtype != books.dtype:
        x, books = x.astype(object), books.astype(object)
    width = books.shape[2]
    for p in range(len(books)):
        own = x[:, p * width : (p + 1) * width]
        yield p, own, *nearest_entries(own, books[p])[:2]


def _summed(books: list, scale: int):
    """Per task and entry: how many parts are nearest to it, and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _as_books(books)
        parts, size, width = held.shape
        counts, sums = np.zeros((parts, size), np.int64), np.zeros(held.shape, object)
        for _, _, x in _batches(batches, parts * width, scale):
            for p, own, code, _ in _assigned(x, held):
                counts[p] += np.bincount(code, minlength=size)
                some = np.zeros((size, width), own.dtype)
                np.add.at(some, code, own)
                sums[p] += some
        p, k = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(np.repeat(p, width), pa.int32()),
                "entry": pa.array(np.repeat(k, width), pa.int32()),
                "at": pa.array(np.tile(np.arange(width), len(p)), pa.int32()),
                "n": pa.array(np.repeat(counts[p, k], width), pa.int64()),
                "total": pa.array([str(int(v)) for v in sums[p, k].ravel()], pa.string()),
            }
        )

    return run


def trained(vectors: DataFrame, books: list, rounds: int, scale: int) -> list:
    """Codebooks after some rounds; each reads all of ``vectors`` and gives the driver one
    number for each component of each entry."""
    for _ in range(rounds):
        sums = vectors.select("vector").mapInArrow(_summed(books, scale), "part int, entry int, at int, n long, total string")
        found = sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        books = [[list(entry) for entry in part] for part in books]
        for r in found:
            books[r["part"]][r["entry"]][r["at"]] = int(r["total"]) // r["n"]
    return books


def book_text(books: list) -> str:
    """All components in order of part, entry and place, as decimal numbers with commas."""
    return ",".join(str(v) for part in books for entry in part for v in entry)


def encoded(vectors: DataFrame, books: list, scale: int) -> DataFrame:
    """``vec_id, label, code, error`` of ``vec_id, label, vector``."""
    kind = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _as_books(books)
        parts, _, width = held.shape
        for part, fits, x in _batches(batches, parts * width, scale):
            codes, errors = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), object)
            for p, _, code, far in _assigned(x, held):
                codes[:, p] = code
                errors = errors + far
            texts, sums = [c.tobytes().hex() for c in codes], [int(e) if e < 2**63 else None for e in errors]
            at = np.where(fits, np.cumsum(fits) - 1, -1).tolist()
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("label"), pa.array([texts[k] if k >= 0 else None for k in at], pa.string()), pa.array([sums[k] if k >= 0 else None for k in at], pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return vectors.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def vector_codes(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, list]:
    """``vec_id, code, error, label_error`` of the rows of ``vectors``, and the codebooks.

    Rows without a vector, or with a null or non-finite component (or one whose scaled value
    no 64-bit number holds), are dropped. The codebook of each part starts as that part of
    the ``entries`` (at most 256) rows with the smallest ids, rows of equal id in the order
    of their vectors and null ids last; fewer rows give fewer entries. These rows set the
    length, which must be a multiple of ``parts``; a row of another length has a null code
    and error. An error beyond 64 bits is null; ``label_error`` adds up the errors that
    aren't. Rows with equal ids are coded each by itself; other columns are ignored; an
    empty table gives no rows and no codebooks.

    Each round is one pass over the table that only moves sums. ``vectors`` is read
    ``rounds`` + 2 times and must give the same rows each time.
    """
    if not 0 < entries <= 256:
        raise ValueError("one to 256 entries")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.where(_usable(F.col("vector"), scale)).withColumn("vector", F.col("vector").cast("array<double>"))
    first = rows.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    length = len(first[0]["vector"]) if first else 0
    if first and (length % parts or not length):
        raise ValueError(f"vectors of {length} components have no {parts} equal parts")
    books: list = []
    if first:
        starts = [whole_numbers(np.array(r["vector"], float), scale).tolist() for r in first if len(r["vector"]) == length]
        width = length // parts
        books = trained(rows, [[s[p * width : (p + 1) * width] for s in starts] for p in range(parts)], rounds, scale)
        coded = staged(encoded(rows, books, scale), "vector-codes")
    else:
        coded = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error"), books


def books_digest(books: list) -> str:
    return hashlib.sha256(book_text(books).encode()).hexdigest()
