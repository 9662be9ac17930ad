"""Shared helpers: tables in the shared folder, row-group planning and vectorised word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import LARGE_ROWS
from ..sources.shared import kept as staged
from ..sources.shared import kept_tidily as staged_tidily
from ..sources.shared import shared_dir

WORD_SPLIT = r"[\x20\x09-\x0D]+"

#: Text handled at once by the vectorised helpers, so that their arrays stay small.
SLICE_BYTES = 1 << 20


def fan_out(spark: SparkSession, per_partition: int = 2) -> int:
    """Buckets to deal compact arrays into: a multiple of the shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * per_partition


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only what the operators read, under fixed names; a null text is an empty one."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about ``limit`` bytes of text; a longer text stands alone."""
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column without nulls as its UTF-8 bytes and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, and each row's first word.

    A word is a run of bytes other than space and 0x09-0x0D; none crosses a row.
    """
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    n = len(raw)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    begins = inside & (~before | first[:n])
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = inside & (~after | first[1:])
    st = np.flatnonzero(begins)
    return st, np.flatnonzero(ends) + 1, np.searchsorted(st, offs)


_RNG = np.random.default_rng(20240607)
_BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        fill = np.full(max(n, 1 << 16), _STEP if kind == "up" else _BACK, np.uint64)
        fill[0] = 1
        _powers[kind] = np.multiply.accumulate(fill)
    return _powers[kind][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads all bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(raw: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from one running sum over all bytes."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODES[raw] * _power("up", n), out=sums[1:])
    return mixed((sums[en] - sums[st]) * _power("down", n + 1)[st] + (en - st).astype(np.uint64))


def gram_hashes(words: np.ndarray, at: np.ndarray, n: int, factor: int) -> np.ndarray:
    """Hash of the ``n`` words that start at each position of ``at``."""
    out, f = np.zeros(len(at), np.uint64), np.uint64(factor | 1)
    for k in range(n):
        out = out * f + words[at + k]
    return mixed(out)


def doc_ends(woff: np.ndarray) -> np.ndarray:
    """For every word, the position after the last word of its row."""
    return np.repeat(woff[1:], np.diff(woff))


def gathered(make: Callable[[pa.RecordBatch], dict], schema: pa.Schema):
    """A ``mapInArrow`` function that applies ``make`` to slices of bounded size."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict(make(part), schema=schema)

    return run
