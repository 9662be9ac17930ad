"""Exact removal of repeated word windows by difference-cover anchors.

Only positions whose index modulo a period lies in a difference cover are hashed. For any
two positions some shift below the period brings both onto the cover, so two equal windows
of ``window`` words always share one aligned anchor of ``window - period + 1`` words. The
anchors that occur twice are then extended: just the windows around them are hashed whole,
and a window counts as repeated when its hash occurs a second time.

Texts are gathered once into chunks of a few MB, kept as Parquet in the shared folder. A
chunk deals each bucket one sorted array of distinct hashes (with a mark for those that it
holds twice), and the bucket answers one bit per hash. So a hash that occurs in a third of
all documents costs its bucket one entry per chunk, and no pair is ever listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, doc_ends, fan_out, gram_hashes, slices, staged, texts_of, word_hashes, word_spans

#: Perfect difference sets: every residue is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}

CHUNK_BYTES = 8 << 20
_CHUNK = "chunk long, ids array<long>, lens array<long>, texts binary"
_SENT = "chunk long, bucket int, hashes binary, twice binary"
_SAID = "chunk long, bucket int, bits binary"
_OUT = "doc_id long, n_words long, n_removed long, kept_text string"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of at least two fifths of the window."""
    best = max(p for p in COVERS if window - p + 1 >= max(1, 2 * window // 5))
    return best, COVERS[best]


def _to_chunks(batches):
    """Texts gathered to about ``CHUNK_BYTES``; the task's own number makes chunk ids unique."""
    pack = zstandard.ZstdCompressor(3)
    task, seq = TaskContext.get().partitionId(), 0
    ids, lens, parts, total = [], [], [], 0

    def chunk():
        return pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array([(task << 32) + seq], pa.int64()),
                "ids": pa.array([[i for a in ids for i in a.to_pylist()]], pa.list_(pa.int64())),
                "lens": pa.array([np.concatenate(lens)], pa.list_(pa.int64())),
                "texts": pa.array([pack.compress(b"".join(parts))], pa.binary()),
            }
        )

    for batch in batches:
        for part in slices(batch):
            raw, offs = column_bytes(part.column("text"))
            ids.append(part.column("doc_id"))
            lens.append(np.diff(offs))
            parts.append(raw.tobytes())
            total += len(raw)
            if total >= CHUNK_BYTES:
                yield chunk()
                seq, ids, lens, parts, total = seq + 1, [], [], [], 0
    if ids:
        yield chunk()


class _Chunk:
    """The words of one chunk: their spans, hashes and documents."""

    def __init__(self, lens: np.ndarray, texts: bytes):
        self.bytes = zstandard.ZstdDecompressor().decompress(texts)
        self.offs = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        hashes, starts, ends, self.woff = [], [], [], np.zeros(len(lens) + 1, np.int64)
        at = 0
        while at < len(lens):  # slices of rows, for small arrays
            to = max(at + 1, int(np.searchsorted(self.offs, self.offs[at] + (1 << 20), "right")) - 1)
            raw = np.frombuffer(self.bytes, np.uint8)[self.offs[at] : self.offs[to]]
            st, en, woff = word_spans(raw, self.offs[at : to + 1] - self.offs[at])
            hashes.append(word_hashes(raw, st, en))
            starts.append(st + self.offs[at])
            ends.append(en + self.offs[at])
            self.woff[at : to + 1] = self.woff[at] + woff
            at = to
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.st = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.en = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.end = doc_ends(self.woff)
        self.begin = np.repeat(self.woff[:-1], np.diff(self.woff))

    def anchors(self, window: int) -> tuple[np.ndarray, int]:
        """Cover positions at which an anchor lies in some whole window."""
        period, cover = cover_for(window)
        pos = np.arange(len(self.words))
        on = np.isin((pos - self.begin) % period, cover)
        length = window - period + 1
        return np.flatnonzero(on & (pos + length <= self.end) & (self.end - self.begin >= window)), length

    def windows(self, window: int, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of these anchors."""
        period, _ = cover_for(window)
        lo = np.maximum(self.begin[anchors], anchors - period + 1)
        hi = np.minimum(anchors, self.end[anchors] - window)
        marks = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(marks, lo, 1)
        np.add.at(marks, hi + 1, -1)
        return np.flatnonzero(np.cumsum(marks)[:-1] > 0)

    def covered(self, window: int, starts: np.ndarray) -> np.ndarray:
        marks = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + window, -1)
        return np.cumsum(marks)[:-1] > 0


class _Dealt:
    """Positions' hashes dealt to buckets: sorted, each distinct hash once a bucket."""

    def __init__(self, words: np.ndarray, at: np.ndarray, n: int, buckets: int):
        hashes = gram_hashes(words, at, n, 0xD1342543DE82EF95)
        bucket = (gram_hashes(words, at, n, 0xAF251AF3B0F025B5) % np.uint64(buckets)).astype(np.int64)
        self.order = np.lexsort((hashes, bucket))
        h, b = hashes[self.order], bucket[self.order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
        self.group = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        self.hashes, self.bucket = h[first], b[first]
        self.twice = np.diff(np.append(first, len(h))) > 1
        self.cuts = np.searchsorted(self.bucket, np.arange(buckets + 1))

    def rows(self, chunk: int):
        full = np.flatnonzero(np.diff(self.cuts))
        spans = [slice(self.cuts[b], self.cuts[b + 1]) for b in full]
        return pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array(np.full(len(full), chunk), pa.int64()),
                "bucket": pa.array(full, pa.int32()),
                "hashes": pa.array([self.hashes[s].tobytes() for s in spans], pa.binary()),
                "twice": pa.array([np.packbits(self.twice[s]).tobytes() for s in spans], pa.binary()),
            }
        )

    def told(self, said: list[dict]) -> np.ndarray:
        """True for each dealt position whose hash its bucket has found twice."""
        known = np.zeros(len(self.hashes), bool)
        for x in said:
            lo, hi = self.cuts[x["bucket"]], self.cuts[x["bucket"] + 1]
            known[lo:hi] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=hi - lo).astype(bool)
        out = np.zeros(len(self.order), bool)
        out[self.order] = known[self.group]
        return out


def _answers(rows: pa.Table) -> pa.Table:
    """All that one bucket got: for each chunk a bit per hash, set if it occurs twice."""
    sent = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(rows.column("twice").to_pylist(), sent)]
    _, back, n = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    repeated = n > 1
    repeated[back[np.concatenate(twice)]] = True
    told, cuts = repeated[back], np.cumsum([0, *map(len, sent)])
    bits = [np.packbits(told[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "bits": pa.chunked_array([pa.array(bits, pa.binary())])})


def _chunk_rows(batch):
    for row in batch.to_pylist():
        yield row, _Chunk(np.array(row["lens"], np.int64), row["texts"])


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that lies in a window of ``window`` words found twice.

    One row per input row: ``doc_id, n_words, n_removed, kept_text`` (kept words joined by
    one space). Windows are judged on the input. A null or empty text has no words and
    gives 0, 0 and "". Rows with equal or null ids are separate documents; an exact copy of
    a text of at least ``window`` words loses all words in both. Texts shorter than a
    window lose none. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = fan_out(spark)
    chunks = staged(texts_of(docs, id_col, text_col).mapInArrow(_to_chunks, _CHUNK), "substring-chunks")

    def send_anchors(batches):
        for batch in batches:
            for row, c in _chunk_rows(batch):
                at, n = c.anchors(window)
                yield _Dealt(c.words, at, n, buckets).rows(row["chunk"])

    def anchor_windows(row, c):
        at, n = c.anchors(window)
        found = at[_Dealt(c.words, at, n, buckets).told(row["anchors"] or [])]
        return c.windows(window, found)

    def send_windows(batches):
        for batch in batches:
            for row, c in _chunk_rows(batch):
                yield _Dealt(c.words, anchor_windows(row, c), window, buckets).rows(row["chunk"])

    def remove(batches):
        for batch in batches:
            for row, c in _chunk_rows(batch):
                at = anchor_windows(row, c)
                at = at[_Dealt(c.words, at, window, buckets).told(row["windows"] or [])]
                gone = c.covered(window, at)
                lost = np.concatenate([[0], np.cumsum(gone)])[c.woff]
                out = []
                for k, (a, b) in enumerate(zip(c.woff[:-1].tolist(), c.woff[1:].tolist())):
                    text = c.bytes[c.offs[k] : c.offs[k + 1]].split()
                    if lost[k + 1] > lost[k]:
                        text = [text[i] for i in np.flatnonzero(~gone[a:b]).tolist()]
                    out.append(b" ".join(text).decode())
                cols = [pa.array(row["ids"], pa.int64()), pa.array(np.diff(c.woff), pa.int64()), pa.array(np.diff(lost), pa.int64()), pa.array(out, pa.string())]
                whole = pa.RecordBatch.from_arrays(cols, schema=_OUT_ARROW)
                for i in range(0, whole.num_rows, 1000):
                    yield whole.slice(i, 1000)

    def round_trip(sent: DataFrame, name: str) -> DataFrame:
        said = sent.groupBy("bucket").applyInArrow(_answers, _SAID)
        return said.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))

    anchors = staged(round_trip(chunks.select("chunk", "lens", "ids", "texts").mapInArrow(send_anchors, _SENT), "anchors"), "substring-anchors")
    chunks = chunks.join(anchors, "chunk", "left")
    windows = staged(round_trip(chunks.mapInArrow(send_windows, _SENT), "windows"), "substring-windows")
    return chunks.join(windows, "chunk", "left").mapInArrow(remove, _OUT)
