"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence has three limits: tokens, segments and loss-bearing tokens. The open sequence
takes, again and again, the waiting piece whose size vector has the largest dot product
with what is left of the three limits (each as a share of its limit), among the pieces that
fit. When none fits whole, the longest is cut to fill the sequence. Each task packs its own
rows with a waiting room of bounded size, so nothing is shuffled and the order of magnitude
of memory doesn't depend on the input. What is left at a task's end is cut at powers of two.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices, texts_of
from .token_ids import encoded

WAITING = 512
PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, segment int, loss_tokens long, ids binary"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("segment", pa.int32()), ("loss_tokens", pa.int64()), ("ids", pa.binary())]
)


class Packer:
    """Packs a stream of examples; ``add`` and ``finish`` give rows of finished sequences.

    An example is (doc_id, ids as 32-bit bytes, prompt tokens): tokens from the prompt's
    end on bear loss. ``cut`` forbidden keeps pieces whole wherever they fit a sequence.
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, first_id: int, cut: bool = True):
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.max_tokens, self.cut, self.next_id = max_tokens, cut, first_id
        self.size = np.zeros((WAITING, 3))
        self.items: list[tuple | None] = [None] * WAITING
        self.n = 0
        self.open: list[tuple] = []
        self.left = self.limits.copy()

    @staticmethod
    def _loss(item: tuple, start: int, length: int) -> int:
        return max(0, start + length - max(start, item[2]))

    def _close(self) -> Iterator[tuple]:
        at = 0
        for k, (item, start, length) in enumerate(self.open):
            yield (item[0], start, length, len(item[1]) // 4, self.next_id, at, k, self._loss(item, start, length), item[1][4 * start : 4 * (start + length)])
            at += length
        self.next_id += bool(self.open)
        self.open, self.left = [], self.limits.copy()

    def _place(self, item: tuple, start: int, length: int) -> Iterator[tuple]:
        self.open.append((item, start, length))
        self.left = self.left - (length, 1, self._loss(item, start, length))
        if self.left.min() < 1:
            yield from self._close()

    def _wait(self, item: tuple, start: int, length: int) -> None:
        self.items[self.n] = (item, start, length)
        self.size[self.n] = (length, 1, self._loss(item, start, length))
        self.n += 1

    def _take(self, i: int) -> tuple:
        got, last = self.items[i], self.n - 1
        self.items[i], self.size[i] = self.items[last], self.size[last]
        self.items[last], self.n = None, last
        return got

    def _longest_cut(self, item: tuple, start: int, length: int) -> int:
        """Tokens from ``start`` on that the open sequence can still take."""
        most = min(length, int(self.left[0]))
        return min(most, max(0, item[2] - start) + int(self.left[2]))

    def _step(self) -> Iterator[tuple]:
        """Place one waiting piece, or part of one, or close the open sequence."""
        size = self.size[: self.n]
        fits = (size <= self.left).all(1)
        last_slot = self.cut and self.left[1] == 1  # only one segment more: it should fill the rest
        if fits.any() and not last_slot:
            score = np.where(fits, (size / self.limits) @ (self.left / self.limits), -1.0)
            yield from self._place(*self._take(int(score.argmax())))
            return
        if self.cut:
            item, start, length = self._take(int(size[:, 0].argmax()))
            if n := self._longest_cut(item, start, length):
                if n < length:
                    self._wait(item, start + n, length - n)
                yield from self._place(item, start, n)
                return
            self._wait(item, start, length)
        elif fits.any():
            yield from self._place(*self._take(int(fits.argmax())))
            return
        yield from self._close()

    def add(self, item: tuple) -> Iterator[tuple]:
        start, total = 0, len(item[1]) // 4
        while total - start > self.max_tokens or self._loss(item, start, total - start) > self.limits[2]:
            # longer than any sequence: whole sequences are cut off its front
            n = min(self.max_tokens, total - start, max(0, item[2] - start) + int(self.limits[2]))
            yield (item[0], start, n, total, self.next_id, 0, 0, self._loss(item, start, n), item[1][4 * start : 4 * (start + n)])
            self.next_id, start = self.next_id + 1, start + n
        if total > start:
            self._wait(item, start, total - start)
        while self.n >= WAITING - 1:
            yield from self._step()

    def finish(self) -> Iterator[tuple]:
        while self.n:
            yield from self._step()
        rest, self.open = self.open, []
        self.left = self.limits.copy()
        if not self.cut:
            self.open = rest
        else:  # lengths that are powers of two need no padding
            need = 0
            while rest:
                item, start, length = rest.pop(0)
                if not need:
                    need = 1 << (length + sum(x[2] for x in rest)).bit_length() - 1
                n = min(length, need)
                self.open.append((item, start, n))
                need -= n
                if n < length:
                    rest.insert(0, (item, start + n, length - n))
                if not need:
                    yield from self._close()
        yield from self._close()


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _ARROW.types)], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _ARROW.types)], schema=_ARROW)


def pack_examples(examples: DataFrame, max_tokens: int = 4096, max_segments: int = 256, max_loss: int | None = None, cut: bool = True) -> DataFrame:
    """Pack ``examples`` (doc_id long, ids binary of 32-bit ids, prompt long) into sequences.

    One row per piece (``PIECE``). A null prompt counts as 0, null ids as none (no piece).
    Equal or null doc_ids are separate examples. An empty table gives no rows.
    """
    most_loss = max_tokens if max_loss is None else max_loss

    def run(batches):
        packer = Packer(max_tokens, max_segments, most_loss, TaskContext.get().partitionId() << 40, cut)

        def rows():
            for b in batches:
                for x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), b.column("prompt").to_pylist()):
                    yield from packer.add((x[0], x[1] or b"", x[2] or 0))
            yield from packer.finish()

        yield from _batches(rows())

    return examples.select("doc_id", "ids", "prompt").mapInArrow(run, PIECE)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, max_tokens: int = 4096, max_segments: int = 256, max_loss: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole documents and pack them; every token of a document bears loss.

    One row per piece (``PIECE``); each id lies in exactly one piece. A null or empty text
    is the end id alone. Equal or null ids are separate documents; other columns are
    ignored; an empty table gives no rows. Pieces are cut freely, so that sequences are
    full, or have a power of two of tokens at a task's end.
    """
    most_loss = max_tokens if max_loss is None else max_loss

    def run(batches):
        packer = Packer(max_tokens, max_segments, most_loss, TaskContext.get().partitionId() << 40)

        def rows():
            for batch in batches:
                for part in slices(batch):
                    ids = encoded(tokenizer_path, part.column("text").to_pylist(), end_id)
                    for doc_id, x in zip(part.column("doc_id").to_pylist(), ids):
                        yield from packer.add((doc_id, x, 0))
            yield from packer.finish()

        yield from _batches(rows())

    return texts_of(docs, id_col, text_col).mapInArrow(run, PIECE)
