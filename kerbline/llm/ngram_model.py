"""An interpolated modified Kneser-Ney bigram model, counted in Spark.

Words are 56-bit hashes. Each task adds up the bigrams of a bounded run of tokens and deals
them by the hash of their first word; a bucket adds its counts and writes sorted hash
arrays (bigrams; contexts) to a file of its own in the shared folder, and passes on how
many contexts each second word has. A second deal, by that word, gives the continuation
counts and token counts, in files of the same kind. Workers map the files into memory and
look up sorted queries, so that no task holds the model. Nothing is pruned. A hot first
word costs its bucket one entry per task and distinct pair.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, mixed, shared_dir, slices, staged, texts_of, word_hashes, word_spans

_LOW = np.uint64((1 << 56) - 1)
BEGIN, END = (int(x) for x in mixed(np.array([3, 5], np.uint64)) & _LOW)
RUN_TOKENS = 2_000_000
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _pack(x: np.ndarray) -> bytes:
    """56-bit values as seven bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8")


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(x) % np.uint64(buckets)).astype(np.int64)


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(u * np.uint64(0x9E3779B97F4A7C15) + w)


def token_pairs(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second words of all bigrams, begin and end marks included, and each row's
    first bigram. ASCII letters are lowered."""
    raw, offs = column_bytes(part.column("text"))
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    st, en, woff = word_spans(raw, offs)
    rows = len(woff) - 1
    at = woff + np.arange(rows + 1)  # one end mark more for each row before
    second = np.full(at[-1], END, np.uint64)
    keep = np.ones(at[-1], bool)
    keep[at[1:] - 1] = False
    second[keep] = word_hashes(raw, st, en) & _LOW
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[at[:-1]] = BEGIN
    return first, second, at


def _write(path: str, **arrays: np.ndarray) -> None:
    """One file of named arrays, put in place at once, so that a second try does no harm."""
    fs, where = pafs.FileSystem.from_uri(path)
    head = json.dumps({k: [v.dtype.str, len(v)] for k, v in arrays.items()}).encode()
    head += b" " * (-(len(head) + 8) % 64)
    part = f"{where}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for v in arrays.values():
            data = v.tobytes()
            out.write(data + b"\0" * (-len(data) % 64))
    fs.move(part, where)


def _mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory; a file of a remote store is fetched first,
    to a copy that is unlinked at once and goes with the worker."""
    fs, where = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(where).type == pafs.FileType.NotFound:
        return {}
    gone = None
    if not isinstance(fs, pafs.LocalFileSystem):
        handle, gone = tempfile.mkstemp()
        with fs.open_input_stream(where) as src, os.fdopen(handle, "wb") as out:
            shutil.copyfileobj(src, out)
        where = gone
    data = np.memmap(where, np.uint8, "r")
    if gone:
        os.unlink(gone)
    n = int.from_bytes(data[:8].tobytes(), "little")
    found, at = {}, 8 + n
    for name, (kind, count) in json.loads(data[8:at].tobytes()).items():
        size = np.dtype(kind).itemsize * count
        found[name] = data[at : at + size].view(kind)
        at += size + -size % 64
    return found


def _count_pairs(buckets: int):
    def deal(first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((second, first, _bucket(first, buckets)))
        u, w = first[order], second[order]
        fresh = np.ones(len(u), bool)
        fresh[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
        at = np.flatnonzero(fresh)
        n = np.diff(np.append(at, len(u))).astype(np.uint32)  # a run is RUN_TOKENS and one text at most, which fits
        u, w = u[at], w[at]
        b = _bucket(u, buckets)
        cuts = np.searchsorted(b, np.arange(buckets + 1))
        rows = []
        for k in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[k], cuts[k + 1])
            new = np.flatnonzero(np.append(True, u[s][1:] != u[s][:-1]))
            rows.append((int(k), _pack(u[s][new]), np.diff(np.append(new, s.stop - s.start)).astype("<u4").tobytes(), _pack(w[s]), n[s].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], names=["bucket", "firsts", "runs", "seconds", "counts"])

    def run(batches):
        us, ws, total = [], [], 0
        for batch in batches:
            for part in slices(batch):
                u, w, _ = token_pairs(part)
                us.append(u)
                ws.append(w)
                total += len(u)
                if total >= RUN_TOKENS:
                    yield deal(np.concatenate(us), np.concatenate(ws))
                    us, ws, total = [], [], 0
        if total:
            yield deal(np.concatenate(us), np.concatenate(ws))

    return run


def _narrow(counts: np.ndarray) -> bytes:
    """Counts as 32-bit numbers if all fit, else as 64-bit."""
    return counts.astype("<u4" if not len(counts) or counts.max() < 1 << 32 else "<i8").tobytes()


def _widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u4" if len(data) == 4 * n else "<i8").astype(np.int64)


def _of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _bigram_file(path: str, buckets: int):
    """Adds a bucket's bigrams, writes them, and deals its second words on."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        u = np.concatenate([np.repeat(_unpack(a), np.frombuffer(r, "<u4")) for a, r in zip(rows.column("firsts").to_pylist(), rows.column("runs").to_pylist())])
        w = np.concatenate([_unpack(x) for x in rows.column("seconds").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("counts").to_pylist()]).astype(np.int64)
        order = np.lexsort((w, u))
        u, w, n = u[order], w[order], n[order]
        at = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])))
        n = np.add.reduceat(n, at)
        u, w = u[at], w[at]
        first = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        kinds = [np.add.reduceat((n == k if k < 3 else n >= 3).astype(np.uint32), first, dtype=np.uint32) for k in (1, 2, 3)]
        key = _pair(u, w) >> np.uint64(16)
        by = np.argsort(key, kind="stable")
        few = np.minimum(n[by], 255).astype(np.uint8)
        big = np.flatnonzero(few == 255)
        _write(
            f"{path}/bigrams-{bucket:06d}",
            high=(key[by] >> np.uint64(16)).astype(np.uint32), low=(key[by] & np.uint64(0xFFFF)).astype(np.uint16), few=few, big_at=big.astype(np.int64), big_n=n[by][big].astype(np.int64),
            context=u[first], total=np.add.reduceat(n, first).astype(np.int64), n1=kinds[0], n2=kinds[1], n3=kinds[2],
        )
        order = np.lexsort((w, _bucket(w, buckets)))
        sw, sn = w[order], n[order]
        at = np.flatnonzero(np.append(True, sw[1:] != sw[:-1]))
        contexts, tokens, sw = np.diff(np.append(at, len(sw))).astype(np.uint32), np.add.reduceat(sn, at), sw[at]
        cuts = np.searchsorted(_bucket(sw, buckets), np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts)).tolist()
        part = [slice(cuts[k], cuts[k + 1]) for k in full]
        stats = [json.dumps(_of_counts(n)) if i == 0 else None for i in range(len(full))]
        return pa.table({"bucket": pa.array(full, pa.int32()), "words": pa.array([_pack(sw[s]) for s in part], pa.binary()), "contexts": pa.array([contexts[s].tobytes() for s in part], pa.binary()), "tokens": pa.array([_narrow(tokens[s]) for s in part], pa.binary()), "stats": pa.array(stats, pa.string())})

    return run


def _word_file(path: str):
    """Adds a bucket's continuation and token counts and writes them."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        dealt = [_unpack(x) for x in rows.column("words").to_pylist()]
        words = np.concatenate(dealt)
        contexts = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("contexts").to_pylist()])
        tokens = np.concatenate([_widened(x, len(w)) for x, w in zip(rows.column("tokens").to_pylist(), dealt)])
        order = np.argsort(words, kind="stable")
        words = words[order]
        at = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        contexts, tokens = (np.add.reduceat(x[order].astype(np.int64), at) for x in (contexts, tokens))
        _write(f"{path}/words-{bucket:06d}", word=words[at], contexts=contexts.astype(np.uint32 if contexts.max() < 2**32 else np.int64), tokens=tokens.astype(np.uint32 if tokens.max() < 2**32 else np.int64))
        return pa.table({"n_words": [len(at)], "n_tokens": [int(tokens.sum())], "n_pairs": [int(contexts.sum())], "kinds": [json.dumps([*_of_counts(contexts), int((contexts >= 3).sum())])]})

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from how many items occur 1, 2, 3 and 4 times; where a number
    is 0 and they aren't defined, 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = n[:4]
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3


@dataclass(frozen=True)
class NgramModel:
    """Where the arrays are, and the few totals that scoring needs."""

    path: str
    buckets: int
    n_tokens: int
    n_words: int
    n_pairs: int
    bigram_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_backoff: float


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> NgramModel:
    """Count all of ``docs`` and write the model's arrays to the shared folder.

    The driver gets one short row for each bucket. An empty table gives a model in which
    every word has probability 1 / (vocabulary + 1).
    """
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = shared_dir(spark)
    path = f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/ngram-{uuid.uuid4().hex}"
    path = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path
    fs, where = pafs.FileSystem.from_uri(path)
    fs.create_dir(where)
    dealt = texts_of(docs, id_col, text_col).mapInArrow(_count_pairs(n), "bucket int, firsts binary, runs binary, seconds binary, counts binary")
    passed = staged(dealt.groupBy("bucket").applyInArrow(_bigram_file(path, n), "bucket int, words binary, contexts binary, tokens binary, stats string"), "ngram-seconds")
    words = passed.groupBy("bucket").applyInArrow(_word_file(path), "n_words long, n_tokens long, n_pairs long, kinds string").collect()
    stats = passed.where("stats IS NOT NULL").select("stats").collect()
    pair_kinds = np.sum([json.loads(x["stats"]) for x in stats] or [[0] * 4], axis=0).tolist()
    word_kinds = np.sum([json.loads(x["kinds"]) for x in words] or [[0] * 5], axis=0).tolist()
    total = sum(x["n_pairs"] for x in words)
    d = discounts(word_kinds)
    backoff = (d[0] * word_kinds[0] + d[1] * word_kinds[1] + d[2] * word_kinds[4]) / total if total else 1.0
    return NgramModel(path, n, sum(x["n_tokens"] for x in words), sum(x["n_words"] for x in words), total, discounts(pair_kinds), d, backoff)


_open: dict[tuple[str, str, int], dict[str, np.ndarray]] = {}


def _file(path: str, kind: str, bucket: int) -> dict[str, np.ndarray]:
    key = (path, kind, bucket)
    if key not in _open:
        if any(k[0] != path for k in _open):
            _open.clear()
        _open[key] = _mapped(f"{path}/{kind}-{bucket:06d}")
    return _open[key]


def _discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(n > 0, n - np.array([0.0, *d])[np.minimum(n, 3).astype(np.int64)], 0.0)


def _at(array: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(array, want), max(0, len(array) - 1))
    return at, array[at] == want


class _Scorer:
    def __init__(self, model: NgramModel):
        self.m = model

    def words(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token counts and continuation counts of sorted distinct words."""
        tokens, contexts = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        for rows, f in self._spread(w, "words"):
            at, hit = _at(f["word"], w[rows])
            tokens[rows[hit]], contexts[rows[hit]] = f["tokens"][at[hit]], f["contexts"][at[hit]]
        return tokens, contexts

    def contexts(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Total count and backed-off mass of sorted distinct contexts."""
        total, mass = np.zeros(len(u), np.int64), np.ones(len(u))
        for rows, f in self._spread(u, "bigrams"):
            at, hit = _at(f["context"], u[rows])
            rows, at = rows[hit], at[hit]
            total[rows] = f["total"][at]
            mass[rows] = sum(d * f[k][at] for d, k in zip(self.m.bigram_discounts, ("n1", "n2", "n3"))) / np.maximum(total[rows], 1)
        return total, mass

    def pairs(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of distinct bigrams."""
        n = np.zeros(len(u), np.int64)
        for rows, f in self._spread(u, "bigrams"):
            key = _pair(u[rows], w[rows]) >> np.uint64(16)
            by = np.argsort(key)
            rows, key = rows[by], key[by]
            high, low = (key >> np.uint64(16)).astype(np.uint32), (key & np.uint64(0xFFFF)).astype(np.uint16)
            at = np.searchsorted(f["high"], high)
            end = len(f["high"])
            while len(rows):  # as many entries as share the high half
                ok = at < end
                i = np.minimum(at, end - 1)
                hit = ok & (f["high"][i] == high) & (f["low"][i] == low)
                few = f["few"][i[hit]].astype(np.int64)
                if len(f["big_at"]):
                    j, is_big = _at(f["big_at"], i[hit])
                    few = np.where(is_big, f["big_n"][j], few)
                n[rows[hit]] = few
                more = ok & ~hit & (f["high"][i] == high)
                rows, high, low, at = rows[more], high[more], low[more], at[more] + 1
        return n

    def _spread(self, x: np.ndarray, kind: str):
        b = _bucket(x, self.m.buckets)
        order = np.argsort(b, kind="stable")
        cuts = np.searchsorted(b[order], np.arange(self.m.buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            if f := _file(self.m.path, kind, int(k)):
                yield order[cuts[k] : cuts[k + 1]], f

    def log10(self, first: np.ndarray, second: np.ndarray):
        """log10 probability, base log10 probability and whether it is known, of each token."""
        m = self.m
        w, wi = np.unique(second, return_inverse=True)
        tokens, contexts = self.words(w)
        base = np.log10((tokens + 1) / (m.n_tokens + (m.n_words + 1)))
        single = _discounted(contexts, m.word_discounts) / max(1, m.n_pairs) + m.word_backoff / (m.n_words + 1)
        u, ui = np.unique(first, return_inverse=True)
        total, mass = self.contexts(u)
        key, at, ki = np.unique(_pair(first, second), return_index=True, return_inverse=True)
        seen = _discounted(self.pairs(first[at], second[at]), m.bigram_discounts)[ki]
        p = np.where(total[ui] > 0, seen / np.maximum(total[ui], 1), 0.0) + mass[ui] * single[wi]
        return np.log10(p), base[wi], (tokens > 0)[wi]


def score(docs: DataFrame, model: NgramModel, held_out: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, base_score, score`` of every row of ``docs``.

    Scores are log10 probabilities of the whole text with its end mark. A null or empty
    text is the end mark alone; rows with equal or null ids are scored each by itself;
    other columns are ignored; an empty table gives no rows.
    """
    flag = F.lit(False) if held_out is None else held_out

    def run(batches):
        scorer = _Scorer(model)
        for batch in batches:
            for part in slices(batch, 2 << 20):
                first, second, at = token_pairs(part)
                p, base, known = scorer.log10(first, second)
                sums = [np.add.reduceat(x, at[:-1]) for x in (known.astype(np.int64), base, p)]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": pa.array(np.diff(at), pa.int64()), "n_known": pa.array(sums[0], pa.int64()), "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), flag.alias("held_out"))
    return rows.mapInArrow(run, _SCORES)
