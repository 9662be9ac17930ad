"""Toxic spans and document scores by a linear-chain conditional random field.

Labels are of documents only, so tokens are labelled first: over a bounded sample of
labelled rows Spark counts, for hashed words and word beginnings, in how many toxic and
clean documents they occur; a token of a toxic document is toxic if its evidence (a lower
bound of the log odds) is high. The field is fitted to these token labels by gradient
steps on the exact likelihood. For every document, forward and backward passes give each
token's marginal; sums of marginals make the document's score, and tokens with a marginal
of at least one half are the offending spans.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, slices, staged, texts_of, word_hashes, word_spans

#: Beginnings of words, in bytes, that carry evidence beside the whole word.
BEGINNINGS = (4, 5, 6, 7)
BUCKETS = 1 << 20
#: Tasks that a step of the fit is dealt to, and tokens that a task looks at together.
CHAIN_TASKS, CHAIN_TOKENS = 8, 1 << 18
#: Tokens of a block of a long text.
BLOCK = 128
_OUT = "doc_id long, score double, n_toxic_tokens long, spans array<struct<start:int,end:int>>"
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case (ASCII and Latin-1 letters), starts and ends of words without
    punctuation around them, each row's first word, and the rows' offsets."""
    raw, offs = column_bytes(part.column("text"))
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    two = np.flatnonzero(raw[:-1] == 0xC3) + 1 if len(raw) else np.zeros(0, int)
    up = two[(raw[two] >= 0x80) & (raw[two] <= 0x9E) & (raw[two] != 0x97)]
    low[up] += 32
    st, en, woff = word_spans(raw, offs)
    while True:
        back = (en > st) & _PUNCTUATION[low[np.maximum(en - 1, 0)]] if len(en) else np.zeros(0, bool)
        if not back.any():
            break
        en = en - back
    while True:
        on = (en > st) & _PUNCTUATION[low[np.minimum(st, len(low) - 1)]] if len(st) else np.zeros(0, bool)
        if not on.any():
            break
        st = st + on
    return low, st, en, woff, offs


def keys(low: np.ndarray, st: np.ndarray, en: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(token numbers, buckets) of words and of each length of beginning."""
    out = []
    for n in (0, *BEGINNINGS):
        which = np.flatnonzero(en - st >= max(1, n))
        to = st[which] + n if n else en[which]
        h = word_hashes(low, st[which], to) ^ np.uint64(0x5851F42D4C957F2D * (n + 1) & (2**64 - 1))
        out.append((which, (h % np.uint64(BUCKETS)).astype(np.int64)))
    return out


@dataclass
class Field:
    """What scoring needs; all of bounded size."""

    table: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.array([-4.0, 1.0, 0.0, 0.0]))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0, 0.0]))

    def evidence(self, low, st, en) -> np.ndarray:
        out = np.zeros(len(st), np.float32)
        for which, bucket in keys(low, st, en):
            out[which] = np.maximum(out[which], self.table[bucket])
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights


def inputs(evidence: np.ndarray, woff: np.ndarray) -> np.ndarray:
    """Per token: one, its evidence, and those of its neighbours in the document."""
    before, after = np.zeros_like(evidence), np.zeros_like(evidence)
    before[1:], after[:-1] = evidence[:-1], evidence[1:]
    full = woff[:-1][np.diff(woff) > 0]
    before[full] = 0
    after[np.append(full[1:], len(evidence))[: len(full)] - 1] = 0
    return np.stack([np.ones_like(evidence), evidence, before, after], 1).astype(np.float64)


def _ratio(move, a):
    """log of (e^move[0,1] + e^(move[1,1]+a)) / (e^move[0,0] + e^(move[1,0]+a))"""
    return np.logaddexp(move[0, 1], move[1, 1] + a) - np.logaddexp(move[0, 0], move[1, 0] + a)


def _odds(e: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log odds of the forward pass, columns of ``e`` from the top.

    Long columns are cut into blocks. What a block does to the odds is a fraction of linear
    forms, the product of its tokens' two-by-two matrices; with these, all blocks pass
    through together."""
    n, rows = e.shape
    if n <= 4 * BLOCK:
        a = np.empty_like(e)
        a[0] = e[0]
        for t in range(1, n):
            a[t] = e[t] + _ratio(moves, a[t - 1])
        return a
    blocks = -(-n // BLOCK)
    e = np.concatenate([e, np.zeros((blocks * BLOCK - n, rows))]).reshape(blocks, BLOCK, rows)
    x, m = np.exp(np.clip(e, -300, 300)), np.exp(moves - moves.max())
    p = [np.ones((blocks, rows)), np.zeros((blocks, rows)), np.zeros((blocks, rows)), np.ones((blocks, rows))]
    for t in range(BLOCK):
        q = [x[:, t] * (m[1, 1] * p[0] + m[0, 1] * p[2]), x[:, t] * (m[1, 1] * p[1] + m[0, 1] * p[3]), m[1, 0] * p[0] + m[0, 0] * p[2], m[1, 0] * p[1] + m[0, 0] * p[3]]
        if t == 0:  # no move leads to the first token
            q[0][0], q[1][0], q[2][0], q[3][0] = x[0, 0], 0.0, 0.0, 1.0
        size = q[0] + q[1] + q[2] + q[3]
        p = [v / size for v in q]
    starts, top, low = np.zeros((blocks, rows)), np.ones(rows), np.ones(rows)
    for k in range(blocks - 1):
        top, low = p[0][k] * top + p[1][k] * low, p[2][k] * top + p[3][k] * low
        size = top + low
        top, low = top / size, low / size
        starts[k + 1] = np.log(np.maximum(top, 1e-300)) - np.log(np.maximum(low, 1e-300))
    a = np.empty_like(e)
    a[:, 0] = e[:, 0] + np.where(np.arange(blocks)[:, None] > 0, _ratio(moves, starts), 0.0)
    for t in range(1, BLOCK):
        a[:, t] = e[:, t] + _ratio(moves, a[:, t - 1])
    return a.reshape(-1, rows)[:n]


def marginals(s: np.ndarray, woff: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Probability that each token is toxic; rows of like length pass through together.

    With ``pairs`` also the expected number of each kind of move."""
    out, expected = np.zeros(len(s)), np.zeros((2, 2))
    size = np.diff(woff)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    k = 0
    while k < len(order):
        n = min(len(order) - k, 512, max(1, (1 << 21) // int(size[order[min(k + 511, len(order) - 1)]])))
        rows = order[k : k + n]
        k += n
        longest = int(size[rows[-1]])
        step = np.arange(longest)[:, None]
        inside = step < size[rows]
        at, back = woff[:-1][rows] + step, woff[1:][rows] - 1 - step
        e = np.where(inside, s[np.minimum(at, len(s) - 1)], 0.0)
        a = _odds(e, moves)
        # from the end, the same pass with moves turned round; each row begins at its last token
        c = _odds(np.where(inside, s[np.maximum(back, 0)], 0.0), moves.T)
        b = np.take_along_axis(c, np.where(inside, size[rows] - 1 - step, 0), 0) - e
        z = a + b
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        out[at[inside]] = p[inside]
        if pairs and longest > 1:
            left, right, on = a[:-1], e[1:] + b[1:], inside[1:]
            parts = np.stack([moves[i, j] + i * left + j * right for i in (0, 1) for j in (0, 1)])
            parts = np.exp(parts - np.logaddexp.reduce(parts, 0))
            expected += parts[:, on].sum(1).reshape(2, 2)
    return (out, expected) if pairs else out


def gradient_sums(x: np.ndarray, labels: np.ndarray, woff: np.ndarray, w: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Nine sums over some documents: inputs times what labels exceed marginals by, moves of
    the labels less those expected, and the number of tokens."""
    seen, same = np.zeros((2, 2)), np.ones(len(labels), bool)
    same[woff[:-1][np.diff(woff) > 0]] = False
    np.add.at(seen, (labels[:-1][same[1:]], labels[1:][same[1:]]), 1)
    p, expected = marginals(x @ w, woff, moves, pairs=True)
    return np.concatenate([x.T @ (labels - p), (seen - expected).ravel(), [len(labels)]])


def fit_field(sums, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves by adaptive gradient steps on the likelihood of the token labels;
    ``sums(w, moves)`` gives the ``gradient_sums`` of all documents."""
    w, moves = np.array([-3.0, 1.0, 0.0, 0.0]), np.zeros((2, 2))
    gw, gm = np.full(4, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(steps):
        total = sums(w, moves)
        dw = total[:4] / max(total[8], 1) - 1e-5 * w
        dm = total[4:8].reshape(2, 2) / max(total[8], 1) - 1e-5 * moves
        gw, gm = gw + dw * dw, gm + dm * dm
        w, moves = w + 0.5 * dw / np.sqrt(gw), moves + 0.5 * dm / np.sqrt(gm)
    return w, moves


def _chains(batches, model: Field):
    """The evidence of each text's tokens, as one list a row."""
    for batch in batches:
        for part in slices(batch):
            low, st, en, woff, _ = tokens(part)
            lists = pa.ListArray.from_arrays(pa.array(woff.astype(np.int32)), pa.array(model.evidence(low, st, en)))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), lists], names=["toxic", "evidence"])


def _step(w: np.ndarray, moves: np.ndarray):
    """One row a task: the sums over its documents, taken ``CHAIN_TOKENS`` or a document at once."""

    def run(batches):
        total = np.zeros(9)
        for batch in batches:
            lists, toxic = batch.column("evidence"), batch.column("toxic").to_numpy(zero_copy_only=False)
            woff = lists.offsets.to_numpy().astype(np.int64)
            flat, woff = lists.values.to_numpy(zero_copy_only=False)[woff[0] : woff[-1]], woff - woff[0]
            start = 0
            while start < len(toxic):
                stop = max(start + 1, int(np.searchsorted(woff, woff[start] + CHAIN_TOKENS, "right")) - 1)
                own, off = flat[woff[start] : woff[stop]], woff[start : stop + 1] - woff[start]
                label = ((np.repeat(toxic[start:stop], np.diff(off)) == 1) & (own > 1.0)).astype(int)
                total += gradient_sums(inputs(own, off), label, off, w, moves)
                start = stop
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return run


def summaries(p: np.ndarray, woff: np.ndarray) -> np.ndarray:
    """Per document: one, the sum of marginals (as log), the largest, and the density."""
    size = np.diff(woff)
    total = np.concatenate([[0.0], np.cumsum(p)])
    sums = np.maximum(total[woff[1:]] - total[woff[:-1]], 0)
    most = np.zeros(len(size))
    full = size > 0
    if full.any():
        most[full] = np.maximum.reduceat(p, woff[:-1][full])
    return np.stack([np.ones(len(size)), np.log1p(sums), most, np.minimum(1.0, 20 * sums / np.maximum(size, 1))], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: float, steps: int = 60) -> np.ndarray:
    """Newton steps with a small ridge; rows of class 1 count ``weight`` times."""
    w, c = np.zeros(x.shape[1]), np.where(y == 1, weight, 1.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (c * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        move = np.linalg.solve(hess, x.T @ (c * (y - p)) - 1e-2 * w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, chain_rows: int = 400, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Field:
    """Fit on at most ``sample_rows`` labelled rows of ``docs``, those with least hashes.

    Half of them (by another hash) give the evidence counts and, from at most
    ``chain_rows`` whole texts of each class, the field (each step adds up sums of
    ``CHAIN_TASKS`` tasks); the others the weights of document scores. Null ids and null labels take no part; of documents that share an id, the one
    whose text comes first in order is the labelled one. With
    no toxic or no clean row every score is low (a fixed prior).
    """
    pick = F.xxhash64("doc_id", F.lit(1))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(toxic_col).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(pick, "doc_id").limit(sample_rows)
    sample = texts_of(docs, id_col, text_col).join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # at most sample_rows
    sample = staged(sample.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2))), "toxic-sample")
    sizes = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    toxic, clean = sizes.get((0, 1), 0), sizes.get((0, 0), 0)
    model = Field()
    if not toxic or not clean:
        return model

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                low, st, en, woff, _ = tokens(part)
                row = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
                both = np.unique(np.concatenate([row[w] * BUCKETS + b for w, b in keys(low, st, en)]))
                is_toxic = part.column("toxic").to_numpy(zero_copy_only=False)[both // BUCKETS] == 1
                bucket, back = np.unique(both % BUCKETS, return_inverse=True)
                n = [np.bincount(back, m, len(bucket)).astype(np.int64) for m in (is_toxic, ~is_toxic)]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int64()), "t": pa.array(n[0]), "c": pa.array(n[1])})

    sent = sample.where("half = 0").select("doc_id", "text", "toxic").mapInArrow(count, "bucket long, t long, c long")
    found = sent.groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t >= 4").collect()  # at most BUCKETS rows
    b, t, c = (np.array([r[k] for r in found], float) for k in ("bucket", "t", "c"))
    odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)) - np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    model.table[b.astype(np.int64)] = np.maximum(odds, 0)

    shared = docs.sparkSession.sparkContext.broadcast(model)
    first = sample.where("half = 0").select("doc_id", "text", "toxic").orderBy(pick, "doc_id")
    some = first.where("toxic = 0").limit(chain_rows).union(first.where("toxic = 1").limit(chain_rows))
    chains = some.repartition(CHAIN_TASKS).mapInArrow(lambda batches: _chains(batches, shared.value), "toxic int, evidence array<float>").persist()
    try:
        model.weights, model.moves = fit_field(lambda w, moves: np.sum([r["sums"] for r in chains.mapInArrow(_step(w, moves), "sums array<double>").collect()], axis=0))
    finally:
        chains.unpersist()

    second = sample.where("half = 1")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def summarise(batches):
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                low, st, en, woff, _ = tokens(part)
                s = summaries(marginals(m.emissions(inputs(m.evidence(low, st, en), woff)), woff, m.moves), woff)
                yield pa.RecordBatch.from_pydict({"toxic": part.column("toxic"), "x": pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), s.shape[1]).cast(pa.list_(pa.float64()))})

    got = second.select("doc_id", "text", "toxic").mapInArrow(summarise, "toxic int, x array<double>").collect()  # at most sample_rows
    y = np.array([r["toxic"] for r in got])
    if len(set(y.tolist())) == 2:
        model.document = fit_logistic(np.array([r["x"] for r in got]), y, weight=1.5)
    return model


def _offsets(raw: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Byte spans as code points."""
    return [{"start": len(raw[:a].decode()), "end": len(raw[:b].decode())} for a, b in spans]


def score(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, n_toxic_tokens, spans`` of every row of ``docs``; spans in code points.

    A null or empty text has no tokens and the score of none. Rows with equal or null ids
    are scored each by itself; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in slices(batch, 4 << 20):
                low, st, en, woff, offs = tokens(part)
                p = marginals(m.emissions(inputs(m.evidence(low, st, en), woff)), woff, m.moves)
                z = summaries(p, woff) @ m.document
                hits = np.flatnonzero(p >= 0.5)
                of = np.searchsorted(woff, hits, "right") - 1
                spans = [[] for _ in range(part.num_rows)]
                for k in np.unique(of).tolist():
                    mine = hits[of == k]
                    base = offs[k]
                    spans[k] = _offsets(part.column("text")[k].as_py().encode(), [(int(st[i] - base), int(en[i] - base)) for i in mine])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500)))), pa.array(np.bincount(of, minlength=part.num_rows), pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    names=["doc_id", "score", "n_toxic_tokens", "spans"],
                )

    return texts_of(docs, id_col, text_col).mapInArrow(run, _OUT)
