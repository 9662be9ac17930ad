"""SimHash near-duplicate groups by anchor-point covering.

Anchors are the words of a covering code over the 64 bits: the bits are split into blocks,
each block coded by repetition (all zeros or all ones), so every fingerprint lies within
the code's covering radius of its home anchor, the blockwise majority. A fingerprint is
replicated to its home and to every further anchor that is home to some point within the
link threshold; two fingerprints that link therefore meet at the home of either. Only home
members are compared with the members of an anchor, and an anchor returns a spanning
forest of its links, never all pairs. Equal fingerprints are one node throughout.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fan_out, mixed, slices, staged, texts_of
from .components import components

BITS = 64
_PRINTS = "doc_id long, fingerprint long"


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint``: bit i is set if it is in over half the shingles' XXH64.

    ASCII letters are lowered; fewer words than a shingle are one shingle; no word gives 0.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, counts = [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    words = text.lower().split()
                    if len(words) < shingle:
                        found = [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
                    else:
                        line = b" ".join(words)
                        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                        starts = np.concatenate([[0], ends[:-1] + 1])
                        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
                        found = [xxhash.xxh64_intdigest(line[a:b], 42) for a, b in spans]
                    hashes += found
                    counts.append(len(found))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fingerprint": pa.array(majorities(np.array(hashes, np.uint64), np.array(counts)).view(np.int64))})

    return texts_of(docs, id_col, text_col).mapInArrow(run, _PRINTS)


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bitwise strict majority of each run of ``counts`` hashes; 0 for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    at = np.concatenate([[0], np.cumsum(counts[full])])
    size = 1 << 15
    sums = np.zeros((len(full), BITS), np.int64)
    for lo in range(0, len(hashes), size):  # bounded arrays, also for one very long text
        hi = min(lo + size, len(hashes))
        bits = np.unpackbits(hashes[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        a, b = np.searchsorted(at, lo, "right") - 1, np.searchsorted(at, hi, "left")
        cuts = np.clip(at[a:b], lo, hi) - lo
        sums[a:b] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    over = 2 * sums > counts[full][:, None]
    out[full] = (over.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return out


class CoveringCode:
    """Blocks of repetition codes: home anchors, and the anchors within the threshold."""

    def __init__(self, blocks: int, threshold: int):
        cuts = np.linspace(0, BITS, blocks + 1).round().astype(int)
        self.masks = np.array([((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(cuts[:-1], cuts[1:])], np.uint64)
        self.half = np.diff(cuts) // 2
        self.values = np.uint64(1) << np.arange(blocks, dtype=np.uint64)
        self.blocks, self.threshold = blocks, threshold

    def deal(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, anchors and whether it is the home, for each copy of each point."""
        ones = np.bitwise_count(points[:, None] & self.masks).astype(np.int64)
        major = ones > self.half
        cost = np.where(major, ones - self.half, self.half + 1 - ones)  # flips that change a block's majority
        home = (major * self.values).sum(1, dtype=np.uint64)
        row, anchor = np.arange(len(points)), home
        left, last = np.full(len(points), self.threshold), np.full(len(points), -1)
        rows, anchors = [row], [anchor]
        for _ in range(self.threshold):
            can = (cost[row] <= left[:, None]) & (np.arange(self.blocks) > last[:, None])
            k, j = np.nonzero(can)
            row, anchor, left, last = row[k], anchor[k] ^ self.values[j], left[k] - cost[row[k], j], j
            rows.append(row)
            anchors.append(anchor)
        rows, anchors = np.concatenate(rows), np.concatenate(anchors)
        return rows, anchors, np.arange(len(rows)) < len(points)


def _near(home: np.ndarray, all_: np.ndarray, threshold: int):
    """Index pairs (into ``home``, into the sorted ``all_``) that differ in few enough bits."""
    probes = sum(math.comb(BITS, k) for k in range(1, threshold + 1))
    if len(all_) > 16 * probes:  # look up the neighbours rather than compare with each
        flips = np.array([sum(1 << b for b in c) for k in range(1, threshold + 1) for c in combinations(range(BITS), k)], np.uint64)
        for lo in range(0, len(home), 256):
            want = home[lo : lo + 256, None] ^ flips
            at = np.minimum(np.searchsorted(all_, want), len(all_) - 1)
            i, k = np.nonzero(all_[at] == want)
            yield i + lo, at[i, k]
        return
    step = max(1, (1 << 20) // max(1, len(all_)))
    for lo in range(0, len(home), step):
        i, j = np.nonzero(np.bitwise_count(home[lo : lo + step, None] ^ all_) <= threshold)
        yield i + lo, j


def _forest(home: np.ndarray, all_: np.ndarray, threshold: int) -> np.ndarray:
    """For each of the sorted ``all_``, the index of the least that the links lead it to."""
    label = np.arange(len(all_))
    mine = np.searchsorted(all_, home)
    for i, j in _near(home, all_, threshold):
        a, b = mine[i], j
        while True:
            la, lb = label[a], label[b]
            on = la != lb
            if not on.any():
                break
            a, b, la, lb = a[on], b[on], la[on], lb[on]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (label[label] != label).any():
                label = label[label]
    return label


def _links(threshold: int):
    def run(rows: pa.Table) -> pa.Table:
        data = np.frombuffer(b"".join(rows.column("sent").to_pylist()), np.uint64).reshape(-1, 3)
        data = data[np.lexsort((data[:, 1], data[:, 0]))]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(data[:, 0])) + 1, [len(data)]])
        us, vs = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            group = data[a:b]
            home = group[group[:, 2] == 1, 1]
            if not len(home) or b - a < 2:
                continue
            label = _forest(home, group[:, 1], threshold)
            moved = np.flatnonzero(label != np.arange(b - a))
            us.append(group[moved, 1])
            vs.append(group[label[moved], 1])
        empty = np.zeros(0, np.uint64)
        return pa.table({"u": pa.array(np.concatenate(us or [empty]).view(np.int64)), "v": pa.array(np.concatenate(vs or [empty]).view(np.int64))})

    return run


def fingerprint_links(prints: DataFrame, threshold: int, blocks: int) -> DataFrame:
    """``u, v``: links between distinct ``fingerprint`` values, a spanning forest an anchor."""
    buckets = fan_out(prints.sparkSession)

    def deal(batches):
        code = CoveringCode(blocks, threshold)
        for batch in batches:
            points = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(points), 4096):
                some = points[lo : lo + 4096]
                rows, anchors, home = code.deal(some)
                bucket = (mixed(anchors + np.uint64(7)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                sent = np.stack([anchors, some[rows], home.astype(np.uint64)], 1)[order]
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "sent": pa.array([sent[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary())})

    return prints.mapInArrow(deal, "bucket int, sent binary").groupBy("bucket").applyInArrow(_links(threshold), "u long, v long")


def simhash_groups(docs: DataFrame, shingle: int = 3, threshold: int = 2, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint long, component_id``: the least doc_id reachable over links of
    at most ``threshold`` differing bits.

    A null or empty text has fingerprint 0 and links like any other. Every input row gives
    a row; rows with equal ids each count; null ids are never a component's least id (null
    if it has no other). An empty table gives no rows; other columns are ignored. More
    blocks mean smaller anchors but more copies: by default about log2 of the fingerprints.
    """
    prints = staged(fingerprints(docs, shingle, id_col, text_col), "simhash-prints")
    nodes = staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    k = blocks or min(24, max(6, round(math.log2(nodes.count() + 1)) - 2))
    roots = components(fingerprint_links(nodes.select("fingerprint"), threshold, k))
    rooted = staged(nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")), "simhash-roots")
    lows = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-lows")
    named = staged(rooted.join(lows, "root").select("fingerprint", "component_id"), "simhash-named")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")
