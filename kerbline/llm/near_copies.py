"""Near copies by Jaccard similarity, found through SimHash sub-prints at covering anchors.

At a similarity of 0.8 the 64-bit prints of two texts differ in ten bits in the mean and in
up to twenty; a covering code for that threshold would replicate each print to nearly all
of its anchors. So the prints are divided: a sub-print is the SimHash of a sample of the
shingles (the four least in one of twenty orders, so that similar texts often draw the same
sample), and goes to its home anchor in the covering code. The members of an anchor are
compared by prints of 512 bits and give spanning forests of their closest links, never all
pairs. A link counts only by the exact similarity of its two shingle sets.

Two texts at 0.8 draw at least one equal sample of twenty with a chance of 0.9999, and of
0.988 at the least: with four and five shingles, which is eight and nine words. What the
samples, the forests and the bound on bits pass over is found by an exact step: in any one
order of all shingles, two similar sets share one of their first n - ceil(0.8 n) + 1. Texts
of different groups that share such a shingle are compared as well, and groups joined. The
order puts shingles of common buckets last; it decides on the work only, never on the links.

Only those pairs go on to the texts whose parities allow the similarity: a set's
shingles are dealt into about as many classes, one bit says whether a class got an odd
number, and two sets differ in as many bits at most as in shingles. So no similar pair is
lost, and texts meet for few others. Equal texts are one node throughout.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, fan_out, gram_hashes, mixed, slices, staged_tidily, texts_of, word_hashes, word_spans
from .components import components
from .simhash_dedup import BITS, CoveringCode, majorities

SAMPLES, SAMPLE = 20, 4
PARTS = 8
#: Spanning forests that each anchor returns.
FORESTS = 6
#: Members of a part; anchors with more are compared part with part, each in a task of its own.
MOST = 2048
#: Rows that one task compares, about.
TOGETHER = 60_000
#: Buckets in which shingles are counted for their order: a table of fixed size.
COUNTED = 1 << 20

_FACTOR = 0x9E6C63D0876A9A47
_rng = np.random.default_rng(20250311)
_KEYS = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.uint64(2**64 - 1)


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles of each text, ascending, and the number of each row.

    ASCII letters are lowered; fewer words than a shingle are one shingle; no word gives none.
    """
    raw, offs = column_bytes(column)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    st, en, woff = word_spans(raw, offs)
    words, n = word_hashes(raw, st, en), np.diff(woff)
    counts = np.where(n < shingle, np.minimum(n, 1), n - shingle + 1)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(cuts[-1]) + np.repeat(woff[:-1] - cuts[:-1], counts)
    short = np.repeat(n < shingle, counts)
    out = np.zeros(len(at), np.uint64)
    out[~short] = gram_hashes(words, at[~short], shingle, _FACTOR)
    for k in np.unique(n[(n > 0) & (n < shingle)]).tolist():  # hashed with their length
        some = short & (np.repeat(n, counts) == k)
        out[some] = mixed(gram_hashes(words, at[some], k, _FACTOR) + np.uint64(k))
    row = np.repeat(np.arange(len(n)), counts)
    out = out[np.lexsort((out, row))]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[new], np.bincount(row[new], minlength=len(n))


def wide_prints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of ``PARTS`` SimHash words for each text, one of each part of the hashes' range."""
    part = np.repeat(np.arange(len(counts)) * PARTS, counts) + (hashes >> np.uint64(61)).astype(np.int64)
    return majorities(mixed(hashes), np.bincount(part, minlength=len(counts) * PARTS)).reshape(-1, PARTS)


def sub_prints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of ``SAMPLES`` sub-prints for each text with a shingle; zeros for one without."""
    out = np.zeros((len(counts), SAMPLES), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sizes = counts[full]
    starts, drawn = np.cumsum(sizes) - sizes, np.minimum(sizes, SAMPLE)
    for i in range(SAMPLES):
        order = (hashes ^ _KEYS[i]) * _ODD[i]
        least = np.empty((len(full), SAMPLE), np.uint64)
        for k in range(SAMPLE):
            least[:, k] = np.minimum.reduceat(order, starts)
            order[order == np.repeat(least[:, k], sizes)] = _NONE
        sample = least[np.arange(SAMPLE) < drawn[:, None]]
        out[full, i] = majorities(mixed(sample + np.uint64(i + 1)), drawn)
    return out


def common_levels(texts: DataFrame, shingle: int) -> np.ndarray:
    """For each of ``COUNTED`` buckets of shingles, how far it is above the mean: 0 for most."""
    piece = min(COUNTED, 1 << 14)

    def counted(batches):
        total = np.zeros(COUNTED, np.int64)
        for batch in batches:
            for part in slices(batch):
                hashes, _ = shingle_sets(part.column("text"), shingle)
                total += np.bincount((hashes % np.uint64(COUNTED)).astype(np.int64), minlength=COUNTED)
        cuts = range(0, COUNTED, piece)
        yield pa.RecordBatch.from_pydict({"at": pa.array(list(cuts), pa.int64()), "counts": pa.array([total[a : a + piece].tobytes() for a in cuts], pa.binary())})

    def added(rows: pa.Table) -> pa.Table:
        total = np.zeros(piece, np.int64)
        for counts in rows.column("counts"):
            total += np.frombuffer(counts.as_py(), np.int64)
        return pa.table({"at": rows.column("at").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    form = "at long, counts binary"
    found = sorted(staged_tidily(texts.mapInArrow(counted, form).groupBy("at").applyInArrow(added, form), "near-levels").collect())  # COUNTED numbers
    total = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in found)])
    if not len(total):
        return np.zeros(COUNTED, np.uint8)
    usual = total.mean() + 4 * math.sqrt(total.mean()) + 4
    return np.maximum(0, np.floor(np.log2(np.maximum(total, 1) / usual)) + 1).astype(np.uint8)


def first_shingles(hashes: np.ndarray, counts: np.ndarray, levels: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the shingles that come first, and how many: any set of at least that
    Jaccard similarity has one of them among its own. Rare ones come first, then by hash."""
    row = np.repeat(np.arange(len(counts)), counts)
    hashes = hashes[np.lexsort((hashes, levels[(hashes % np.uint64(COUNTED)).astype(np.int64)], row))]
    keep = np.where(counts > 0, counts - np.ceil(similarity * counts - 1e-9).astype(np.int64) + 1, 0)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    return hashes[place < np.repeat(keep, counts)], keep


def parities(hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """For each set a bit of every class of its hashes, set if the class has an odd number.

    The classes are a power of two, 64 at least and no fewer than hashes.
    """
    classes = np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64))
    ends = np.cumsum(classes)
    at = np.repeat(ends - classes, counts) + (hashes & np.repeat(classes - 1, counts).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(at, minlength=int(classes.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [bits[(b - n) // 8 : b // 8] for b, n in zip(ends.tolist(), classes.tolist())]


def _folded(bits: bytes, size: int) -> int:
    """A set's parities over fewer classes, of ``size`` bytes."""
    x, n = int.from_bytes(bits, "little"), len(bits)
    while n > size:
        n //= 2
        x = (x >> (8 * n)) ^ (x & ((1 << (8 * n)) - 1))
    return x


def least_difference(a: bytes, b: bytes) -> int:
    """Hashes that are in one of two sets only, at the least, by their parities."""
    size = min(len(a), len(b))
    return (_folded(a, size) ^ _folded(b, size)).bit_count()


def _printed(shingle: int, blocks: int):
    def run(batches):
        code = CoveringCode(blocks, 0)
        for batch in batches:
            for part in slices(batch):
                same = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in part.column("text").cast(pa.binary()).to_pylist()]
                hashes, counts = shingle_sets(part.column("text"), shingle)
                wide = wide_prints(hashes, counts).tobytes()
                _, homes, _ = code.deal(sub_prints(hashes, counts).ravel())
                homes = homes.view(np.int64).reshape(-1, SAMPLES)
                size = 8 * PARTS
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "same": pa.array(same, pa.binary()),
                    "wide": pa.array([wide[i : i + size] for i in range(0, len(wide), size)], pa.binary()),
                    "anchors": pa.array([a.tolist() if n else [] for a, n in zip(homes, counts)], pa.list_(pa.int64())),
                    "size": pa.array(counts, pa.int64()), "parity": pa.array(parities(hashes, counts), pa.binary()),
                })

    return run


def _firsts(shingle: int, levels: np.ndarray, similarity: float):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, counts = shingle_sets(part.column("text"), shingle)
                first, keep = first_shingles(hashes, counts, levels, similarity)
                ends = np.cumsum(keep)
                yield pa.RecordBatch.from_pydict({
                    "node": part.column("doc_id"),
                    "first": pa.array([first[b - n : b].tobytes() for b, n in zip(ends.tolist(), keep.tolist())], pa.binary()),
                })

    return run


#: What is dealt out of each first shingle, a column after the other. Half a shingle's bits are
#: enough within a bucket: the parities and the texts decide.
_SENT = (("token", np.uint32), ("node", np.int64), ("root", np.int64))


def _sharing(buckets: int):
    """Deals the first shingles of ``node, root, first`` out by shingle, as ``bucket, sent``."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                first = [np.frombuffer(x, np.uint64) for x in part.column("first").to_pylist()]
                count = [len(x) for x in first]
                token = mixed(np.concatenate(first))
                own = [np.repeat(part.column(c).to_numpy(zero_copy_only=False).astype(np.int64), count) for c in ("node", "root")]
                bucket = (token % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                sent = [x[order] for x in ((token >> np.uint64(32)).astype(np.uint32), *own)]
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "sent": pa.array([b"".join(x[cuts[b] : cuts[b + 1]].tobytes() for x in sent) for b in full], pa.binary())})

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """``node, anchor``: the nodes that have a first shingle in common, where their groups differ."""
    blobs, width = rows.column("sent").to_pylist(), sum(np.dtype(kind).itemsize for _, kind in _SENT)
    cols, at = [], [0] * len(blobs)
    for _, kind in _SENT:
        n = [len(x) // width for x in blobs]
        cols.append(np.concatenate([np.frombuffer(x, kind, k, a) for x, k, a in zip(blobs, n, at)]))
        at = [a + k * np.dtype(kind).itemsize for k, a in zip(n, at)]
    order = np.lexsort((cols[1], cols[0]))
    token, node, root = (x[order] for x in cols)
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    mixed_up = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
    some = np.repeat(mixed_up, np.diff([*starts, len(token)]))  # shingles of a single group link nothing new
    anchor = (np.int64(rows.column("bucket")[0].as_py()) << 32) + token[some].astype(np.int64)
    return pa.table({"node": pa.array(node[some]), "anchor": pa.array(anchor)})


def possible_links(root: np.ndarray, size: np.ndarray, parity: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of different groups that sizes and parities allow."""
    most = (1 - similarity) / (1 + similarity)
    wide = np.array([len(x) for x in parity])
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(wide).tolist():
        mine = np.flatnonzero(wide == n)
        others = np.flatnonzero((wide >= n) & (wide * similarity < 2.5 * n))  # the sizes of others rule them out
        bits = np.frombuffer(b"".join(_folded(parity[i], n).to_bytes(n, "little") for i in others.tolist()), np.uint64).reshape(len(others), -1)
        place = np.searchsorted(others, mine)
        step = max(1, (1 << 20) // bits.size)
        for lo in range(0, len(mine), step):
            i = mine[lo : lo + step, None]
            differ = np.bitwise_count(bits[place[lo : lo + step], None] ^ bits).sum(2, dtype=np.int64)
            on = (differ <= most * (size[i] + size[others]) + 1e-6) & (root[i] != root[others]) & ((wide[others] > n) | (i < others))
            on &= np.minimum(size[i], size[others]) + 1e-9 >= similarity * np.maximum(size[i], size[others])
            a, b = np.nonzero(on)
            us.append(mine[lo + a])
            vs.append(others[b])
    return np.concatenate(us), np.concatenate(vs)


def _apart(similarity: float):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("anchor", "ascending"), ("part", "ascending"), ("node", "ascending")]).combine_chunks()
        anchor, part, node, root, size = (rows.column(c).to_numpy() for c in ("anchor", "part", "node", "root", "size"))
        parity = rows.column("parity").to_pylist()
        new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(part) != 0)) + 1
        pairs = set()
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(node)]):
            i, j = possible_links(root[a:b], size[a:b], parity[a:b], similarity)
            x, y = node[a:b][i], node[a:b][j]
            pairs.update(zip(np.maximum(x, y).tolist(), np.minimum(x, y).tolist()))
        return pa.table({"u": pa.array([x for x, _ in pairs], pa.int64()), "v": pa.array([y for _, y in pairs], pa.int64())})

    return run


def _passed_over(grouped: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``u, v``: all pairs of ``node, root`` of different groups that share a first shingle and
    can be similar. Shingles gather nodes, never pairs."""
    buckets = fan_out(texts.sparkSession)
    firsts = texts.mapInArrow(_firsts(shingle, common_levels(texts, shingle), similarity), "node long, first binary")
    dealt = firsts.where("length(first) > 0").join(grouped.select("node", "root").hint("merge"), "node").select("node", "root", "first").mapInArrow(_sharing(buckets), "bucket int, sent binary")
    shared = staged_tidily(dealt.groupBy("bucket").applyInArrow(_shared, "node long, anchor long"), "near-shared")
    held = _held(shared, nodes.select("node", "size", "parity").join(grouped.select("node", "root").hint("merge"), "node"))
    return staged_tidily(held.groupBy("task").applyInArrow(_apart(similarity), "u long, v long").distinct(), "near-passed-over")


def most_bits(similarity: float) -> int:
    """Differing bits of wide prints that texts of that similarity stay within, by 3.5 deviations."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    n = BITS * PARTS
    return math.ceil(n * p + 3.5 * math.sqrt(n * p * (1 - p)))


def closest_links(wide: np.ndarray, limit: int) -> tuple[list[int], list[int]]:
    """Index pairs of at most ``limit`` differing bits: ``FORESTS`` spanning forests in
    succession, each of the closest links that the ones before haven't taken.

    Bits only estimate the similarity, so where a forest's link between two clusters turns
    out too weak, the next forest has the next closest one between them.
    """
    n, far = len(wide), BITS * PARTS + 1
    bits = np.empty((n, n), np.int16)
    step = max(1, (1 << 17) // n)
    for lo in range(0, n, step):
        bits[lo : lo + step] = np.bitwise_count(wide[lo : lo + step, None] ^ wide).sum(2, dtype=np.int16)
    us: list[int] = []
    vs: list[int] = []
    for _ in range(FORESTS):
        best, via, at, had = np.full(n, far, np.int16), np.zeros(n, np.int64), 0, len(us)
        for _ in range(n - 1):
            best[at] = -1  # within the tree; the largest of all when read without a sign
            closer = bits[at] < best
            np.copyto(best, bits[at], where=closer)
            via[closer] = at
            at = int(best.view(np.uint16).argmin())
            if best[at] <= limit:
                us.append(at)
                vs.append(int(via[at]))
        if len(us) == had:
            break
        bits[us[had:], vs[had:]] = bits[vs[had:], us[had:]] = far
    return us, vs


def _compared(limit: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("anchor", "ascending"), ("part", "ascending"), ("node", "ascending")]).combine_chunks()
        anchor, part, node = (rows.column(c).to_numpy() for c in ("anchor", "part", "node"))
        wide = np.frombuffer(b"".join(rows.column("wide").to_pylist()), np.uint64).reshape(-1, PARTS)
        new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(part) != 0)) + 1
        starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(node)]])
        two = starts[ends - starts == 2]  # most anchors have but two members
        two = two[np.bitwise_count(wide[two] ^ wide[two + 1]).sum(1) <= limit]
        us, vs = [node[two + 1]], [node[two]]
        for a, b in zip(starts, ends):
            if b - a > 2:
                i, j = closest_links(wide[a:b], limit)
                us.append(node[a:b][i])
                vs.append(node[a:b][j])
        u, v = np.concatenate(us), np.concatenate(vs)
        return pa.table({"u": pa.array(np.maximum(u, v)), "v": pa.array(np.minimum(u, v))})

    return run


def _held(dealt: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, anchor`` with what ``nodes`` has of each node, the members of an anchor (or of two
    parts of a large one) under one number ``task``; anchors with one member are left out."""
    # counted first and joined then, so that adaptive execution can split a hot anchor
    sizes = staged_tidily(dealt.groupBy("anchor").agg(F.count("*").alias("members")).where("members > 1"), "near-sizes")
    parts = F.ceil(F.col("members") / F.lit(MOST)).cast("int")
    mine = F.pmod(F.xxhash64("node"), "parts").cast("int")
    met = dealt.join(sizes.hint("merge"), "anchor").select("node", "anchor", parts.alias("parts")).withColumn("mine", mine)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = staged_tidily(met.select("node", "anchor", (F.least("mine", "other").cast("long") * F.col("parts") + F.greatest("mine", "other")).alias("part")), "near-met")
    tasks = max(fan_out(nodes.sparkSession, 1), math.ceil(met.count() / TOGETHER))
    return met.join(nodes.hint("merge"), "node").withColumn("task", F.pmod(F.xxhash64("anchor", "part"), F.lit(tasks)).cast("int"))


def _candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """``u, v``: the closest links of each anchor, from ``node, wide, anchors``."""
    held = _held(nodes.select("node", F.explode("anchors").alias("anchor")), nodes.select("node", "wide"))
    found = held.groupBy("task").applyInArrow(_compared(most_bits(similarity)), "u long, v long")
    return staged_tidily(found.distinct(), "near-candidates")


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two ascending sets of hashes have that Jaccard similarity; empty ones are equal."""
    if min(len(x), len(y)) + 1e-9 < similarity * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both + 1e-9 >= similarity * (len(x) + len(y) - both)


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``u, v`` that the parities of ``nodes`` don't rule out."""
    left, right = (nodes.select(F.col("node").alias(k), F.col("size").alias(f"{k}_size"), F.col("parity").alias(f"{k}_parity")) for k in ("u", "v"))
    most = (1 - similarity) / (1 + similarity)

    def run(batches):
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("u_size", "v_size", "u_parity", "v_parity"))
            mask = [least_difference(a, b) <= most * (m + n) + 1e-6 for m, n, a, b in zip(*cols)]
            yield batch.select(["u", "v"]).filter(pa.array(mask, pa.bool_()))

    met = pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v")
    return staged_tidily(met.select("u", "v", "u_size", "v_size", "u_parity", "v_parity").mapInArrow(run, "u long, v long"), "near-possible")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs ``u, v`` whose texts are similar."""

    def sets(nodes: np.ndarray, column: pa.Array) -> dict[int, np.ndarray]:
        _, first = np.unique(nodes, return_index=True)
        found, at = {}, 0
        for part in slices(pa.RecordBatch.from_arrays([column.take(pa.array(first))], names=["text"])):
            hashes, counts = shingle_sets(part.column("text"), shingle)
            for b, n in zip(np.cumsum(counts).tolist(), counts.tolist()):
                found[int(nodes[first[at]])] = hashes[b - n : b]
                at += 1
        return found

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                u, v = (part.column(c).to_numpy() for c in ("u", "v"))
                of_u, of_v = sets(u, part.column("u_text")), sets(v, part.column("v_text"))
                mask = [similar(of_u[a], of_v[b], similarity) for a, b in zip(u.tolist(), v.tolist())]
                yield part.select(["u", "v"]).filter(pa.array(mask, pa.bool_()))

    texts = texts.hint("merge")  # one shuffle, read by both joins
    met = pairs.join(texts, F.col("u") == F.col("doc_id")).select("u", "v", F.col("text").alias("u_text"))
    met = met.join(texts, F.col("v") == F.col("doc_id")).select("u", "v", "u_text", F.col("text").alias("v_text"))
    return staged_tidily(met.mapInArrow(run, "u long, v long"), "near-links")


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, blocks: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id``: the least id reachable over pairs of texts whose sets of
    ``shingle`` words have a Jaccard similarity of at least ``similarity``.

    Ids must be unique and not null. Texts without a word are equal; an empty table gives
    no rows; other columns are ignored. ``blocks`` is the covering code's: its anchors.
    """
    texts = texts_of(docs, id_col, text_col)
    prints = staged_tidily(texts.mapInArrow(_printed(shingle, blocks), "doc_id long, same binary, wide binary, anchors array<long>, size long, parity binary"), "near-prints")
    one = [F.first(c).alias(c) for c in ("wide", "anchors", "size", "parity")]
    nodes = staged_tidily(prints.groupBy("same").agg(F.min("doc_id").alias("node"), *one), "near-nodes")
    roots = components(_verified(_possible(_candidates(nodes, similarity), nodes, similarity), texts, shingle, similarity), staged_tidily)
    grouped = staged_tidily(nodes.join(roots.hint("merge"), "node", "left").select("node", "same", F.coalesce("root", "node").alias("root")), "near-grouped")
    more = _verified(_passed_over(grouped, nodes, texts, shingle, similarity), texts, shingle, similarity)
    own = grouped.select("node", "root")
    for end in ("u", "v"):  # groups as nodes
        more = more.join(own.withColumnRenamed("node", end).hint("merge"), end).drop(end).withColumnRenamed("root", f"{end}_root")
    last = components(more.select(F.col("u_root").alias("u"), F.col("v_root").alias("v")), staged_tidily).select(F.col("node").alias("root"), F.col("root").alias("last"))
    named = staged_tidily(grouped.join(last.hint("merge"), "root", "left").select("same", F.coalesce("last", "root").alias("component_id")), "near-named")
    return prints.select("doc_id", "same").join(named.hint("merge"), "same").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each near-duplicate group: that of the least id, nulls last.

    Rows count each by itself, also those with equal or null ids.
    """
    rows = staged_tidily(docs.withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    groups = near_groups(rows, shingle, similarity, id_col="_row", text_col=text_col)
    return least_of_each(rows, groups.select(F.col("doc_id").alias("_row"), "component_id"), id_col).select(*docs.columns)


def least_of_each(rows: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """The ``rows``, numbered by ``_row``, but those that aren't the least id of their group.

    The least is an aggregate, so a hot group meets in no single task.
    """
    keyed = staged_tidily(rows.select("_row", F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).cast("long").alias("id"), "_row").alias("rank")).join(groups.hint("merge"), "_row"), "near-ranked")
    keep = keyed.groupBy("component_id").agg(F.min("rank")["_row"].alias("_row"))
    drop = staged_tidily(keyed.select("_row").join(keep.select("_row").hint("merge"), "_row", "left_anti"), "near-dropped")
    # sorted and merged at every size: the rows to drop grow with the input, so they aren't sent around
    return rows.join(drop.hint("merge"), "_row", "left_anti")
