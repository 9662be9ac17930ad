"""A content-addressed store of token-id streams.

Format (a folder of Parquet tables, so that any Spark file system holds it):

* ``chunks``   packs of chunks: bucket, digests (32 bytes each: SHA-256 of the ids as
  little-endian 32-bit values), lengths (32-bit), data (Zstandard of all their ids, unsigned
  16-bit little-endian where the vocabulary allows, else 32-bit). Each digest once.
* ``recipes``  part, row, doc_id, n_tokens, digests, lengths; sorted by doc_id within a
  part, and parts by range: reading parts in order gives ascending doc_ids.
* ``manifest`` part, rows, tokens, root (Merkle root over the recipes of the part).
* ``head``     one row: id_bytes (2 or 4), parts, root (Merkle root over the manifest).

A reader computes the roots of all parts anew from the recipes that it reads, and the head's
from the manifest, so recipes that were lost, added, moved or changed don't go unseen.

An id stream is cut where a rolling hash of the last ids has its low bits zero, so equal
passages give equal chunks wherever they stand. Reading back joins recipes to chunks by
digest. The CRC of a document follows from its chunks' CRCs by linearity, so chunk bytes
never move again, and a chunk that a third of all documents hold costs no more than a row.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fan_out, mixed, shared_dir, slices, staged, texts_of
from .token_ids import encoded_column, largest_id

ROLL = 16
#: Ids that a task gathers before it deals them out, and ids of one stored pack.
GATHER_IDS, PACK_IDS = 8 << 20, 1 << 20
#: Text encoded at once: the more, the fewer times a word is looked up.
ENCODE_BYTES = 4 << 20
_PACK = "bucket int, chunk_digests binary, chunk_lengths binary, data binary"
_CUT = f"doc_id long, n_tokens long, digests array<binary>, lengths array<int>, {_PACK}"
_PACK_ARROW = pa.schema([("bucket", pa.int32()), ("chunk_digests", pa.binary()), ("chunk_lengths", pa.binary()), ("data", pa.binary())])
_CUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), *_PACK_ARROW])
_RECIPE = "part int, row long, doc_id long, n_tokens long, digests array<binary>, lengths array<int>"


def cut_points(ids: np.ndarray, offs: np.ndarray, bits: int, longest: int) -> np.ndarray:
    """Where chunks start, the end included: every row's start, and after each window of
    ``ROLL`` ids of a row whose hash has ``bits`` low zero bits; none is over ``longest``."""
    codes = mixed(ids.astype(np.uint64) + np.uint64(1))
    cuts = [offs]
    if len(ids) > ROLL:
        h, factor, width = codes, 0x9E3779B97F4A7C15, 1
        while width < ROLL:  # a power of two: windows of twice the width from two beside each other
            h = h[:-width] * np.uint64(factor) + h[width:]
            factor, width = factor * factor % 2**64, 2 * width
        ends = np.flatnonzero(mixed(h) & np.uint64((1 << bits) - 1) == 0) + ROLL
        cuts.append(ends[ends - offs[np.searchsorted(offs, ends, "left") - 1] >= ROLL])
    cuts = np.unique(np.concatenate(cuts))
    wide = np.flatnonzero(np.diff(cuts) > longest)
    if len(wide):
        more = [np.arange(cuts[i] + longest, cuts[i + 1], longest) for i in wide]
        cuts = np.unique(np.concatenate([cuts, *more]))
    return cuts


def _crc_tables() -> list[np.ndarray]:
    """Matrices over GF(2), as 32 columns, that append 4 * 2**k zero bytes to a CRC-32."""
    one = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint32)  # one zero bit
    m = one
    for _ in range(5):  # 32 zero bits
        m = _apply(m, m)
    out = [m]
    for _ in range(39):
        out.append(_apply(out[-1], out[-1]))
    return out


def _apply(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.uint32)
    for i in range(32):
        out ^= np.where((values >> np.uint32(i)) & np.uint32(1), matrix[i], np.uint32(0)).astype(np.uint32)
    return out


def shifted_crc(crc: np.ndarray, words_after: np.ndarray) -> np.ndarray:
    """The part that a chunk adds to a stream's CRC when so many 32-bit ids follow it."""
    out = crc.astype(np.uint32)
    for k, matrix in enumerate(_crc_tables()):
        on = (words_after >> k) & 1 == 1
        if on.any():
            out[on] = _apply(matrix, out[on])
        if not (words_after >> (k + 1)).any():
            break
    return out


def merkle_root(leaves) -> bytes:
    """Root over leaves in order; an odd node moves up; memory grows with the log of rows."""
    stack: list[tuple[int, bytes]] = []
    for leaf in leaves:
        stack.append((0, leaf))
        while len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            (level, a), (_, b) = stack[-2:]
            stack[-2:] = [(level + 1, hashlib.sha256(b"\x01" + a + b).digest())]
    root = stack.pop()[1] if stack else hashlib.sha256(b"").digest()
    while stack:
        root = hashlib.sha256(b"\x01" + stack.pop()[1] + root).digest()
    return root


def recipe_leaf(doc_id: int | None, n_tokens: int, digests: list[bytes], lengths: list[int]) -> bytes:
    head = f"{doc_id}:{n_tokens}:{','.join(map(str, lengths))}:".encode()
    return hashlib.sha256(b"\x00" + head + b"".join(digests)).digest()


def _packed(chunks: list[tuple[bytes, bytes]], size: int) -> tuple[bytes, bytes, bytes]:
    data = zstandard.ZstdCompressor(3).compress(b"".join(x for _, x in chunks))
    return b"".join(d for d, _ in chunks), np.array([len(x) // size for _, x in chunks], "<u4").tobytes(), data


def _unpacked(row: dict, size: int):
    """(digest, ids) of the chunks of a pack, as they are stored."""
    data, digests = zstandard.ZstdDecompressor().decompress(row["data"]), row["chunk_digests"]
    at = 0
    for k, n in enumerate(np.frombuffer(row["chunk_lengths"], "<u4").tolist()):
        yield digests[32 * k : 32 * k + 32], data[at : at + size * n]
        at += size * n


def write_store(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, bits: int = 8, longest: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode whole texts and write them as a store at ``path``; returns ``path``.

    A null or empty text is the end id alone. Equal doc_ids are kept as separate documents,
    null ids come first. An empty table gives a store without rows. Ids take two bytes if
    those of the vocabulary and the end id fit, else four.
    """
    size = 2 if largest_id(tokenizer_path, end_id) < 1 << 16 else 4
    buckets = fan_out(docs.sparkSession)

    def coded(batch):
        """Slices of a batch, the ids of each and the offsets of its rows."""
        for together in slices(batch, ENCODE_BYTES):
            ids, offs = encoded_column(tokenizer_path, together.column("text"), end_id)
            row = 0
            for part in slices(together):
                at = offs[row : row + part.num_rows + 1]
                yield part, ids[at[0] : at[-1]], at - at[0]
                row += part.num_rows

    def cut(batches):
        """Rows of two kinds: recipes of documents, and packs of the task's distinct chunks."""
        fresh: dict[bytes, bytes] = {}
        held = 0

        def packs():
            dealt: dict[int, list] = {}
            for digest, data in fresh.items():
                dealt.setdefault(int.from_bytes(digest[:4], "little") % buckets, []).append((digest, data))
            cols = [pa.array(c, f.type) for c, f in zip(zip(*[(k, *_packed(v, size)) for k, v in sorted(dealt.items())]), _PACK_ARROW)]
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(dealt), f.type) for f in list(_CUT_ARROW)[:4]), *cols], schema=_CUT_ARROW)

        for batch in batches:
            for part, ids, offs in coded(batch):
                cuts = cut_points(ids, offs, bits, longest)
                raw, small = ids.tobytes(), ids.astype(f"<u{size}").tobytes()
                digests = []
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    digest = hashlib.sha256(raw[4 * a : 4 * b]).digest()
                    digests.append(digest)
                    if digest not in fresh:
                        fresh[digest] = small[size * a : size * b]
                        held += b - a
                at = pa.array(np.searchsorted(cuts, offs), pa.int32())
                n = part.num_rows
                rows = [part.column("doc_id"), pa.array(np.diff(offs), pa.int64()), pa.ListArray.from_arrays(at, pa.array(digests, pa.binary())), pa.ListArray.from_arrays(at, pa.array(np.diff(cuts), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*rows, *(pa.nulls(n, f.type) for f in _PACK_ARROW)], schema=_CUT_ARROW)
                if held >= GATHER_IDS:
                    yield packs()
                    fresh.clear()
                    held = 0
        if fresh:
            yield packs()

    def unique(rows: pa.Table) -> pa.Table:
        """A bucket's packs with each digest once, in packs of bounded size."""
        found: dict[bytes, bytes] = {}
        for r in rows.to_pylist():
            for digest, data in _unpacked(r, size):
                found.setdefault(digest, data)
        out, part, held = [], [], 0
        for item in sorted(found.items()):
            part.append(item)
            held += len(item[1]) // size
            if held >= PACK_IDS:
                out.append(part)
                part, held = [], 0
        out += [part] if part else []
        bucket = rows.column("bucket")[0].as_py()
        cols = zip(*[(bucket, *_packed(x, size)) for x in out])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PACK_ARROW)], schema=_PACK_ARROW)

    def numbered(batches):
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            cols = [pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(row, row + n), pa.int64()), *(b.column(c) for c in ("doc_id", "n_tokens", "digests", "lengths"))]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "row", "doc_id", "n_tokens", "digests", "lengths"])
            row += n

    cutted = staged(texts_of(docs, id_col, text_col).mapInArrow(cut, _CUT), "store-cut")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    recipes = cutted.where("bucket IS NULL").select("doc_id", "n_tokens", "digests", "lengths").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "digests")
    recipes.mapInArrow(numbered, _RECIPE).write.option("compression", "zstd").parquet(f"{path}/recipes")
    packs = cutted.where("bucket IS NOT NULL").select(*_PACK_ARROW.names)
    packs.groupBy("bucket").applyInArrow(unique, _PACK).write.parquet(f"{path}/chunks")
    _manifest(spark, path).write.parquet(f"{path}/manifest")
    _head(spark.read.parquet(f"{path}/manifest"), size).write.parquet(f"{path}/head")
    return path


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """Merkle root, rows and tokens of each part, from the recipes as they are on disk."""

    def leaves(batches):
        for b in batches:
            made = [recipe_leaf(*x) for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "digests", "lengths")))]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("row"), b.column("n_tokens"), pa.array(made, pa.binary())], names=["part", "row", "n_tokens", "leaf"])

    def rooted(batches):
        def rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("part", "n_tokens", "leaf")))

        for part, group in groupby(rows(), key=lambda x: x[0]):
            count = [0, 0]

            def counted(group=group, count=count):
                for _, n, leaf in group:
                    count[0] += 1
                    count[1] += n
                    yield leaf

            root = merkle_root(counted())
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "rows": [count[0]], "tokens": [count[1]], "root": pa.array([root], pa.binary())})

    # only leaves are shuffled, not the recipes
    made = spark.read.schema(_RECIPE).parquet(f"{path}/recipes").mapInArrow(leaves, "part int, row long, n_tokens long, leaf binary")
    ordered = made.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "row")
    return ordered.mapInArrow(rooted, "part int, rows long, tokens long, root binary")


def _head(manifest: DataFrame, size: int) -> DataFrame:
    """One row over a manifest, which has a row for each of the parts that were written."""
    parts = [(r["part"], r["rows"], r["tokens"], bytes(r["root"])) for r in manifest.orderBy("part").collect()]  # shuffle partitions at most
    root = merkle_root(hashlib.sha256(b"\x00" + f"{p}:{n}:{t}:".encode() + x).digest() for p, n, t, x in parts)
    return manifest.sparkSession.createDataFrame([(size, len(parts), root)], "id_bytes int, parts int, root binary")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, verified`` for every document of a store.

    All are derived from what is read. ``verified`` holds if the document's chunks are there
    with their digests and lengths, the recipes of its part give the rows, tokens and Merkle
    root of the manifest, and no part before it or after it lacks or differs in the manifest
    or the head: a start is only right if all before it are there. So a recipe that was
    changed, moved, added or removed leaves no document of the store verified, and a chunk
    that was changed or removed none that holds it.
    """
    head = spark.read.parquet(f"{path}/head").first()
    size, kind = head["id_bytes"], f"<u{head['id_bytes']}"

    def sums(batches):
        for b in batches:
            for row in b.to_pylist():
                digests, crcs, found, same = [], [], [], []
                for digest, data in _unpacked(row, size):
                    ids = np.frombuffer(data, kind).astype("<u4").tobytes()
                    digests.append(digest)
                    crcs.append(zlib.crc32(ids))
                    found.append(len(ids) // 4)
                    same.append(hashlib.sha256(ids).digest() == digest)
                yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "crc": pa.array(crcs, pa.int64()), "found": pa.array(found, pa.int64()), "same": pa.array(same, pa.bool_())})

    def entries(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                p = b.slice(k, 2000)
                lens = [np.array(x, np.int64) for x in p.column("lengths").to_pylist()]
                count = np.array([len(x) for x in lens])
                flat = np.concatenate(lens) if lens else np.zeros(0, np.int64)
                total = np.cumsum(flat)
                ends = np.repeat(total[np.cumsum(count) - 1], count) if len(flat) else flat
                over = lambda c, t: pa.array(np.repeat(np.array(p.column(c).to_pylist()), count), t)  # noqa: E731, B023
                yield pa.RecordBatch.from_pydict({"part": over("part", pa.int32()), "row": over("row", pa.int64()), "digest": p.column("digests").flatten(), "length": pa.array(flat, pa.int64()), "after": pa.array(ends - total, pa.int64())})

    def shift(batches):
        for b in batches:
            crc = shifted_crc(b.column("crc").to_numpy(zero_copy_only=False), b.column("after").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pydict({"part": b.column("part"), "row": b.column("row"), "crc": pa.array(crc, pa.int64()), "length": b.column("length"), "ok": b.column("ok")})

    recipes = spark.read.schema(_RECIPE).parquet(f"{path}/recipes")
    chunks = spark.read.schema(_PACK).parquet(f"{path}/chunks").mapInArrow(sums, "digest binary, crc long, found long, same boolean")
    parts = recipes.mapInArrow(entries, "part int, row long, digest binary, length long, after long")
    met = parts.join(chunks, "digest", "left").select("part", "row", F.coalesce("crc", F.lit(0)).alias("crc"), F.coalesce("found", F.lit(0)).alias("length"), "after", F.coalesce(F.col("same") & (F.col("found") == F.col("length")), F.lit(False)).alias("ok"))
    docs = met.mapInArrow(shift, "part int, row long, crc long, length long, ok boolean").groupBy("part", "row").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("length").alias("n_tokens"), F.bool_and("ok").alias("verified"))
    manifest = spark.read.parquet(f"{path}/manifest")
    whole = _same_parts(manifest, _manifest(spark, path)) and _head(manifest, size).first() == head
    before = manifest.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
    starts = recipes.select("part", "row", "doc_id", "n_tokens").join(F.broadcast(before), "part")
    run = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    return starts.select("part", "row", "doc_id", (F.col("before") + run).alias("start")).join(docs, ["part", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32", (F.col("verified") & F.lit(whole)).alias("verified"))


def _same_parts(manifest: DataFrame, found: DataFrame) -> bool:
    """Whether both have the same rows; each has one for each part."""
    kept, now = ({r["part"]: (r["rows"], r["tokens"], bytes(r["root"])) for r in x.collect()} for x in (manifest, found))
    return kept == now


def store_and_read(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write a store (by default to a new place in the shared folder) and read it back."""
    spark = docs.sparkSession
    where = path or f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    write_store(docs, tokenizer_path, where, **options)
    return read_store(spark, where)
