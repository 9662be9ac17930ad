"""Nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. The index holds blocks of vectors,
each with inverted files: for every pivot the rows that list it, with its place in their
order. A query adds up, over the files of its own pivots, how far its footrule distance to
each row falls below that of two lists without a common pivot; the rows with the least
distance are reranked by their cosine in double precision. Every block gives its nearest
rows for every query, so blocks and query groups are independent tasks of bounded size.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir

BLOCK_ROWS = 8192
QUERY_ROWS = 512
_FOUND = "query_id long, rank int, vec_id long, score double"
_BLOCK = "block long, ids binary, vectors binary, rows binary, places binary, cuts binary"
_GROUP = "query_ids binary, turns binary, queries binary"


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Double-precision vectors as rows, of a list column whose rows are all as long."""
    if not len(column):
        return np.zeros((0, 0)), np.zeros((0, 0))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        scale = np.abs(x).max(1, keepdims=True)
        unit = x / scale
        return x, unit / np.sqrt((unit * unit).sum(1, keepdims=True))


def _complete(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` (doubles) of rows with an id whose vector is finite and not zero."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0.0)
    return rows.where("vec_id IS NOT NULL AND vector IS NOT NULL").where(fine)


def pivots_of(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    """At most ``n`` pivots: the vectors whose ids have the least hashes, as unit rows."""
    got = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id", "vector").limit(n).select("vector").collect()
    return _vectors(pa.array([r["vector"] for r in got], pa.list_(pa.float64())))[1]


def orders(unit: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    """The numbers of each row's nearest pivots, nearest first, ties to the lower number."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :listed].astype(np.int32)


def _blocks(pivots: np.ndarray, listed: int):
    def block(number: int, ids: list, vectors: list) -> pa.RecordBatch:
        ids, x = np.concatenate(ids), np.concatenate(vectors)
        _, unit = _vectors(pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]))
        order = orders(unit, pivots, listed)
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        rows, places = (by // order.shape[1]).astype(np.int32), (by % order.shape[1]).astype(np.int32)
        cuts = np.searchsorted(flat[by], np.arange(len(pivots) + 1)).astype(np.int64)
        cols = [[number], [ids.tobytes()], [x.tobytes()], [rows.tobytes()], [places.tobytes()], [cuts.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["block", "ids", "vectors", "rows", "places", "cuts"])

    def run(batches):
        task, n, ids, vectors = TaskContext.get().partitionId() << 32, 0, [], []
        for b in batches:
            for k in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(k, BLOCK_ROWS)
                ids.append(part.column("vec_id").to_numpy(zero_copy_only=False))
                vectors.append(_vectors(part.column("vector"))[0])
                if sum(map(len, ids)) >= BLOCK_ROWS:
                    yield block(task + n, ids, vectors)
                    n, ids, vectors = n + 1, [], []
        if ids:
            yield block(task + n, ids, vectors)

    return run


def _groups(batches):
    """Queries in groups of bounded size."""
    for b in batches:
        for k in range(0, b.num_rows, QUERY_ROWS):
            part = b.slice(k, QUERY_ROWS)
            x = _vectors(part.column("vector"))[0]
            yield pa.RecordBatch.from_pydict({"query_ids": [part.column("vec_id").to_numpy(zero_copy_only=False).tobytes()], "turns": [part.column("turn").to_numpy(zero_copy_only=False).tobytes()], "queries": [x.tobytes()]})


def staged(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str, schema: str) -> DataFrame:
    """What ``make`` gives for the batches of ``rows``, as Parquet files that the workers write to
    the shared folder, a row group a batch. Its rows of megabytes don't pass through the JVM,
    which gets the name of a file from each task; a file of a failed task isn't named."""
    spark, base = rows.sparkSession, shared_dir(rows.sparkSession)
    uri = base if "://" in base else "file://" + base.removeprefix("file:")
    folder = f"{uri}/{name}-{uuid.uuid4().hex}"
    fs, where = pafs.FileSystem.from_uri(folder)
    fs.create_dir(where)

    def write(batches):
        made = make(batches)
        first = next(made, None)
        if first is None:
            return
        file = f"{folder}/{uuid.uuid4().hex}.parquet"
        fs, where = pafs.FileSystem.from_uri(file)
        with fs.open_output_stream(where) as out, pq.ParquetWriter(out, first.schema, compression="zstd", use_dictionary=False, write_statistics=False) as to:
            for batch in chain([first], made):
                to.write_table(pa.Table.from_batches([batch]))
        yield pa.RecordBatch.from_pydict({"file": [file]})

    files = [r["file"] for r in rows.mapInArrow(write, "file string").collect()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _opened(uri: str) -> pq.ParquetFile:
    fs, where = pafs.FileSystem.from_uri(uri)
    return pq.ParquetFile(fs.open_input_file(where))


def _row_groups(batches):
    """``file, row_group``: the parts of some Parquet files."""
    for batch in batches:
        for file in batch.column("file").to_pylist():
            n = _opened(file).num_row_groups
            yield pa.RecordBatch.from_pydict({"file": pa.array([file] * n, pa.string()), "row_group": pa.array(range(n), pa.int32())})


def _rows(uri: str, row_groups: Iterable[int] | None = None) -> Iterator[dict]:
    """Rows of a file in the shared folder, one row group held at a time."""
    file = _opened(uri)
    for k in range(file.num_row_groups) if row_groups is None else row_groups:
        yield from file.read_row_group(k).to_pylist()


class _Block:
    """A block of the index; ``places`` has for each pivot the place of each row's, ``n_listed``
    where the row doesn't list it."""

    def __init__(self, r: dict, pivots: int):
        self.ids = np.frombuffer(r["ids"], np.int64)
        self.x = np.frombuffer(r["vectors"]).reshape(len(self.ids), -1)
        self.norms = np.sqrt((self.x * self.x).sum(1))
        rows, cuts = np.frombuffer(r["rows"], np.int32), np.frombuffer(r["cuts"], np.int64)
        self.n_listed = len(rows) // len(self.ids)
        self.places = np.full((pivots, len(self.ids)), self.n_listed, np.uint16 if self.n_listed**2 < 1 << 16 else np.int64)
        self.places[np.repeat(np.arange(pivots), np.diff(cuts)), rows] = np.frombuffer(r["places"], np.int32)

    def nearer(self, order: np.ndarray) -> np.ndarray:
        """How far the footrule distance of each row to a query falls below that of lists
        without a common pivot, halved: for a common pivot what its later place leaves."""
        later = np.maximum(self.places[order], np.arange(len(order), dtype=self.places.dtype)[:, None])
        return len(order) * self.n_listed - later.sum(0, dtype=self.places.dtype).astype(np.int64)

    def search(self, order: np.ndarray, query: np.ndarray, query_id: int, k: int, take: int) -> tuple[np.ndarray, np.ndarray]:
        ids, found = self.ids, np.arange(len(self.ids))
        if take < len(ids):
            nearer = self.nearer(order)
            edge = -np.partition(-nearer, take - 1)[take - 1]
            sure, tied = np.flatnonzero(nearer > edge), np.flatnonzero(nearer == edge)
            tied = tied[np.argsort(ids[tied], kind="stable")][: take - len(sure)]
            found = np.concatenate([sure, tied])
        found = found[ids[found] != query_id]
        score = (self.x[found] * query).sum(1) / (self.norms[found] * np.sqrt((query * query).sum()))
        best = np.lexsort((ids[found], -score))[:k]
        return ids[found[best]], score[best]


def _search(queries: list[str], pivots: np.ndarray, listed: int, k: int, share: float, least: int):
    """Every query against the blocks of some row groups. Blocks and queries are read from the
    shared folder by the worker, so rows of megabytes don't pass through the JVM."""

    def of(block: _Block, r: dict) -> pa.RecordBatch:
        qids, turns = np.frombuffer(r["query_ids"], np.int64), np.frombuffer(r["turns"], np.int64)
        q = np.frombuffer(r["queries"]).reshape(len(qids), -1)
        _, unit = _vectors(pa.FixedSizeListArray.from_arrays(pa.array(q.ravel()), q.shape[1]))
        take = max(least, math.ceil(share * len(block.ids)))
        got = [block.search(*a, k, take) for a in zip(orders(unit, pivots, listed), q, qids)]
        row = np.repeat(np.arange(len(got)), [len(v) for v, _ in got])
        ids, scores = (np.concatenate([g[c] for g in got]) for c in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (qids[row], turns[row], ids, scores)], names=["query_id", "turn", "vec_id", "score"])

    def run(batches):
        for batch in batches:
            for place in batch.to_pylist():
                for r in _rows(place["file"], [place["row_group"]]):
                    block = _Block(r, len(pivots))
                    for file in queries:
                        for group in _rows(file):
                            yield of(block, group)

    return run


def nearest(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 5,
    pivots: int = 256,
    listed: int = 64,
    share: float = 0.08,
    least: int = 256,
    seed: int = 3,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, by cosine.

    ``queries`` (default: all vectors) has the same columns. Pivots are a sample of at most
    ``pivots`` rows; every row is indexed. Each block reranks its nearest ``share`` of rows,
    ``least`` at least. Vectors of each length are searched among their own, an index a
    length. Rows with a null id, or a vector that is null, empty, zero or holds null or
    non-finite components, take no part.
    A query isn't its own neighbour: rows with its id are left out. Of rows that share an
    id each may be found; equal scores go to the smaller id. Repeated query rows are asked
    once; query rows that share an id but not the vector each get a list of their own.
    Empty tables give no rows.
    """
    rows = _complete(vectors, id_col, vector_col)
    asked = rows if queries is None else _complete(queries, id_col, vector_col)
    size = F.size("vector")
    lengths = sorted(r[0] for r in rows.groupBy(size).count().collect())  # a number for each length in use
    parts = [_nearest(rows.where(size == n), asked.where(size == n), k, pivots, listed, share, least, seed) for n in lengths]
    return reduce(DataFrame.union, parts) if parts else rows.sparkSession.createDataFrame([], _FOUND)


def _nearest(rows: DataFrame, asked: DataFrame, k: int, pivots: int, listed: int, share: float, least: int, seed: int) -> DataFrame:
    """The search among vectors of one length."""
    points = pivots_of(rows, pivots, seed)
    index = staged(rows, _blocks(points, listed), "permutation-index", _BLOCK)
    # each group of queries meets each block: a stated query set against all rows, in blocks
    once = asked.dropDuplicates(["vec_id", "vector"]).withColumn("turn", F.xxhash64("vector")).sortWithinPartitions("vec_id", "vector")
    groups = staged(once, _groups, "permutation-queries", _GROUP)
    spark = rows.sparkSession
    files = spark.createDataFrame([(f,) for f in index.inputFiles()], "file string")
    parts = files.mapInArrow(_row_groups, "file string, row_group int").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = parts.mapInArrow(_search(list(groups.inputFiles()), points, listed, k, share, least), "query_id long, turn long, vec_id long, score double")
    w = Window.partitionBy("query_id", "turn").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
