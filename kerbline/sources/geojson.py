"""GeoJSON as a data source: files are read in byte ranges, and written as one collection.

A place in the middle of a JSON text doesn't tell whether it lies within a string, or how
deep. So each range is first summed up for both cases: what it does to the depth, how low it
gets, where it names members. Folding these few numbers over the ranges of a file gives the
state at the beginning of each, and every task then splits its own range at the borders of
features; one that begins in a range is read to its end by the same task. Newline-delimited
features (``.geojsonl``, ``.geojsonseq``, ``.ndjson``, ``.jsonl``) are split at line ends.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE_BYTES = 16 << 20
#: The most that a member's name and the blanks after it take, and the value of ``crs``.
NAME_BYTES, CRS_BYTES = 256, 8192
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
LINE_ENDINGS = (".geojsonl", ".geojsonseq", ".ndjson", ".jsonl")
SCHEMA = "crs string, feature_idx long, feature string"
CRS_NAMES = {"CRS84": "urn:ogc:def:crs:OGC:1.3:CRS84", "4326": "urn:ogc:def:crs:EPSG::4326", "3857": "urn:ogc:def:crs:EPSG::3857"}
_MEMBER = re.compile(rb'(?<!\\)"(features|crs)"\s*:\s*')
_CRS_NAME = re.compile(r"(4326|3857|CRS84)$")
_OPEN = np.zeros(256, np.int8)
_OPEN[[ord("{"), ord("[")]] = 1
_OPEN[[ord("}"), ord("]")]] = -1


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if re.match(r"^file:/[^/]", path):
        path = "file://" + path[len("file:") :]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """The files at a path, in order, and their sizes; hidden ones are left out."""
    fs, where = filesystem(path)
    info = fs.get_file_info(where)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(where, recursive=True))
    keep = [f for f in found if f.is_file and not re.search(r"(^|/)[._]", f.path[len(where) :].lstrip("/"))]
    scheme = path[: len(path.rstrip("/")) - len(where.rstrip("/"))] if path.rstrip("/").endswith(where.rstrip("/")) else ""
    return sorted((scheme + f.path, f.size) for f in keep)


# the structure of a piece of JSON text -------------------------------------------------------


def unescaped_quotes(block: np.ndarray, slashes_before: int) -> np.ndarray:
    """Places of quotes that open or close a string; a quote after an odd number of
    backslashes does neither."""
    quotes = np.flatnonzero(block == ord('"'))
    slashes = np.flatnonzero(block == ord("\\"))
    if not len(slashes):
        return quotes[1:] if slashes_before % 2 and len(quotes) and quotes[0] == 0 else quotes
    begins = np.append(True, np.diff(slashes) > 1)
    first = slashes[begins]
    size = np.diff(np.append(np.flatnonzero(begins), len(slashes)))
    odd = (size + np.where(first == 0, slashes_before, 0)) % 2 == 1
    escaped = (first + size)[odd]
    if slashes_before % 2 and block[0] == ord('"'):
        escaped = np.append(escaped, 0)
    return quotes[~np.isin(quotes, escaped)]


def brackets(block: np.ndarray, quotes: np.ndarray, in_string: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of brackets outside strings, and the steps in depth they make."""
    at = np.flatnonzero(_OPEN[block])
    inside = (np.searchsorted(quotes, at) + in_string) % 2 == 1
    at = at[~inside]
    return at, _OPEN[block[at]].astype(np.int64)


def _read(path: str, start: int, size: int) -> bytes:
    fs, where = filesystem(path)
    with fs.open_input_file(where) as f:
        f.seek(start)
        return f.read(size)


def _slashes_before(path: str, start: int) -> int:
    """How many backslashes stand right before a place."""
    n, step = 0, 4096
    while n < start:
        piece = _read(path, max(0, start - n - step), min(step, start - n))
        own = len(piece) - len(piece.rstrip(b"\\"))
        n += own
        if own < len(piece):
            break
    return n


def summed_up(path: str, start: int, size: int) -> dict:
    """What a range does to the state of reading, if it begins outside or within a string."""
    back = min(start, NAME_BYTES)
    data = _read(path, start - back, back + size + CRS_BYTES)
    block = np.frombuffer(data, np.uint8)[back : back + size]
    quotes = unescaped_quotes(block, _slashes_before(path, start))
    out = {"odd": len(quotes) % 2, "cases": []}
    # a member belongs to the range in which its value begins
    names = [(m[1].decode(), m.end() - back, data[m.end() : m.end() + CRS_BYTES]) for m in _MEMBER.finditer(data, 0, back + size) if back <= m.end() < back + size]
    for in_string in (False, True):
        at, step = brackets(block, quotes, in_string)
        depth = step.cumsum()
        members = []
        for kind, begin, value in names:
            if (np.searchsorted(quotes, begin) + in_string) % 2 == 1:
                continue  # within a string
            k = int(np.searchsorted(at, begin))
            here = int(depth[k - 1]) if k else 0
            if kind == "crs":
                members.append([kind, begin, here, 0, value.decode(errors="replace")])
            elif value[:1] == b"[":
                members.append([kind, begin, here, int(depth[k + 1 :].min(initial=here + 1)), ""])
        out["cases"].append({"delta": int(step.sum()), "low": int(depth.min(initial=0)), "members": members})
    return out


@dataclass
class Range(InputPartition):
    """A part of a file and the state at its beginning."""

    path: str
    start: int
    size: int
    lines: bool
    in_string: bool = False
    depth: int = 0
    open: bool = False  # within the array of features
    key: int = -1  # where that array begins, if it does in this range
    crs: str = "CRS84"
    first: int = 0  # the number of the first feature that begins here

    def __post_init__(self):
        self.value = None


def folded(ranges: list[Range], sums: list[dict]) -> list[Range]:
    """The ranges of one file with their states; a collection without a known reference
    system or without features is an error."""
    in_string, depth, found, ended, crs = False, 0, False, False, None
    out = []
    for r, s in zip(ranges, sums):
        case, key = s["cases"][in_string], -1
        begins_open = found and not ended
        if begins_open and depth + case["low"] <= 1:
            ended = True
        for kind, at, here, low, value in case["members"]:
            if depth + here != 1:
                continue
            if kind == "crs" and crs is None:
                named = _crs_of(value)
                crs = named if named is not None else crs
            elif kind == "features" and not found:
                found, key, ended = True, r.start + at, depth + low <= 1
        out.append(Range(r.path, r.start, r.size, False, in_string, depth, begins_open, key))
        in_string, depth = in_string ^ bool(s["odd"]), depth + case["delta"]
    if not found:
        raise ValueError(f"no collection of features: {ranges[0].path if ranges else ''}")
    known = _CRS_NAME.search(crs or "")
    if not known:
        raise ValueError(f"missing or unknown reference system: {ranges[0].path}")
    for r in out:
        r.crs = known[1]
    return out


def _crs_of(text: str) -> str | None:
    try:
        found = json.JSONDecoder().raw_decode(text)[0]
    except ValueError:
        return None
    return ((found or {}).get("properties") or {}).get("name") if isinstance(found, dict) else None


# features of a range -------------------------------------------------------------------------


def pieces(r: Range) -> Iterator[bytes]:
    """The features that begin in a range, in order."""
    return _lines(r) if r.lines else _members(r)


def _lines(r: Range) -> Iterator[bytes]:
    data = _read(r.path, r.start, r.size)
    begin = 0
    if r.start and _read(r.path, r.start - 1, 1) != b"\n":
        begin = data.find(b"\n") + 1
        if begin == 0:
            return
    end = r.start + len(data)
    tail = b""
    while not data.endswith(b"\n") and not tail.endswith(b"\n"):  # the last line is read to its end
        more = _read(r.path, end + len(tail), 1 << 16)
        if not more:
            break
        cut = more.find(b"\n")
        tail += more if cut < 0 else more[: cut + 1]
    for line in (data[begin:] + tail).split(b"\n"):
        text = line.strip(b"\x1e \t\r")
        if text:
            yield text


def _members(r: Range) -> Iterator[bytes]:
    if not r.open and r.key < 0:
        return
    data = _read(r.path, r.start, r.size)
    block = np.frombuffer(data, np.uint8)
    quotes = unescaped_quotes(block, _slashes_before(r.path, r.start))
    at, step = brackets(block, quotes, r.in_string)
    depth = r.depth + step.cumsum()
    if not r.open:
        keep = at > r.key - r.start  # beyond the bracket that opens the array
        at, step, depth = at[keep], step[keep], depth[keep]
    kind = block[at]
    closed = np.flatnonzero((kind == ord("]")) & (depth == 1))
    ended = len(closed) > 0
    if ended:
        at, step, depth, kind = (x[: closed[0]] for x in (at, step, depth, kind))
    begins = at[(kind == ord("{")) & (depth == 3)]
    ends = at[(kind == ord("}")) & (depth == 2)]
    ends = ends[np.searchsorted(ends, begins[0]) :] if len(begins) else ends[:0]
    for a, b in zip(begins.tolist(), ends.tolist()):
        yield data[a : b + 1]
    if len(begins) > len(ends):
        inside = bool((len(quotes) + r.in_string) % 2)
        left = int(depth[-1])
        yield data[begins[-1] :] + _to_end(r.path, r.start + len(data), inside, left)


def _to_end(path: str, start: int, in_string: bool, depth: int) -> bytes:
    """The rest of a feature that goes on beyond its range."""
    out, size = [], 1 << 16
    while True:
        data = _read(path, start, size)
        if not data:
            raise ValueError(f"{path} ends within a feature")
        block = np.frombuffer(data, np.uint8)
        quotes = unescaped_quotes(block, _slashes_before(path, start))
        at, step = brackets(block, quotes, in_string)
        done = np.flatnonzero(depth + step.cumsum() == 2)
        if len(done):
            return b"".join(out) + data[: at[done[0]] + 1]
        out.append(data)
        start, in_string, depth, size = start + len(data), bool((len(quotes) + in_string) % 2), depth + int(step.sum()), min(2 * size, RANGE_BYTES)


# planning ------------------------------------------------------------------------------------


def _cut(path: str, range_bytes: int) -> list[Range]:
    return [Range(p, s, min(range_bytes, size - s), p.lower().endswith(LINE_ENDINGS)) for p, size in files_of(path) for s in range(0, size, range_bytes)]


def _numbered(ranges: list[Range], counts: list[int]) -> list[Range]:
    total = 0
    for r, n in zip(ranges, counts):
        r.first, total = total, total + n
    return ranges


def _states(ranges: list[Range], sums: list[dict | None]) -> list[Range]:
    out: list[Range] = []
    for path in dict.fromkeys(r.path for r in ranges):
        own = [(r, s) for r, s in zip(ranges, sums) if r.path == path]
        out += [r for r, _ in own] if own[0][0].lines else folded([r for r, _ in own], [s for _, s in own])
    return out


def _spread(spark: SparkSession, ranges: list[Range], what) -> list:
    """``what`` of each range, worked out by a task of its own."""
    if not ranges:
        return []

    def run(batches):
        for batch in batches:
            got = [json.dumps(what(Range(**json.loads(x)))) for x in batch.column("range").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(got, pa.string())], names=["i", "got"])

    rows = spark.createDataFrame([(i, json.dumps(asdict(r))) for i, r in enumerate(ranges)], "i long, range string")
    got = rows.repartitionByRange(len(ranges), "i").mapInArrow(run, "i long, got string").collect()
    return [json.loads(r["got"]) for r in sorted(got, key=lambda r: r["i"])]


def _sum_of(r: Range) -> dict | None:
    return None if r.lines else summed_up(r.path, r.start, r.size)


def _count_of(r: Range) -> int:
    return sum(1 for _ in pieces(r))


def planned(path: str, spark: SparkSession | None = None, range_bytes: int = RANGE_BYTES) -> list[Range]:
    """The ranges of all files at a path with their states and first feature numbers. With a
    session the bytes are read by tasks; a few numbers for each range come to the driver."""
    ranges = _cut(path, range_bytes)
    each = (lambda what, rs: [what(r) for r in rs]) if spark is None else partial(lambda s, what, rs: _spread(s, rs, what), spark)
    ranges = _states(ranges, each(_sum_of, ranges))
    return _numbered(ranges, each(_count_of, ranges))


# the data source -----------------------------------------------------------------------------


class GeoJson(DataSource):
    """``spark.read.format("geojson")``: a row for each feature, numbered over all files.

    ``path`` is a file or folder. ``ranges`` may hold what ``planned`` found, as JSON; else
    the files are planned in the driver. Writing takes (feature_idx, feature), in order, to
    one new file; ``crs`` is CRS84, 4326 or 3857.
    """

    @classmethod
    def name(cls) -> str:
        return "geojson"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Range]:
        given = self.options.get("ranges")
        ranges = [Range(**x) for x in json.loads(given)] if given else planned(self.options["path"])
        return ranges or [Range("", 0, 0, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows, size, number = [], 0, partition.first
        schema = pa.schema([("crs", pa.string()), ("feature_idx", pa.int64()), ("feature", pa.string())])

        def batch(rows, number):
            return pa.RecordBatch.from_arrays([pa.array([partition.crs] * len(rows)), pa.array(range(number, number + len(rows)), pa.int64()), pa.array(rows)], schema=schema)

        for text in pieces(partition) if partition.path else ():
            rows.append(text.decode())
            size += len(text)
            if len(rows) == BATCH_ROWS or size > BATCH_BYTES:
                yield batch(rows, number)
                number, rows, size = number + len(rows), [], 0
        if rows:
            yield batch(rows, number)


@dataclass
class _Part(WriterCommitMessage):
    path: str
    first: int
    rows: int


class _Writer(DataSourceArrowWriter):
    """Tasks write parts beside the file; the commit puts them together, block by block, in
    the order of their first features, and the file appears only when it is whole."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, crs = options["path"], options.get("crs", "CRS84")
        self.crs = CRS_NAMES[crs]
        fs, where = filesystem(self.path)
        if not overwrite and fs.get_file_info(where).type != pafs.FileType.NotFound:
            raise FileExistsError(f"{self.path} exists already")
        self.parts = f"{where}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        fs, _ = filesystem(self.path)
        fs.create_dir(self.parts)
        path, rows, first = f"{self.parts}/{uuid.uuid4().hex}", 0, -1
        with fs.open_output_stream(path) as out:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if not rows:
                    first = batch.column("feature_idx")[0].as_py()
                texts = batch.column("feature").to_pylist()
                out.write(((",\n" if rows else "") + ",\n".join(texts)).encode())
                rows += len(texts)
        return _Part(path, first, rows)

    def commit(self, messages: list[_Part]) -> None:
        fs, where = filesystem(self.path)
        fs.create_dir(self.parts)
        whole = f"{self.parts}/whole"
        head = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": self.crs}}}
        with fs.open_output_stream(whole) as out:
            out.write(json.dumps(head)[:-1].encode() + b', "features": [\n')
            for k, part in enumerate(sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.first)):
                out.write(b",\n" if k else b"")
                with fs.open_input_stream(part.path) as f:
                    while data := f.read(8 << 20):
                        out.write(data)
            out.write(b"\n]}\n")
        fs.move(whole, where)
        fs.delete_dir(self.parts)

    def abort(self, messages: list[_Part]) -> None:
        fs, _ = filesystem(self.path)
        if fs.get_file_info(self.parts).type != pafs.FileType.NotFound:
            fs.delete_dir(self.parts)
