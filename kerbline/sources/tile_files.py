"""Tile and mask files: listing, choosing, and writing masks once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tiles import TILE_KEY
from ..schema import EXTENSIONS, LABEL_EXTENSIONS, ZOOM


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of all files below a folder; contents are read only if they are asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def catalogue(files: DataFrame, zoom: int = ZOOM, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(z, x, y, rank, path) of tile files in any of the three layouts, of one zoom."""
    low = F.lower("path")
    parts = F.regexp_extract
    pattern = r"(?:(?<=/)|^)(?:(\d+)/)?(\d+)[_/](\d+)(\.(?:jpg|jpeg|png))$"
    z, x, y, ext = (parts(low, pattern, i) for i in (1, 2, 3, 4))
    layout = F.when(low.rlike(r"/\d+_\d+\.\w+$") & (z == ""), 0).when(low.rlike(r"/\d+/\d+/\d+\.\w+$"), 1).otherwise(2)
    ext_rank = F.array_position(F.array(*[F.lit(e) for e in extensions]), ext) - 1
    found = files.select(F.when(z == "", F.lit(zoom)).otherwise(z.cast("int")).alias("z"), x.cast("long").alias("x"), y.cast("long").alias("y"), (ext_rank * 3 + layout).cast("int").alias("rank"), "path")
    return found.where((x != "") & (ext_rank >= 0) & (F.col("z") == zoom))


def label_paths(wanted: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the first existing label (png, jpg, jpeg) of each tile, or null.

    ``labels`` has (z, x, y, ext)."""
    order = F.array(*[F.lit(e) for e in LABEL_EXTENSIONS])
    best = labels.groupBy(*TILE_KEY).agg(F.min_by("ext", F.array_position(order, F.col("ext"))).alias("ext"))
    return wanted.join(best, TILE_KEY, "left")


def images(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Image files by extension, in any case of letters."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.where(ext.isin(*extensions))


def write_new(masks: DataFrame, done: DataFrame | None, path: str, keys: list[str] | None = None) -> DataFrame:
    """Append masks whose key isn't there; a failed commit leaves nothing half-written."""
    keys = keys or TILE_KEY
    new = masks if done is None else masks.join(done.select(*keys), keys, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def tile_source(kind: str, **options):
    """A function (tiles) -> missing tiles for a kind of source, ``local`` or ``remote``."""
    if kind == "local":
        found = options["found"]
        return lambda tiles: tiles.select(*TILE_KEY).distinct().join(found.select(*TILE_KEY), TILE_KEY, "left_anti")
    if kind == "remote":
        if not options.get("work_dir"):
            raise ValueError("a remote source needs work_dir")
        return lambda tiles: tiles.select(*TILE_KEY).limit(0)
    raise ValueError(f"unknown tile source {kind!r}")
