"""A whole run, from a network file and tile images to the network with widths.

    measure_network(spark, "paths.geojson", images, predictor, "work", "paths-with-widths.geojson")

Masks and widths go to append-only tables below the work folder. A run that was ended starts
again with the same call: tiles that have a mask aren't predicted again, and edges that have
a result under the same run key are taken out by an anti-join before the costly plan.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import measures as M
from ..operators import stores, tiles, widths
from ..operators.predict import Predictor, predict_masks
from ..operators.progress import RunProgress
from ..schema import CONTEXT, TILE_SIZE, WIDTH, ZOOM, WidthParams
from ..sources import geojson, graph, tile_files
from ..sources.shared import kept

KEY, TILE_KEY = tiles.KEY, tiles.TILE_KEY
#: Rows of the result table; the latest of a run key and edge counts.
RESULT = "run_key string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in WIDTH) + ", updated_at timestamp"
MASK = "z int, x long, y long, mask binary, error string"
#: What isn't taken as finished: it is tried again when the run is.
AGAIN = "missing_images_or_labels"
#: An edge that gave no row of its own: it doesn't lie on its mosaic.
NO_ROW = "no_results"


@dataclass(frozen=True)
class Report:
    """Where the results are and what was done; ``computed`` counts edges of this call only."""

    run_key: str
    results: str
    output: str
    edges: int
    eligible: int
    resumed: int
    computed: int
    calculated: int
    failed: int


def table(spark: SparkSession, path: str, schema: str, by: list[str]) -> DataFrame:
    """The rows of an append-only table, which is made if it isn't there."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def key_of(spark: SparkSession, graph_path: str, model: str, source: str, zoom: int, context: float, size: int, params: WidthParams) -> str:
    """One text for everything that a width depends on: the network's files and sizes, the
    model, the tile source and all parameters."""
    files = json.dumps(geojson.files_of(graph_path))
    parts = [files, model, source, zoom, context, size, json.dumps(asdict(params), sort_keys=True)]
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def folder_images(spark: SparkSession, folder: str, zoom: int = ZOOM) -> DataFrame:
    """``z, x, y, content`` of the tile files in a folder; of several files of one tile the
    first in the order of candidates."""
    files = tile_files.listed_files(spark, folder)
    best = tile_files.catalogue(files.select("path"), zoom).groupBy(*TILE_KEY).agg(F.min_by("path", "rank").alias("path"))
    # a file that goes after the listing is a tile that is missing
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(folder)
    return contents.select("path", "content").join(best, "path").select(*TILE_KEY, "content")


def predicted(spark: SparkSession, images: DataFrame, wanted: DataFrame, predictor: Predictor, path: str, size: int, model: str) -> DataFrame:
    """``z, x, y, mask`` of the wanted tiles from the mask table, to which the masks that it
    lacks are added; a tile that failed is tried again in the next run."""
    spec = "model string, " + MASK
    done = table(spark, path, spec, ["model"]).where((F.col("model") == model) & F.col("mask").isNotNull())
    todo = images.join(wanted.select(*TILE_KEY).distinct(), TILE_KEY, "left_semi")
    new = predict_masks(todo, predictor, done, size).select(F.lit(model).alias("model"), *TILE_KEY, "mask", "error")
    new.write.mode("append").partitionBy("model").parquet(path)
    all_ = spark.read.schema(spec).parquet(path).where((F.col("model") == model) & F.col("mask").isNotNull())
    return all_.dropDuplicates(TILE_KEY).join(wanted.select(*TILE_KEY).distinct(), TILE_KEY, "left_semi").select(*TILE_KEY, "mask")


def finished(spark: SparkSession, path: str, run_key: str) -> DataFrame:
    """The latest result of each edge of a run."""
    rows = table(spark, path, RESULT, ["run_key"]).where(F.col("run_key") == run_key)
    return stores.latest(rows, KEY, ["updated_at", "status"]).drop("run_key")


def batches_of(lines: DataFrame, edges_per_batch: int) -> tuple[DataFrame, int]:
    """Adds a ``batch``; edges of one mosaic are in the same one, so its polygons are found once."""
    count = max(1, -(-lines.count() // edges_per_batch))
    return lines.withColumn("batch", F.pmod(F.xxhash64("mosaic"), F.lit(count)).cast("int")), count


def width_batch(edges: DataFrame, lines: DataFrame, cells: DataFrame, masks: DataFrame, zoom: int, params: WidthParams, size: int) -> DataFrame:
    """A row for every edge of a batch, with its status."""
    own = cells.join(lines.select("mosaic").distinct(), "mosaic", "left_semi")
    with_masks = own.select("mosaic", F.lit(zoom).alias("z"), "x", "y").join(masks, TILE_KEY, "left").select("mosaic", "x", "y", "mask")
    found = widths.edge_widths(lines.select(*KEY, "mosaic", "line"), with_masks, params, size)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in WIDTH.fields[3:]]
    rest = edges.select(*KEY).join(found.select(*KEY), KEY, "left_anti").select(*KEY, F.lit(NO_ROW).alias("status"), *blank)
    return found.union(rest)


def measure_network(
    spark: SparkSession,
    graph_path: str,
    images: DataFrame | str,
    predictor: Predictor,
    work: str,
    output: str,
    model: str = "model",
    source: str = "local",
    params: WidthParams | None = None,
    zoom: int = ZOOM,
    context: float = CONTEXT,
    size: int = TILE_SIZE,
    edges_per_batch: int = 50_000,
    listen: Callable[[dict], None] | None = None,
    width_field: str = "Width",
) -> Report:
    """Measures all edges of a network whose tiles are complete, and writes the network anew.

    ``images`` is ``z, x, y, content``, or a folder of tile files. ``output`` must not exist.
    ``listen`` is told of every stage and batch; what it raises ends the run, and what was
    appended till then stays. ``model`` and ``source`` name what the masks come from.
    """
    p, told = params or WidthParams(), RunProgress(listen)
    told.at("load_graph", 0, 1)
    feats = graph.read_features(spark, graph_path)
    edges = kept(graph.edges(graph.parsed(feats)), "run-edges")
    n_edges = edges.count()
    told.at("load_graph", 1, 1)

    needed = kept(tiles.edge_tiles(edges, zoom, context), "run-tiles")
    unique = tiles.unique_tiles(needed)
    told.at("tile_indices", 1, 1)

    if isinstance(images, str):
        images = folder_images(spark, images, zoom)
    missing = kept(unique.select(*TILE_KEY).join(images.select(*TILE_KEY), TILE_KEY, "left_anti"), "run-missing")
    eligible = kept(tiles.eligible_edges(edges, needed, missing), "run-eligible")
    needed = needed.join(eligible.select(*KEY), KEY, "left_semi")
    n_eligible = eligible.count()
    told.at("find_tiles", 1, 1)

    told.at("prepare_tiles", 1, 1)
    masks = kept(predicted(spark, images, needed, predictor, f"{work}/masks", size, model), "run-masks")
    told.at("predict_masks", 1, 1)

    run_key, results = key_of(spark, graph_path, model, source, zoom, context, size, p), f"{work}/widths"
    before = kept(finished(spark, results, run_key).where(F.col("status") != AGAIN).select(*KEY), "run-finished")
    resumed = before.join(eligible.select(*KEY), KEY, "left_semi").count()
    todo = eligible.join(before, KEY, "left_anti")
    bare = widths.no_tiles(todo, needed)
    named = tiles.mosaics(needed.join(todo.select(*KEY), KEY, "left_semi"), size)
    lines, n_batches = batches_of(kept(tiles.mosaic_lines(todo, named, zoom, size), "run-lines"), edges_per_batch)
    cells = kept(tiles.mosaic_cells(named), "run-cells")
    computed = append(bare, results, run_key)
    told.at("calculate_widths", resumed + computed, n_eligible)
    for k in range(n_batches):
        own = lines.where(F.col("batch") == k)
        computed += append(width_batch(own, own, cells, masks, zoom, p, size), results, run_key)
        told.at("calculate_widths", resumed + computed, n_eligible)

    rows = kept(finished(spark, results, run_key).join(eligible.select(*KEY), KEY, "left_semi"), "run-results")
    crs = "CRS84"
    known = feats.select("crs").distinct().limit(2).collect()
    if len(known) == 1:
        crs = known[0]["crs"]  # geometry is written as it was read
    elif known:
        raise ValueError("files of several reference systems can't be written as one collection")
    graph.write_collection(graph.updated_texts(feats, rows.select("feature_idx", "width_m"), width_field), output, crs)
    counts = M.status_counts(rows.where(~F.col("status").isin(NO_ROW, AGAIN, "no_tiles"))).first()
    told.at("update_graph", 1, 1)
    return Report(run_key, results, output, n_edges, n_eligible, resumed, computed, counts["calculated"], counts["failed"])


def append(rows: DataFrame, path: str, run_key: str) -> int:
    """Adds finished rows to the result table and counts them. A row is the whole result of
    its edge, so if a job ends while its files appear, those that are there are right."""
    ready = kept(rows, "run-batch")
    stamped: list[Column] = [F.lit(run_key).alias("run_key"), *[F.col(f.name) for f in WIDTH], F.current_timestamp().alias("updated_at")]
    ready.select(*stamped).write.mode("append").partitionBy("run_key").parquet(path)
    return ready.count()
