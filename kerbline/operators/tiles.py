"""Which map tiles an edge needs, which are missing, and which edges can be measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import tile_x, tile_y
from ..schema import CONTEXT, EXTENSIONS, TILE_SIZE, ZOOM

KEY = ["feature_idx", "part_idx"]
TILE_KEY = ["z", "x", "y"]


def valid_positions(edges: DataFrame) -> DataFrame:
    """Edges with only positions that have both coordinates."""
    return edges.withColumn("coords", F.filter("coords", lambda p: p["lon"].isNotNull() & p["lat"].isNotNull()))


def bounding_boxes(edges: DataFrame, buffer_degrees: float = 0.0) -> DataFrame:
    """Least and greatest coordinates of each edge; an edge without a position is an error."""
    lons, lats = F.transform("coords", lambda p: p["lon"]), F.transform("coords", lambda p: p["lat"])
    sized = valid_positions(edges).withColumn("coords", F.when(F.size("coords") > 0, F.col("coords")).otherwise(F.raise_error(F.lit("edge without a valid position"))))
    return sized.select(
        *KEY,
        (F.array_min(lons) - buffer_degrees).alias("lon_min"), (F.array_max(lons) + buffer_degrees).alias("lon_max"),
        (F.array_min(lats) - buffer_degrees).alias("lat_min"), (F.array_max(lats) + buffer_degrees).alias("lat_max"),
    )


def edge_tiles(edges: DataFrame, zoom: int = ZOOM, context: float = CONTEXT) -> DataFrame:
    """A row for each tile of the box of each edge, widened by a part of a tile.

    A narrow generator: no shuffle, and both ranges are bounded by the map.
    """
    last = 2**zoom - 1
    low = lambda v: F.greatest(F.lit(0), F.floor(v - context)).cast("long")
    high = lambda v: F.least(F.lit(last), F.floor(v + context)).cast("long")
    box = bounding_boxes(edges)
    ranges = box.select(
        *KEY,
        F.sequence(low(tile_x(F.col("lon_min"), zoom)), high(tile_x(F.col("lon_max"), zoom))).alias("xs"),
        F.sequence(low(tile_y(F.col("lat_max"), zoom)), high(tile_y(F.col("lat_min"), zoom))).alias("ys"),
    )
    return ranges.select(*KEY, F.lit(zoom).alias("z"), F.explode("xs").alias("x"), "ys").select(*KEY, "z", "x", F.explode("ys").alias("y"))


def unique_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy(*TILE_KEY).agg(F.count("*").alias("n_edges"))


def tile_index(tiles: DataFrame) -> DataFrame:
    """For each tile the sorted edges that need it."""
    return tiles.groupBy(*TILE_KEY).agg(F.array_sort(F.collect_list(F.struct(*KEY))).alias("edges"))


def skipped_edges(tiles: DataFrame, missing: DataFrame) -> DataFrame:
    """Edges that need a missing tile, with those tiles in order."""
    lost = tiles.join(missing.select(*TILE_KEY), TILE_KEY)
    return lost.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*TILE_KEY))).alias("missing"))


def eligible_edges(edges: DataFrame, tiles: DataFrame, missing: DataFrame) -> DataFrame:
    """Edges without a missing tile; one that needs no tile is among them."""
    lost = tiles.join(missing.select(*TILE_KEY), TILE_KEY, "left_semi").select(*KEY).distinct()
    return edges.join(lost, KEY, "left_anti")


def completeness(edges: DataFrame, tiles: DataFrame, missing: DataFrame) -> DataFrame:
    """Tiles needed and missing, and whether each edge can be measured, in one pass."""
    marked = tiles.join(missing.select(*TILE_KEY).distinct().withColumn("gone", F.lit(1)), TILE_KEY, "left")
    counts = marked.groupBy(*KEY).agg(F.count("*").alias("n_tiles"), F.count("gone").alias("n_missing"))
    joined = edges.select(*KEY).join(counts, KEY, "left").fillna(0, ["n_tiles", "n_missing"])
    return joined.withColumn("eligible", F.col("n_missing") == 0)


def candidate_path(z: Column, x: Column, y: Column, rank: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """The path of a tile by rank: extensions in turn, and in each the three layouts."""
    s = lambda c: c.cast("string")
    layouts = F.array(F.concat(s(x), F.lit("_"), s(y)), F.concat(s(z), F.lit("/"), s(x), F.lit("/"), s(y)), F.concat(s(z), F.lit("/"), s(x), F.lit("_"), s(y)))
    ext = F.array(*[F.lit(e) for e in extensions])
    return F.concat(F.get(layouts, (rank % 3).cast("int")), F.get(ext, F.floor(rank / 3).cast("int")))


def tile_paths(tiles: DataFrame, found: DataFrame) -> DataFrame:
    """The first candidate that exists of each tile, else the first candidate.

    ``found`` holds (z, x, y, rank) of files that exist.
    """
    best = found.groupBy(*TILE_KEY).agg(F.min("rank").alias("rank"))
    joined = tiles.select(*TILE_KEY).distinct().join(best, TILE_KEY, "left")
    path = candidate_path(F.col("z"), F.col("x"), F.col("y"), F.coalesce("rank", F.lit(0)))
    return joined.select(*TILE_KEY, path.alias("path"), F.when(F.col("rank").isNull(), "missing").otherwise("direct").alias("status"))


def fetch_outcome(http_status: Column, content_type: Column, decodable: Column) -> Column:
    """What a fetched tile is: kept, missing for good, or failed in this run only."""
    good = (http_status == 200) & content_type.startswith("image/") & decodable
    return F.when(http_status == 404, "missing").when(good, "ok").otherwise("failed")


def tile_url(template: str, z: Column, x: Column, y: Column) -> Column:
    out = F.lit(template)
    for name, value in (("{z}", z), ("{x}", x), ("{y}", y)):
        out = F.replace(out, F.lit(name), value.cast("string"))
    return out


def no_missing_tiles(tiles: DataFrame) -> DataFrame:
    """A remote source knows of no missing tile before it fetches."""
    return tiles.select(*TILE_KEY).limit(0)


def cache_actions(tiles: DataFrame, local: DataFrame, cached: DataFrame) -> DataFrame:
    """What preparing each tile does: direct (a local file), skipped (in the cache already),
    missing (known to be) or downloaded. The cache key includes the zoom."""
    joined = tiles.select(*TILE_KEY).distinct().join(local.select(*TILE_KEY, F.lit(1).alias("local")), TILE_KEY, "left").join(cached.select(*TILE_KEY, "status"), TILE_KEY, "left")
    action = F.when(F.col("local") == 1, "direct").when(F.col("status") == 1, "skipped").when(F.col("status") == 2, "missing").otherwise("downloaded")
    return joined.select(*TILE_KEY, action.alias("action"))


def mosaic_extents(tiles: DataFrame, size: int = TILE_SIZE) -> DataFrame:
    """Tile extents and pixel size of the mosaic of each edge."""
    ext = tiles.groupBy(*KEY).agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    return ext.select("*", ((F.col("max_x") - F.col("min_x") + 1) * size).alias("width"), ((F.col("max_y") - F.col("min_y") + 1) * size).alias("height"))


def pixel_points(points: DataFrame, extents: DataFrame, zoom: int = ZOOM, size: int = TILE_SIZE) -> DataFrame:
    """Adds the place of each point on its edge's mosaic, in pixels, y down."""
    px = (tile_x(F.col("lon"), zoom) - F.col("min_x")) * size
    py = (tile_y(F.col("lat"), zoom) - F.col("min_y")) * size
    return points.join(extents, KEY).select(*points.columns, px.alias("px"), py.alias("py"))


def mosaics(tiles: DataFrame, size: int = TILE_SIZE) -> DataFrame:
    """The extent of each edge's mosaic and its name; edges with the same extent share it."""
    return mosaic_extents(tiles, size).withColumn("mosaic", F.concat_ws("_", "min_x", "min_y", "max_x", "max_y"))


def mosaic_lines(edges: DataFrame, named: DataFrame, zoom: int = ZOOM, size: int = TILE_SIZE) -> DataFrame:
    """``feature_idx, part_idx, mosaic, line``: each edge in pixels of its mosaic, as one flat array."""
    points = pixel_points(valid_positions(edges).select(*KEY, F.posexplode("coords").alias("i", "p")).select(*KEY, "i", "p.lon", "p.lat"), named.select(*KEY, "mosaic", "min_x", "min_y"), zoom, size)
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "px", "py"))), lambda s: F.array(s["px"], s["py"])))
    lines = points.groupBy(*KEY).agg(flat.alias("line"))
    return lines.join(named.select(*KEY, "mosaic"), KEY).select(*KEY, "mosaic", "line")


def mosaic_cells(named: DataFrame) -> DataFrame:
    """``mosaic, x, y``: a row for each tile of each mosaic."""
    span = lambda a: F.explode(F.sequence(f"min_{a}", f"max_{a}"))
    return named.select("mosaic", "min_x", "min_y", "max_x", "max_y").distinct().withColumn("x", span("x")).withColumn("y", span("y")).select("mosaic", "x", "y")
