"""Table schemas and the parameters of a production run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ZOOM = 20
TILE_SIZE = 256
CONTEXT = 64 / 256  # tiles around a bounding box
PIXEL_M = 0.08
MAX_LATITUDE = 85.05112878
EARTH_ECCENTRICITY = 0.0818191908426

# The colour of each mask class, and the statuses with their texts.
PALETTE = {0: (61, 61, 245), 1: (10, 153, 0), 2: (255, 4, 4), 3: (0, 0, 0)}
SIDEWALK_CLASSES = (0, 2)
CROSSWALK_CLASSES = (2,)
IMAGE_MEAN = (0.485, 0.456, 0.406)
IMAGE_STD = (0.229, 0.224, 0.225)
EXTENSIONS = (".jpg", ".jpeg", ".png")
LABEL_EXTENSIONS = (".png", ".jpg", ".jpeg")

COORD = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
EDGE = T.StructType(
    [
        T.StructField("feature_idx", T.LongType()),
        T.StructField("part_idx", T.IntegerType()),
        T.StructField("coords", T.ArrayType(COORD)),
        T.StructField("properties", T.StringType()),
    ]
)
TILE = T.StructType([T.StructField("z", T.IntegerType()), T.StructField("x", T.LongType()), T.StructField("y", T.LongType())])
WIDTH = T.StructType(
    [
        T.StructField("feature_idx", T.LongType()),
        T.StructField("part_idx", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("width_m", T.DoubleType()),
        T.StructField("width_px", T.DoubleType()),
        T.StructField("width_mode", T.StringType()),
        T.StructField("crosswalk_ratio", T.DoubleType()),
    ]
)


# The defaults below.
@dataclass(frozen=True)
class WidthParams:
    """The tunables of width measurement, at their production values."""

    pixel_size_m: float = PIXEL_M
    min_polygon_area: float = 100.0
    simplify: float = 4.0
    smooth_radius: int = 2
    crosswalk_ratio: float = 0.5
    crosswalk_tolerance: float = 2.0
    crosswalk_min_m: float = 3.5
    edge_buffer: float = 10.0
    assign_distance: float = 50.0
    axis_weight: float = 800.0
    min_coverage: float = 0.25
    skeleton_pad: int = 5
    min_line: float = 3.0
    axis_simplify: float = 8.0
    axis_min_segment: float = 8.0
    edge_step: float = 10.0
    match_distance: float = 120.0
    candidate_distance: float = 240.0
    cluster_radius: float = 12.0
    max_candidates: int = 250
    length_weight: float = 0.001
    parallel_cos: float = 0.75
    inside_ratio: float = 0.5
    inside_tolerance: float = 2.0
    step: float = 10.0
    half_span: float = 120.0
    direction_delta: float = 3.0
    cut_delta: float = 25.0
    cut_simplify: float = 20.0
    cut_extension: float = 5.0
    cut_keep_buffer: float = 5.0
    min_piece_area: float = 20.0
    min_removed: float = 50.0
    max_removed_ratio: float = 0.75
    max_cuts: int = 5
    min_improvement: float = 0.03
    valid_ratio: float = 0.5
    keep_ratio: float = 0.8
    cut_distance: float = 120.0
    low_quantile: float = 0.15
    high_quantile: float = 0.65
    min_count: int = 3
