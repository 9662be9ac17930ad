"""Functions that SQL texts can call: ``kb_tile_x``, ``kb_tile_y``, ``kb_narrow_width``,
``kb_cross_section``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..schema import MAX_LATITUDE, WidthParams
from . import shapes


def register(spark: SparkSession) -> None:
    """Registers all of them in this session: the tile maths as SQL functions, which stay in
    the JVM, the others over Arrow batches."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kb_tile_x(lon DOUBLE, zoom INT) RETURNS DOUBLE RETURN (lon + 180D) / 360D * power(2D, zoom)")
    phi = f"radians(greatest({-MAX_LATITUDE}D, least({MAX_LATITUDE}D, lat)))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION kb_tile_y(lat DOUBLE, zoom INT) RETURNS DOUBLE RETURN (1D - ln(tan({phi}) + 1D / cos({phi})) / pi()) / 2D * power(2D, zoom)")

    @F.pandas_udf("double")
    def narrow_width(widths: pd.Series) -> pd.Series:
        p = WidthParams()
        px = widths.map(lambda w: None if w is None else shapes.narrow_estimate([x for x in w], p.low_quantile, p.high_quantile, p.min_count))
        return px.map(lambda x: None if x is None else round(x * p.pixel_size_m, 2))

    @F.pandas_udf("double")
    def cross_section(xs: pd.Series, ys: pd.Series, cx: pd.Series, cy: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.Series:
        half = WidthParams().half_span
        rows = zip(xs, ys, cx, cy, dx, dy)
        return pd.Series([shapes.cross_section(np.array([a, b]), np.array([c, d]) / np.hypot(c, d), np.stack([x, y], 1), half) for x, y, a, b, c, d in rows], dtype=float)

    for name, f in (("kb_narrow_width", narrow_width), ("kb_cross_section", cross_section)):
        spark.udf.register(name, f)
