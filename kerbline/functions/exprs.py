"""Column-to-column forms of the map and measurement maths; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EARTH_ECCENTRICITY, MAX_LATITUDE


def tile_x(lon: Column, zoom: int) -> Column:
    """Fractional tile column of a longitude (spherical web map, origin top left)."""
    return (lon + 180.0) / 360.0 * float(2**zoom)


def tile_y(lat: Column, zoom: int) -> Column:
    """Fractional tile row of a latitude, clamped to the map."""
    phi = F.radians(F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat)))
    return (1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / F.pi()) / 2.0 * float(2**zoom)


def row_latitude(tile_row: Column, pixel_row: Column, zoom: int, size: int = 256) -> Column:
    """Latitude in radians of the middle of a pixel row of a tile."""
    row = tile_row * size + pixel_row + 0.5
    return F.atan(F.sinh(F.pi() * (1.0 - 2.0 * row / float(size * 2**zoom))))


def ellipsoidal_y(phi: Column, zoom: int, size: int = 256) -> Column:
    """Global pixel row of a latitude in radians on the ellipsoidal map."""
    e = EARTH_ECCENTRICITY
    merc = F.log(F.tan(F.pi() / 4 + phi / 2) * F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2)))
    return (1.0 - merc / F.pi()) / 2.0 * float(size * 2**zoom)


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounds as Python does: ties to even."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale if digits else F.rint(x)


def half_away(x: Column, digits: int) -> Column:
    """Rounding of the number times a power of ten, halves away from zero. ``F.round`` rounds the
    shortest text of a number instead: 257.8227535, which lies below that half, goes up there."""
    scaled = F.round(x * 10.0**digits) / 10.0**digits
    return F.when(F.abs(x) < 1e300, scaled).otherwise(x)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lerp_quantile(ordered: Column, q: float) -> Column:
    """The linear-interpolation quantile of a sorted array of doubles; null if empty."""
    pos = (F.size(ordered) - 1) * F.lit(q)
    low = F.floor(pos).cast("int")
    t = pos - low
    a = F.get(ordered, low)
    b = F.coalesce(F.get(ordered, low + 1), a)
    return F.when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t)


def middle(ordered: Column) -> Column:
    """The median of a sorted array; null if empty."""
    n = F.size(ordered)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2.0)


def narrow_widths(widths: Column, low: float = 0.15, high: float = 0.65, least: int = 3) -> Column:
    """The widths that the narrow estimator keeps, sorted: those between two quantiles, or
    up to the upper one, or the least few, whichever first has ``least``."""

    def pick(ordered: Column) -> Column:
        def between(q: Column) -> Column:
            return let(F.filter(ordered, lambda w: (w >= q["low"]) & (w <= q["high"])), lambda inner: F.when(F.size(inner) >= least, inner).otherwise(below(q)))

        def below(q: Column) -> Column:
            return let(F.filter(ordered, lambda w: w <= q["high"]), lambda lower: F.when(F.size(lower) >= least, lower).otherwise(F.slice(ordered, 1, least)))

        ends = F.struct(lerp_quantile(ordered, low).alias("low"), lerp_quantile(ordered, high).alias("high"))
        return F.when(F.size(ordered) < least, ordered).otherwise(let(ends, between))

    return let(F.array_sort(F.filter(widths, finite)), pick)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def metres(px: Column, pixel_m: float) -> Column:
    return half_even(px * pixel_m, 2)


def segments(points: Column) -> Column:
    """Pairs of consecutive points."""
    n = F.size(points)
    return F.when(n > 1, F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def ring_area(xs: Column, ys: Column) -> Column:
    """Signed area of a ring without its closing point."""
    n = F.size(xs)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(xs, i) * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i))
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2.0


def clip_hits(x0: Column, y0: Column, x1: Column, y1: Column, rect: tuple[float, float, float, float]) -> Column:
    """Whether a segment meets a closed rectangle (parametric clipping)."""
    left, top, right, bottom = rect
    lows, highs, fits = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for start, d, lo, hi in ((x0, x1 - x0, left, right), (y0, y1 - y0, top, bottom)):
        flat = d == 0
        a, b = (F.lit(lo) - start) / F.nullif(d, F.lit(0.0)), (F.lit(hi) - start) / F.nullif(d, F.lit(0.0))
        lows.append(F.coalesce(F.least(a, b), F.lit(0.0)))
        highs.append(F.coalesce(F.greatest(a, b), F.lit(1.0)))
        fits = fits & (~flat | start.between(lo, hi))
    return fits & (F.greatest(*lows) <= F.least(*highs))


def unit(dx: Column, dy: Column) -> tuple[Column, Column]:
    """The unit vector, or nulls for no length."""
    n = F.nullif(F.hypot(dx, dy), F.lit(0.0))
    return dx / n, dy / n


def quality_score(rel_mae: Column, valid_ratio: Column) -> Column:
    return -rel_mae + 0.15 * valid_ratio


def axis_score(coverage: Column, dot: Column, std: Column, distance: Column, step: float = 10.0, sigma: float = 120.0) -> Column:
    spread = F.exp(-std / max(step, 1))
    return (0.6 * coverage + 0.25 * dot + 0.15 * spread) * F.exp(-distance / sigma)


def clock_text(seconds: Column) -> Column:
    """Hours and minutes, or minutes and seconds, or seconds, in the interface's language."""
    s = F.greatest(F.lit(0), seconds.cast("long"))
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return (
        F.when(h > 0, F.format_string("%d ч %02d мин", h.cast("long"), m.cast("long")))
        .when(m > 0, F.format_string("%d мин %02d сек", m.cast("long"), r.cast("long")))
        .otherwise(F.format_string("%d сек", r.cast("long")))
    )


TAU = 2 * math.pi
