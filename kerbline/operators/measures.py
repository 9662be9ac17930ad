"""Masks, measurements and width estimates as relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as E
from ..schema import IMAGE_MEAN, IMAGE_STD, PALETTE, PIXEL_M
from .spatial import box_pairs, boxed


def pixel_classes(logits: DataFrame, pixels: int = 16, classes: int = 4) -> DataFrame:
    """A row per pixel with its class: the first of the greatest logits."""
    values = F.transform(F.sequence(F.lit(0), F.lit(pixels - 1)), lambda p: F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.get("logits", c * pixels + p)))
    rows = logits.select("vec_id", "x", "y", F.posexplode(values).alias("p", "a"))
    return rows.select("vec_id", "x", "y", "p", (F.array_position("a", F.array_max("a")) - 1).cast("int").alias("class"))


def colours(class_: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a class, from the palette."""
    table = F.create_map(*[v for k, rgb in PALETTE.items() for v in (F.lit(k), F.array(*[F.lit(c) for c in rgb]))])
    rgb = F.element_at(table, class_)
    return rgb[0], rgb[1], rgb[2]


def colour_class(r: Column, g: Column, b: Column) -> Column:
    """The class whose colour is just this, or null."""
    out = F.lit(None).cast("int")
    for k, rgb in PALETTE.items():
        out = F.when((r == rgb[0]) & (g == rgb[1]) & (b == rgb[2]), k).otherwise(out)
    return out


def upsampled(grid: Column, size: int, out: int) -> Column:
    """Bilinear resize of a row-major square grid, pixel centres kept at half places."""
    scale = size / out

    def tap(k: Column) -> tuple[Column, Column, Column]:
        at = F.greatest(F.lit(0.0), (k + 0.5) * scale - 0.5)
        low = F.floor(at).cast("int")
        return low, F.least(low + 1, F.lit(size - 1)), at - low

    def value(i: Column) -> Column:
        (r0, r1, v), (c0, c1, u) = tap(F.floor(i / out)), tap(i % out)
        at = lambda r, c: F.get(grid, r * size + c).cast("double")
        top = at(r0, c0) * (1 - u) + at(r0, c1) * u
        low = at(r1, c0) * (1 - u) + at(r1, c1) * u
        return top * (1 - v) + low * v

    return F.transform(F.sequence(F.lit(0), F.lit(out * out - 1)), value)


def normalised(value: Column, channel: int) -> Column:
    """An 8-bit channel value on the scale that the network was trained on."""
    return (value / 255.0 - IMAGE_MEAN[channel]) / IMAGE_STD[channel]


def blended(base: Column, mask: Column, alpha: float = 0.45) -> Column:
    """Mask over image in single precision, cut to a byte."""
    mix = F.lit(1 - alpha).cast("float") * base.cast("float") + F.lit(alpha).cast("float") * mask.cast("float")
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(mix))).cast("int")


def class_context(logits: DataFrame, pixels: int = 16, classes: int = 4) -> DataFrame:
    """For each tile and class, the softmax-weighted mean place of its pixels."""
    rows = logits.select("vec_id", F.posexplode(F.col("logits")).alias("k", "v"))
    e = F.exp(F.col("v").cast("double"))
    cells = rows.select("vec_id", F.floor(F.col("k") / pixels).cast("int").alias("class"), (F.col("k") % pixels).alias("p"), e.alias("e"))
    total = F.sum("e")
    return cells.groupBy("vec_id", "class").agg((F.sum(F.col("e") * (F.col("p") % 4)) / total).alias("col"), (F.sum(F.col("e") * F.floor(F.col("p") / 4)) / total).alias("row"))


def neighbours(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to each pixel (row, col) the number of its eight neighbours that are there, by an
    equi-join with the eight places around each pixel."""
    around = [F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]
    places = pixels.select(*keys, F.explode(F.array(*around)).alias("d"), "row", "col").select(*keys, (F.col("row") + F.col("d.r")).alias("row"), (F.col("col") + F.col("d.c")).alias("col"))
    counts = places.groupBy(*keys, "row", "col").agg(F.count("*").alias("degree"))
    return pixels.join(counts, [*keys, "row", "col"], "left").fillna(0, ["degree"])


def concave_vertices(rings: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Vertices that turn against their ring's orientation; the first is never tested."""
    ring = F.struct("xs", "ys", F.when(E.ring_area(F.col("xs"), F.col("ys")) > 0, 1).otherwise(-1).alias("sign"))

    def found(r: Column) -> Column:
        n = F.size(r["xs"])
        at = lambda axis, i: F.get(r[axis], (i + n) % n)

        def bends(i: Column) -> Column:
            cross = (at("xs", i) - at("xs", i - 1)) * (at("ys", i + 1) - at("ys", i)) - (at("ys", i) - at("ys", i - 1)) * (at("xs", i + 1) - at("xs", i))
            return r["sign"] * cross < -threshold

        return F.filter(F.sequence(F.lit(1), n - 1), bends)

    return rings.select("ring", E.let(ring, found).alias("concave"))


def quality(measured: DataFrame, key: str, width: str = "width_px") -> DataFrame:
    """Mean, mean absolute deviation and score of each key's widths."""
    means = measured.groupBy(key).agg(F.avg(width).alias("mean_width"), F.count("*").alias("total"), F.count(width).alias("valid"), F.collect_list(width).alias("w"))
    mae = F.aggregate("w", F.lit(0.0), lambda s, w: s + F.abs(w - F.col("mean_width"))) / F.col("valid")
    rel = F.when(F.col("valid") > 0, mae / F.greatest("mean_width", F.lit(1e-6))).otherwise(F.lit(float("inf")))
    ratio = F.col("valid") / F.col("total")
    rows = means.select(key, "mean_width", F.when(F.col("valid") > 0, mae).alias("mae"), rel.alias("rel_mae"), ratio.alias("valid_ratio"), "valid", "total")
    return rows.withColumn("score", F.when(F.col("valid") > 0, E.quality_score(F.col("rel_mae"), F.col("valid_ratio"))).otherwise(F.lit(-1e18)))


def narrow(measured: DataFrame, key: str, width: str = "width_px", pixel_m: float = PIXEL_M, low: float = 0.15, high: float = 0.65) -> DataFrame:
    """The narrow estimate of each key in pixels and metres; null without a finite width."""
    lists = measured.groupBy(key).agg(F.collect_list(width).alias("w"))
    kept = lists.select(key, E.narrow_widths(F.col("w"), low, high).alias("kept"))
    px = E.middle(F.col("kept"))
    return kept.select(key, px.alias("width_px"), E.metres(px, pixel_m).alias("width_m"), F.size("kept").alias("n_kept"))


def crosswalk_floor(estimates: DataFrame, least_m: float = 3.5, pixel_m: float = PIXEL_M) -> DataFrame:
    """Raises crossings to the least width; the measured values stay beside it."""
    low = F.col("width_m") < least_m
    return estimates.select(
        *[c for c in estimates.columns if c not in ("width_px", "width_m")],
        F.when(low, F.lit(least_m) / pixel_m).otherwise(F.col("width_px")).alias("width_px"), F.when(low, F.lit(least_m)).otherwise(F.col("width_m")).alias("width_m"),
        F.col("width_px").alias("algorithm_width_px"), F.col("width_m").alias("algorithm_width_m"),
    )


def shift_clusters(shifts: DataFrame, key: str, radius: float = 12.0, far: float = 240.0, step: float = 10.0, length_weight: float = 0.001) -> DataFrame:
    """Clusters of shifts (dx, dy, dot, distance) on a grid, with medians and a seed score.

    A cell's ``dx`` are sent as one flat list and its ``dy`` as another, 8 bytes each. Both keep
    the order of the rows, as the shifts of one cell have both numbers or all lack the same one.
    """
    cell = [F.rint(F.col("dx") / radius).cast("int").alias("kx"), F.rint(F.col("dy") / radius).cast("int").alias("ky")]
    groups = shifts.select("*", *cell).groupBy(key, "kx", "ky").agg(F.count("*").alias("n"), F.avg("dot").alias("dot"), F.avg("distance").alias("distance"), F.collect_list("dx").alias("xs"), F.collect_list("dy").alias("ys"))
    ordered = groups.withColumns({"in_x": F.sort_array("xs"), "in_y": F.sort_array("ys")})
    mids = ordered.withColumns({"mx": E.middle(F.col("in_x")), "my": E.middle(F.col("in_y"))})
    away = F.zip_with("xs", "ys", lambda x, y: F.sqrt(F.pow(x - F.col("mx"), F.lit(2.0)) + F.pow(y - F.col("my"), F.lit(2.0))))
    spread = mids.withColumn("away", F.sort_array(F.array_compact(away)))
    rows = spread.select(key, "kx", "ky", "mx", "my", "n", "dot", "distance", E.middle(F.col("away")).alias("std"), F.hypot("mx", "my").alias("length"))
    seed = F.col("n") * 2.0 + F.col("dot") * 5.0 - F.col("distance") / max(far, 1) - length_weight * F.col("length") - 0.05 * F.col("std") / max(step, 1)
    return rows.withColumn("seed", seed)


def top_candidates(clusters: DataFrame, key: str, most: int = 250, digits: int = 9) -> DataFrame:
    """The clusters of each key with the greatest seed scores, first cells first on ties."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round("seed", digits)), "kx", "ky")
    return clusters.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= most)


def axis_matches(edge_segments: DataFrame, axis_segments: DataFrame, key: str, far: float = 120.0, least_cos: float = 0.75, digits: int = 9) -> DataFrame:
    """For each key, how well its edge segments lie along axis segments.

    Both sides have (key, x0, y0, x1, y1), edges an ``i``, axes a ``j``. Each edge segment
    takes the best axis segment that is near and parallel enough. They meet in the cells of a
    grid, so what is far apart is never paired.
    """
    e = edge_segments.select(key, "i", *[F.col(c).alias(f"e{c}") for c in ("x0", "y0", "x1", "y1")])
    a = axis_segments.select(key, "j", *[F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")])
    mid = [[(F.col(f"e{c}0") + F.col(f"e{c}1")) / 2] for c in "xy"]
    ends = [[F.col(f"a{c}0"), F.col(f"a{c}1")] for c in "xy"]
    met = box_pairs(boxed(e, *mid, far + 1e-6), boxed(a, *ends), [key], max(far, 1.0))
    ex, ey = E.unit(F.col("ex1") - F.col("ex0"), F.col("ey1") - F.col("ey0"))
    dx, dy = F.col("ax1") - F.col("ax0"), F.col("ay1") - F.col("ay0")
    ax, ay = E.unit(dx, dy)
    mx, my = (F.col("ex0") + F.col("ex1")) / 2, (F.col("ey0") + F.col("ey1")) / 2
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((mx - F.col("ax0")) * dx + (my - F.col("ay0")) * dy) / (dx * dx + dy * dy)))
    dist = F.hypot(mx - F.col("ax0") - t * dx, my - F.col("ay0") - t * dy)
    pairs = met.select(key, "i", "j", F.round(F.abs(ex * ax + ey * ay), digits).alias("dot"), F.round(dist, digits).alias("distance")).where((F.col("dot") >= least_cos) & (F.col("distance") <= far))
    score = F.round(F.col("dot") * 10.0 - F.col("distance") / max(far, 1), digits)
    best = pairs.groupBy(key, "i").agg(F.max_by(F.struct("dot", "distance"), F.struct(score, -F.col("j"))).alias("b"))
    sizes = edge_segments.groupBy(key).agg(F.count("*").alias("n"))
    sums = best.groupBy(key).agg(F.count("*").alias("matched"), F.avg("b.dot").alias("mean_dot"), F.avg("b.distance").alias("mean_distance"))
    return sizes.join(sums, key, "left").select(key, (F.coalesce("matched", F.lit(0)) / F.col("n")).alias("coverage"), F.coalesce("mean_dot", F.lit(0.0)).alias("mean_dot"), "mean_distance")


def status_counts(results: DataFrame) -> DataFrame:
    """Edges with a width and without one; edges that gave no row aren't counted."""
    return results.agg(F.count_if(F.col("width_m").isNotNull()).alias("calculated"), F.count_if(F.col("width_m").isNull()).alias("failed"))


# The texts of statuses; one that isn't here is shown as it is.
STATUS_TEXT = {
    "no_polygon": "подходящий полигон не найден",
    "translated_edge_mostly_outside_polygon": "перенесённое ребро большей частью находится вне полигона",
    "no_measurements": "не удалось получить измерения ширины",
    "no_tiles": "для ребра не найдены тайлы",
    "no_results": "результат расчёта отсутствует",
}


def status_text(status: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in STATUS_TEXT.items() for v in pair])
    return F.coalesce(F.element_at(table, status), status)
