"""Queries over masks, rings, measurements and progress, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as E
from ..operators import measures as M
from ..operators import progress as P
from ..operators import tiles as T
from ..schema import PALETTE
from ..sources import graph
from . import fixtures as X
from .fixtures import using

QUERIES, ORACLE = {}, {}


def query(name: str, *needs: str, sql: str | None = None):
    """Registers a query with its SQL over the named fixtures."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = using(*needs, sql=sql) if needs else sql
        return f

    return add


@query("class_argmax", "classes", sql="SELECT vec_id, p, class FROM classes")
def class_argmax(spark, sf):
    return M.pixel_classes(X.logits(spark, sf)).select("vec_id", "p", "class")


@query("class_histogram", "classes", sql="SELECT x, class, count(*) AS n FROM classes GROUP BY 1, 2")
def class_histogram(spark, sf):
    return M.pixel_classes(X.logits(spark, sf)).groupBy("x", "class").agg(F.count("*").alias("n"))


_RGB = " ".join(f"WHEN {k} THEN [{r}, {g}, {b}]" for k, (r, g, b) in PALETTE.items())


@query("color_mask", "classes", sql=f"WITH c AS (SELECT vec_id, p, class, CASE class {_RGB} END AS rgb FROM classes) SELECT vec_id, p, CAST(rgb[1] AS INT) AS r, CAST(rgb[2] AS INT) AS g, CAST(rgb[3] AS INT) AS b, class AS back, class IN (0, 2) AS sidewalk FROM c")
def color_mask(spark, sf):
    """Colours of pixels, the class read back from them, and whether it is walkable."""
    r, g, b = M.colours(F.col("class"))
    rows = M.pixel_classes(X.logits(spark, sf)).select("vec_id", "p", r.alias("r"), g.alias("g"), b.alias("b"))
    back = M.colour_class(F.col("r"), F.col("g"), F.col("b"))
    return rows.select("*", back.alias("back"), back.isin(0, 2).alias("sidewalk"))


@query(
    "bilinear_upsample",
    sql="""WITH t AS (SELECT vec_id, k.class, embedding[k.class*16+1 : k.class*16+16] e, q.i, greatest(0.0, (i // 8 + 0.5)*0.5 - 0.5) v, greatest(0.0, (i % 8 + 0.5)*0.5 - 0.5) u FROM embeddings, (SELECT unnest(range(64)) i) q, (SELECT unnest(range(4)) class) k),
        s AS (SELECT *, CAST(floor(v) AS INT) r0, least(CAST(floor(v) AS INT) + 1, 3) r1, CAST(floor(u) AS INT) c0, least(CAST(floor(u) AS INT) + 1, 3) c1 FROM t)
        SELECT vec_id, CAST(class AS INT) AS class, CAST(i AS INT) AS i, round((CAST(e[r0*4+c0+1] AS DOUBLE)*(1-(u-c0)) + CAST(e[r0*4+c1+1] AS DOUBLE)*(u-c0))*(1-(v-r0)) + (CAST(e[r1*4+c0+1] AS DOUBLE)*(1-(u-c0)) + CAST(e[r1*4+c1+1] AS DOUBLE)*(u-c0))*(v-r0), 6) + 0.0 AS value FROM s""",
)
def bilinear_upsample(spark, sf):
    """Logits of all classes, from 4 by 4 to 8 by 8."""
    grids = F.array(*[M.upsampled(F.slice("logits", 16 * k + 1, 16), 4, 8) for k in range(4)])
    rows = X.logits(spark, sf).select("vec_id", F.posexplode(grids).alias("class", "grid")).select("vec_id", "class", F.posexplode("grid").alias("i", "v"))
    return rows.select("vec_id", "class", "i", (F.round("v", 6) + 0.0).alias("value"))


@query(
    "class_context",
    sql="""WITH c AS (SELECT vec_id, k // 16 AS class, k % 16 AS p, exp(CAST(embedding[k+1] AS DOUBLE)) AS e FROM embeddings, (SELECT unnest(range(64)) k) q)
        SELECT vec_id, CAST(class AS INT) AS class, round(sum(e*(p % 4))/sum(e), 6) AS col, round(sum(e*(p // 4))/sum(e), 6) AS row FROM c GROUP BY 1, 2""",
)
def class_context(spark, sf):
    return M.class_context(X.logits(spark, sf)).select("vec_id", "class", F.round("col", 6).alias("col"), F.round("row", 6).alias("row"))


@query(
    "row_reprojection",
    "edge_tiles",
    sql="""WITH g AS (SELECT ty, r, atan(sinh(pi()*(1-2*(ty*256 + r + 0.5)/268435456.0))) AS phi FROM (SELECT DISTINCT y AS ty FROM edge_tiles) a, (SELECT unnest(range(256)) r) b),
        y AS (SELECT *, (1 - ln(tan(pi()/4 + phi/2)*pow((1-0.0818191908426*sin(phi))/(1+0.0818191908426*sin(phi)), 0.0818191908426/2))/pi())/2*268435456.0 AS gy FROM g),
        s AS (SELECT *, min(CAST(floor(gy/256) AS BIGINT)) OVER (PARTITION BY ty) AS first_tile, max(CAST(floor(gy/256) AS BIGINT)) OVER (PARTITION BY ty) AS last_tile FROM y)
        SELECT ty, r, first_tile, last_tile, round(least(greatest(gy - first_tile*256 - 0.5, 0), (last_tile - first_tile + 1)*256 - 1), 3) AS source_row FROM s""",
)
def row_reprojection(spark, sf):
    """Which source rows each row of the network's tiles blends, between the two map projections."""
    tiles = T.edge_tiles(X.edges(spark, sf)).select(F.col("y").alias("ty")).distinct()
    rows = tiles.select("ty", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"))).alias("r"))
    gy = E.ellipsoidal_y(E.row_latitude(F.col("ty"), F.col("r"), 20), 20)
    w = Window.partitionBy("ty")
    tile = F.floor(F.col("gy") / 256)
    ext = rows.select("*", gy.alias("gy")).select("*", F.min(tile).over(w).alias("first_tile"), F.max(tile).over(w).alias("last_tile"))
    at = F.least(F.greatest(F.col("gy") - F.col("first_tile") * 256 - 0.5, F.lit(0.0)), (F.col("last_tile") - F.col("first_tile") + 1) * 256.0 - 1)
    return ext.select("ty", "r", "first_tile", "last_tile", F.round(at, 3).alias("source_row"))


@query("normalize_pixels", "classes", sql=f"WITH c AS (SELECT vec_id, p, CASE class {_RGB} END AS rgb FROM classes) SELECT vec_id, p, round((rgb[1]/255.0 - 0.485)/0.229, 6) AS r, round((rgb[2]/255.0 - 0.456)/0.224, 6) AS g, round((rgb[3]/255.0 - 0.406)/0.225, 6) AS b FROM c")
def normalize_pixels(spark, sf):
    rgb = M.colours(F.col("class"))
    rows = M.pixel_classes(X.logits(spark, sf))
    return rows.select("vec_id", "p", *[F.round(M.normalised(c, i), 6).alias(n) for i, (c, n) in enumerate(zip(rgb, "rgb"))])


_BLEND = ", ".join(f"CASE WHEN class = 3 THEN CAST({n}0 AS INT) ELSE CAST(least(255, greatest(0, floor(CAST(0.55 AS FLOAT)*CAST({n}0 AS FLOAT) + CAST(0.45 AS FLOAT)*CAST(rgb[{k}] AS FLOAT)))) AS INT) END AS {n}" for k, n in enumerate("rgb", 1))


@query(
    "overlay_blend",
    "classes",
    sql=f"""WITH c AS (SELECT vec_id, p, class, CASE class {_RGB} END AS rgb, (vec_id*37 + p*11) % 256 AS r0, (vec_id*37 + p*11 + 29) % 256 AS g0, (vec_id*37 + p*11 + 58) % 256 AS b0 FROM classes)
        SELECT vec_id, p, {_BLEND} FROM c""",
)
def overlay_blend(spark, sf):
    """Masks over a made image in all channels; black pixels of the mask stay as the image is."""
    rows = M.pixel_classes(X.logits(spark, sf))
    base = [((F.col("vec_id") * 37 + F.col("p") * 11 + 29 * k) % 256).cast("int") for k in range(3)]
    mixed = [F.when(F.col("class") == 3, b).otherwise(M.blended(b, c)).alias(n) for b, c, n in zip(base, M.colours(F.col("class")), "rgb")]
    return rows.select("vec_id", "p", *mixed)


@query(
    "mask_degree",
    "classes",
    sql="""WITH m AS (SELECT vec_id, p // 4 AS row, p % 4 AS col FROM classes WHERE class IN (0, 2))
        SELECT a.vec_id, a.row, a.col, count(b.vec_id) AS degree FROM m a LEFT JOIN m b ON a.vec_id = b.vec_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row, a.col) <> (b.row, b.col) GROUP BY 1, 2, 3""",
)
def mask_degree(spark, sf):
    rows = M.pixel_classes(X.logits(spark, sf)).where("class IN (0, 2)").select("vec_id", F.floor(F.col("p") / 4).alias("row"), (F.col("p") % 4).cast("long").alias("col"))
    return M.neighbours(rows, ["vec_id"])


_AREA = """areas AS (SELECT ring, CAST(sum(vx*ny - nx*vy) AS DOUBLE)/2.0 AS area FROM (SELECT *, coalesce(lead(vx) OVER w, first_value(vx) OVER w) nx, coalesce(lead(vy) OVER w, first_value(vy) OVER w) ny FROM ring_points WINDOW w AS (PARTITION BY ring ORDER BY i)) GROUP BY 1)"""


@query("ring_area", "ring_points", sql=f"WITH {_AREA} SELECT ring, area FROM areas")
def ring_area(spark, sf):
    return X.rings(spark, sf).select("ring", E.ring_area(F.col("xs"), F.col("ys")).alias("area"))


@query("ring_order", "ring_points", sql=f"WITH {_AREA}, big AS (SELECT * FROM areas WHERE area >= 100) SELECT ring % 100 AS feature, ring, row_number() OVER (PARTITION BY ring % 100 ORDER BY area DESC, ring) AS place FROM big")
def ring_order(spark, sf):
    """Rings of at least the least area, the largest of each feature first."""
    rows = X.rings(spark, sf).select("ring", (F.col("ring") % 100).alias("feature"), E.ring_area(F.col("xs"), F.col("ys")).alias("area")).where("area >= 100")
    w = Window.partitionBy("feature").orderBy(F.desc("area"), "ring")
    return rows.select("feature", "ring", F.row_number().over(w).alias("place"))


_CONCAVE = """turns AS (SELECT ring, i, vx, vy, (vx - px)*(ny - vy) - (vy - py)*(nx - vx) AS turn FROM
    (SELECT *, lag(vx) OVER w px, lag(vy) OVER w py, coalesce(lead(vx) OVER w, first_value(vx) OVER w) nx, coalesce(lead(vy) OVER w, first_value(vy) OVER w) ny FROM ring_points WINDOW w AS (PARTITION BY ring ORDER BY i)) WHERE i > 0)"""


@query("concave_vertices", "ring_points", sql=f"WITH {_CONCAVE} SELECT ring, CAST(i AS INT) AS i FROM turns WHERE turn < 0")
def concave_vertices(spark, sf):
    # the outer form: a plain explode would have the list computed once more, in a filter at the scan
    return M.concave_vertices(X.rings(spark, sf)).select("ring", F.explode_outer("concave").alias("i")).where("i IS NOT NULL")


@query("cut_pairs", "ring_points", sql=f"WITH {_CONCAVE}, c AS (SELECT ring, list(CAST(i AS INT) ORDER BY i) l FROM turns WHERE turn < 0 GROUP BY ring), p AS (SELECT ring, l, unnest(l) AS i FROM c) SELECT ring, i, unnest(list_filter(l, lambda b: b > i)) AS j FROM p")
def cut_pairs(spark, sf):
    """Pairs of concave vertices of one ring, the ends of candidate cuts."""
    pairs = F.flatten(F.transform("concave", lambda a: F.transform(F.filter("concave", lambda b: b > a), lambda b: F.struct(a.alias("i"), b.alias("j")))))
    return M.concave_vertices(X.rings(spark, sf)).select("ring", F.explode_outer(pairs).alias("p")).where("p IS NOT NULL").select("ring", "p.i", "p.j")


@query("measurement_filter", "measurements", sql="SELECT edge, count(*) AS n FROM measurements WHERE width_px IS NOT NULL AND i % 4 <> 0 GROUP BY 1")
def measurement_filter(spark, sf):
    """Every fourth measurement is no number or without bound."""
    broken = F.when(F.col("i") % 8 == 0, F.lit(float("nan"))).when(F.col("i") % 4 == 0, F.lit(float("inf"))).otherwise(F.col("width_px"))
    return X.measurements(spark, sf).select("edge", broken.alias("w")).where(E.finite(F.col("w"))).groupBy("edge").agg(F.count("*").alias("n"))


@query(
    "width_quality",
    "measurements",
    sql="""WITH m AS (SELECT edge, avg(width_px) AS mean_width, count(*) AS total, count(width_px) AS valid FROM measurements GROUP BY 1),
        d AS (SELECT edge, avg(abs(width_px - mean_width)) AS mae FROM measurements JOIN m USING (edge) GROUP BY 1)
        SELECT edge, round(mean_width, 6) AS mean_width, round(mae, 6) AS mae, round(valid/CAST(total AS DOUBLE), 6) AS valid_ratio, CAST(valid AS BIGINT) AS valid, CAST(total AS BIGINT) AS total,
        CASE WHEN valid = 0 THEN -1e18 ELSE round(-mae/greatest(mean_width, 1e-6) + 0.15*valid/total, 6) END AS score FROM m JOIN d USING (edge)""",
)
def width_quality(spark, sf):
    q = M.quality(X.measurements(spark, sf), "edge")
    return q.select("edge", *[F.round(c, 6).alias(c) for c in ("mean_width", "mae", "valid_ratio")], "valid", "total", F.round("score", 6).alias("score"))


_NARROW = """ws AS (SELECT edge, list_sort(list(width_px) FILTER (width_px IS NOT NULL)) AS w FROM measurements GROUP BY 1),
    lens AS (SELECT edge, coalesce(w, []) AS w, len(coalesce(w, [])) AS n FROM ws),
    ts AS (SELECT *, (n-1)*CAST(0.15 AS DOUBLE) AS p0, (n-1)*CAST(0.65 AS DOUBLE) AS p1 FROM lens),
    ends_ AS (SELECT *, w[CAST(floor(p0) AS INT)+1] AS a0, coalesce(w[CAST(floor(p0) AS INT)+2], w[CAST(floor(p0) AS INT)+1]) AS b0, p0 - floor(p0) AS t0,
        w[CAST(floor(p1) AS INT)+1] AS a1, coalesce(w[CAST(floor(p1) AS INT)+2], w[CAST(floor(p1) AS INT)+1]) AS b1, p1 - floor(p1) AS t1 FROM ts),
    qs AS (SELECT edge, w, n, CASE WHEN t0 >= 0.5 THEN b0 - (b0-a0)*(1-t0) ELSE a0 + (b0-a0)*t0 END AS q0, CASE WHEN t1 >= 0.5 THEN b1 - (b1-a1)*(1-t1) ELSE a1 + (b1-a1)*t1 END AS q1 FROM ends_),
    fs AS (SELECT edge, w, n, list_filter(w, lambda v: v >= q0 AND v <= q1) AS mid, list_filter(w, lambda v: v <= q1) AS low FROM qs),
    ks AS (SELECT edge, CASE WHEN n < 3 THEN w WHEN len(mid) >= 3 THEN mid WHEN len(low) >= 3 THEN low ELSE w[1:3] END AS k FROM fs),
    est AS (SELECT edge, CAST(len(k) AS INT) AS n_kept, CASE WHEN len(k) > 0 THEN (k[(len(k)-1)//2 + 1] + k[len(k)//2 + 1])/2.0 END AS width_px FROM ks),
    widths AS (SELECT *, round_even(width_px*CAST(0.08 AS DOUBLE)*100.0, 0)/100.0 AS width_m FROM est)"""


@query("narrow_width", "measurements", sql=f"WITH {_NARROW} SELECT edge, n_kept, width_px, width_m FROM widths")
def narrow_width(spark, sf):
    return M.narrow(X.measurements(spark, sf), "edge")


@query(
    "crosswalk_width",
    "measurements",
    sql=f"""WITH {_NARROW} SELECT edge, n_kept, CASE WHEN width_m < 3.5 THEN CAST(3.5 AS DOUBLE)/CAST(0.08 AS DOUBLE) ELSE width_px END AS width_px,
        CASE WHEN width_m < 3.5 THEN CAST(3.5 AS DOUBLE) ELSE width_m END AS width_m, width_px AS algorithm_width_px, width_m AS algorithm_width_m FROM widths""",
)
def crosswalk_width(spark, sf):
    return M.crosswalk_floor(M.narrow(X.measurements(spark, sf), "edge"))


_FEATURES = "SELECT o_orderkey % 1200 AS feature_idx, CASE WHEN max(o_orderkey) % 3 = 0 THEN 'abc' ELSE CAST(max(o_orderkey) % 50 AS VARCHAR) END AS Width FROM orders GROUP BY 1"


@query(
    "feature_width",
    "measurements",
    sql=f"""WITH {_NARROW}, f AS ({_FEATURES}), new AS (SELECT edge % 1000 AS feature_idx, round_even(median(width_m)*100.0, 0)/100.0 AS w FROM widths WHERE width_m IS NOT NULL GROUP BY 1)
        SELECT feature_idx, coalesce(w, try_cast(Width AS DOUBLE)) AS Width FROM f LEFT JOIN new USING (feature_idx)""",
)
def feature_width(spark, sf):
    """Medians of parts' widths on features that have a text column of that name."""
    k = F.col("k")
    feats = X.table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 1200).alias("feature_idx")).agg(F.max("o_orderkey").alias("k")).select("feature_idx", F.when(k % 3 == 0, "abc").otherwise((k % 50).cast("string")).alias("Width"))
    widths = M.narrow(X.measurements(spark, sf), "edge").select((F.col("edge") % 1000).alias("feature_idx"), "width_m")
    return graph.updated_features(feats, widths)


_STATUS = "CASE edge % 6 WHEN 0 THEN 'no_polygon' WHEN 1 THEN 'no_measurements' WHEN 2 THEN 'no_tiles' WHEN 3 THEN 'missing_images_or_labels' ELSE 'ok' END"


@query("status_counts", "measurements", sql=f"WITH {_NARROW} SELECT count(*) FILTER (width_m IS NOT NULL) AS calculated, count(*) FILTER (width_m IS NULL) AS failed FROM widths")
def status_counts(spark, sf):
    return M.status_counts(M.narrow(X.measurements(spark, sf), "edge"))


_TEXT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.STATUS_TEXT.items())


@query("status_texts", sql=f"WITH s AS (SELECT DISTINCT {_STATUS.replace('edge', 'o_orderkey')} AS status FROM orders) SELECT status, CASE status {_TEXT} ELSE status END AS text FROM s")
def status_texts(spark, sf):
    k = F.col("o_orderkey") % 6
    status = F.when(k == 0, "no_polygon").when(k == 1, "no_measurements").when(k == 2, "no_tiles").when(k == 3, "missing_images_or_labels").otherwise("ok")
    return X.table(spark, sf, "orders").select(status.alias("status")).distinct().select("status", M.status_text(F.col("status")).alias("text"))


_SHIFTS = """shifts AS (SELECT ring % 50 AS edge, CAST((ring*37 + i*53) % 97 - 48 AS DOUBLE) AS dx, CAST((ring*11 + i*29) % 89 - 44 AS DOUBLE) AS dy, 0.75 + CAST((ring + i) % 25 AS DOUBLE)/100.0 AS dot, CAST((ring*7 + i) % 240 AS DOUBLE)*CAST(0.987654321 AS DOUBLE) AS distance FROM ring_points),
    cells AS (SELECT *, CAST(round_even(dx/12.0, 0) AS INT) AS kx, CAST(round_even(dy/12.0, 0) AS INT) AS ky FROM shifts),
    mids AS (SELECT edge, kx, ky, median(dx) AS mx, median(dy) AS my, count(*) AS n, avg(dot) AS dot, avg(distance) AS distance FROM cells GROUP BY 1, 2, 3),
    stds AS (SELECT c.edge, c.kx, c.ky, median(sqrt((dx-mx)*(dx-mx) + (dy-my)*(dy-my))) AS std FROM cells c JOIN mids m USING (edge, kx, ky) GROUP BY 1, 2, 3),
    seeds AS (SELECT *, n*2.0 + dot*5.0 - distance/240.0 - 0.001*sqrt(mx*mx + my*my) - 0.05*std/10.0 AS seed FROM mids JOIN stds USING (edge, kx, ky))"""


def _shifts(spark, sf, edges=50, x=(97, 48), y=(89, 44)):
    rows = X.rings(spark, sf).select("ring", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    r, i = F.col("ring"), F.col("i")
    return rows.select((r % edges).alias("edge"), ((r * 37 + i * 53) % x[0] - x[1]).cast("double").alias("dx"), ((r * 11 + i * 29) % y[0] - y[1]).cast("double").alias("dy"), (F.lit(0.75) + ((r + i) % 25).cast("double") / 100.0).alias("dot"), (((r * 7 + i) % 240).cast("double") * 0.987654321).alias("distance"))


@query("shift_clusters", "ring_points", sql=f"WITH {_SHIFTS} SELECT edge, kx, ky, mx, my, n, round(std, 6) AS std, round(seed, 6) AS seed FROM seeds")
def shift_clusters(spark, sf):
    return M.shift_clusters(_shifts(spark, sf), "edge").select("edge", "kx", "ky", "mx", "my", "n", F.round("std", 6).alias("std"), F.round("seed", 6).alias("seed"))


#: So many shifts in so many cells that the most candidates of an edge are fewer than its clusters.
_WIDE = _SHIFTS.replace("% 97 - 48", "% 397 - 198").replace("% 89 - 44", "% 389 - 194").replace("ring % 50", "ring % 5")


@query("translation_topk", "ring_points", sql=f"WITH {_WIDE} SELECT edge, kx, ky, rank FROM (SELECT edge, kx, ky, row_number() OVER (PARTITION BY edge ORDER BY round(seed, 9) DESC, kx, ky) AS rank FROM seeds) WHERE rank <= 250")
def translation_topk(spark, sf):
    return M.top_candidates(M.shift_clusters(_shifts(spark, sf, 5, (397, 198), (389, 194)), "edge"), "edge").select("edge", "kx", "ky", "rank")


_LINES = """e AS (SELECT user_id AS key, event_id AS i, CAST((event_id*7919) % 997 AS DOUBLE) x0, CAST((event_id*10473) % 991 AS DOUBLE) y0, CAST((event_id*7919) % 997 + 3 + event_id % 7 AS DOUBLE) x1, CAST((event_id*10473) % 991 + event_id % 11 AS DOUBLE) y1 FROM events),
    a AS (SELECT o_custkey AS key, o_orderkey AS j, CAST((o_orderkey*37) % 900 AS DOUBLE) x0, CAST((o_orderkey*91) % 900 AS DOUBLE) y0, CAST((o_orderkey*37) % 900 + 20 + o_orderkey % 31 AS DOUBLE) x1, CAST((o_orderkey*91) % 900 + o_orderkey % 41 AS DOUBLE) y1 FROM orders)"""


@query(
    "axis_match",
    sql=f"""WITH {_LINES}, m AS (SELECT e.key, e.i, a.j, (e.x1-e.x0) AS ex, (e.y1-e.y0) AS ey, (a.x1-a.x0) AS dx, (a.y1-a.y0) AS dy, (e.x0+e.x1)/2 - a.x0 AS px, (e.y0+e.y1)/2 - a.y0 AS py FROM e JOIN a USING (key)),
        t AS (SELECT *, greatest(0.0, least(1.0, (px*dx + py*dy)/(dx*dx + dy*dy))) AS t FROM m),
        d AS (SELECT key, i, j, round(abs(ex*dx + ey*dy)/(sqrt(ex*ex + ey*ey)*sqrt(dx*dx + dy*dy)), 9) AS dot, round(sqrt((px-t*dx)*(px-t*dx) + (py-t*dy)*(py-t*dy)), 9) AS distance FROM t),
        b AS (SELECT key, i, dot, distance, row_number() OVER (PARTITION BY key, i ORDER BY round(dot*10.0 - distance/120.0, 9) DESC, j) AS place FROM d WHERE dot >= 0.75 AND distance <= 120)
        SELECT key, round(count(dot)/CAST(count(*) AS DOUBLE), 6) AS coverage, round(coalesce(avg(dot), 0.0), 6) AS mean_dot, round(avg(distance), 5) AS mean_distance FROM e LEFT JOIN (SELECT * FROM b WHERE place = 1) USING (key, i) GROUP BY 1""",
)
def axis_match(spark, sf):
    i, j = F.col("event_id"), F.col("o_orderkey")
    d = lambda c: c.cast("double")
    e = X.table(spark, sf, "events").select(F.col("user_id").alias("key"), i.alias("i"), d(i * 7919 % 997).alias("x0"), d(i * 10473 % 991).alias("y0"), d(i * 7919 % 997 + 3 + i % 7).alias("x1"), d(i * 10473 % 991 + i % 11).alias("y1"))
    a = X.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), j.alias("j"), d(j * 37 % 900).alias("x0"), d(j * 91 % 900).alias("y0"), d(j * 37 % 900 + 20 + j % 31).alias("x1"), d(j * 91 % 900 + j % 41).alias("y1"))
    return M.axis_matches(e, a, "key").select("key", F.round("coverage", 6).alias("coverage"), F.round("mean_dot", 6).alias("mean_dot"), F.round("mean_distance", 5).alias("mean_distance"))


_RANGES = " ".join(f"WHEN {i} THEN [{a}, {b}]" for i, (a, b) in enumerate(P.STAGE_RANGES.values()))


@query(
    "progress_events",
    sql=f"""WITH p AS (SELECT event_id, user_id, ts, event_id % 7 AS stage, least(greatest(0, event_id % 130 - 10), 100) / 100.0 AS part, CASE event_id % 7 {_RANGES} END AS r FROM events),
        o AS (SELECT *, CAST(r[1] AS DOUBLE) + CAST(r[2] - r[1] AS DOUBLE)*part AS overall FROM p)
        SELECT event_id, round(part*100.0, 6) AS stage_percent, round(overall, 6) AS overall, round(max(overall) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS shown FROM o""",
)
def progress_events(spark, sf):
    e = F.col("event_id")
    stage = F.element_at(F.array(*[F.lit(k) for k in P.STAGE_RANGES]), (e % 7 + 1).cast("int"))
    part, whole = P.overall_percent(stage, e % 130 - 10, F.lit(100))
    rows = X.table(spark, sf, "events").select("event_id", "user_id", "ts", part.alias("stage_percent"), whole.alias("overall"))
    shown = P.running_percent(rows, "user_id", ["ts", "event_id"], "overall")
    return shown.select("event_id", *[F.round(c, 6).alias(c) for c in ("stage_percent", "overall", "shown")])


_ETA = """good AS (SELECT * FROM (SELECT run, i, elapsed_us/1e6 AS elapsed, percent, max(percent) OVER b AS before FROM samples WINDOW b AS (PARTITION BY run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE before IS NULL OR percent > before + 1e-6),
    g AS (SELECT run, i, elapsed, percent, row_number() OVER (PARTITION BY run ORDER BY i) AS k FROM good),
    o AS (SELECT a.run, a.i, a.k, a.elapsed, a.percent, min(b.k) AS s FROM g a JOIN g b ON a.run = b.run AND b.k <= a.k AND b.k > a.k - 120 AND a.elapsed - b.elapsed <= 90 GROUP BY ALL),
    r AS (SELECT o.*, o.elapsed - g.elapsed AS dt, o.percent - g.percent AS dp, o.percent/greatest(o.elapsed, 1e-9) AS slow FROM o JOIN g ON o.run = g.run AND o.s = g.k),
    v AS (SELECT *, CASE WHEN dt >= 2 AND dp >= 0.05 THEN 0.7*(dp/dt) + 0.3*slow ELSE slow END AS rate FROM r),
    raws AS (SELECT run, i, k, percent, CASE WHEN percent >= 100 THEN 0.0 WHEN elapsed >= 4 AND percent >= 0.5 AND k >= 2 AND rate > 1e-9 THEN least(greatest((100-percent)/rate, 0), 604800.0) END AS raw FROM v)"""


@query(
    "eta_batch",
    "samples",
    sql=f"""WITH {_ETA}, f AS (SELECT run, i, k, raw, CAST(raw AS DOUBLE) AS eta FROM raws WHERE k = 1 UNION ALL
        SELECT n.run, n.i, n.k, n.raw, CASE WHEN n.percent >= 100 THEN 0.0 WHEN n.raw IS NULL THEN f.eta WHEN f.eta IS NULL THEN n.raw WHEN n.raw > f.eta THEN 0.35*n.raw + 0.65*f.eta ELSE 0.18*n.raw + 0.82*f.eta END
        FROM f JOIN raws n ON n.run = f.run AND n.k = f.k + 1)
        SELECT run, CAST(i AS INT) AS i, round(CASE WHEN raw IS NOT NULL THEN eta END, 4) AS eta FROM f""",
)
def eta_batch(spark, sf):
    s = X.samples(spark, sf).select("run", "i", (F.col("elapsed_us") / 1e6).alias("elapsed"), "percent")
    return P.remaining(s).select("run", "i", F.round("eta", 4).alias("eta"))


@query(
    "eta_pauses",
    sql="""WITH RECURSIVE r AS (SELECT user_id AS run, row_number() OVER o AS i, (epoch_us(ts) - min(epoch_us(ts)) OVER w) / 3.6e9 - CASE WHEN event_id % 10 = 0 THEN 5e0 ELSE 0e0 END AS e,
            CASE WHEN max(value) OVER w > 0 THEN value / max(value) OVER w * 100e0 ELSE 0e0 END AS p FROM events WINDOW w AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT run, i, greatest(0e0, e) AS elapsed, least(greatest(0e0, p), 100e0) AS percent FROM r),
        t AS (SELECT run, i, elapsed, percent, 1 AS k, true AS taken FROM s WHERE i = 1 UNION ALL
            SELECT run, i, CASE WHEN ok THEN e ELSE elapsed END, CASE WHEN ok THEN p ELSE percent END, k + CAST(ok AS INT), ok
            FROM (SELECT t.run, s.i, t.elapsed, t.percent, t.k, s.elapsed AS e, s.percent AS p, s.elapsed >= t.elapsed AND s.percent > t.percent + 1e-6 AS ok FROM t JOIN s ON s.run = t.run AND s.i = t.i + 1)),
        n AS (SELECT *, lead(elapsed) OVER (PARTITION BY run ORDER BY i) AS next FROM s),
        u AS (SELECT run, i, 0 AS tick, elapsed, percent FROM s UNION ALL
            SELECT run, i, m, elapsed + m*10e0, percent FROM (SELECT *, unnest(range(1, CAST(ceil((next - elapsed)/10) AS BIGINT) + 1)) AS m FROM n WHERE percent > 0 AND percent < 100 AND next > elapsed) WHERE elapsed + m*10e0 < next),
        a AS (SELECT u.*, t.k, row_number() OVER (PARTITION BY u.run ORDER BY u.i, u.tick) AS j FROM u JOIN t ON t.run = u.run AND t.i = u.i),
        g AS (SELECT run, k, elapsed, percent FROM t WHERE taken),
        f AS (SELECT a.run, a.j, min(CASE WHEN a.elapsed - g.elapsed <= 90 THEN g.k END) AS near, min(g.k) AS oldest FROM a JOIN g ON a.run = g.run AND g.k <= a.k AND g.k > a.k - 120 GROUP BY ALL),
        d AS (SELECT a.*, a.elapsed - g.elapsed AS dt, a.percent - g.percent AS dp, a.percent / greatest(a.elapsed, 1e-9) AS slow FROM a JOIN f ON a.run = f.run AND a.j = f.j JOIN g ON g.run = a.run AND g.k = coalesce(f.near, f.oldest)),
        v AS (SELECT *, CASE WHEN dt >= 2 AND dp >= 0.05 THEN 0.7e0*(dp/dt) + 0.3e0*slow ELSE slow END AS rate FROM d),
        raws AS (SELECT run, i, tick, j, elapsed, percent, CASE WHEN percent >= 100 THEN 0e0 WHEN elapsed >= 4 AND percent >= 0.5 AND k >= 2 AND rate > 1e-9 THEN least((100 - percent)/rate, 604800e0) END AS raw FROM v),
        x AS (SELECT run, i, tick, j, elapsed, raw, raw AS eta FROM raws WHERE j = 1 UNION ALL
            SELECT y.run, y.i, y.tick, y.j, y.elapsed, y.raw, CASE WHEN y.percent >= 100 THEN 0e0 WHEN y.raw IS NULL THEN x.eta WHEN x.eta IS NULL THEN y.raw WHEN y.raw > x.eta THEN 0.35e0*y.raw + 0.65e0*x.eta ELSE 0.18e0*y.raw + 0.82e0*x.eta END
            FROM x JOIN raws y ON y.run = x.run AND y.j = x.j + 1)
        SELECT run, CAST(i AS INT) AS i, CAST(tick AS INT) AS tick, round(elapsed, 6) AS elapsed, round(CASE WHEN raw IS NOT NULL THEN eta END, 4) AS eta FROM x""",
)
def eta_pauses(spark, sf):
    """What is shown after samples that rise, fall and go back in time, and every ten seconds
    between them; an hour of the events is a second."""
    ev = X.table(spark, sf, "events").select("user_id", "event_id", "ts", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    whole = Window.partitionBy("user_id")
    i = F.row_number().over(whole.orderBy("ts", "event_id"))
    elapsed = (F.col("us") - F.min("us").over(whole)) / 3.6e9 - F.when(F.col("event_id") % 10 == 0, 5.0).otherwise(0.0)
    top = F.max("value").over(whole)
    s = ev.select(F.col("user_id").alias("run"), i.alias("i"), elapsed.alias("elapsed"), F.when(top > 0, F.col("value") / top * 100.0).otherwise(0.0).alias("percent"))
    return P.remaining_shown(s, 10.0).select("run", "i", "tick", E.half_away(F.col("elapsed"), 6).alias("elapsed"), E.half_away(F.col("eta"), 4).alias("eta"))


@query(
    "duration_text",
    "samples",
    sql="""WITH s AS (SELECT event_id, CAST(elapsed_us // 1000000 AS BIGINT) AS s FROM samples) SELECT event_id, CASE WHEN s // 3600 > 0 THEN (s // 3600) || ' ч ' || lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0') || ' мин'
        WHEN s // 60 > 0 THEN (s // 60) || ' мин ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || ' сек' ELSE s || ' сек' END AS text FROM s""",
)
def duration_text(spark, sf):
    return X.samples(spark, sf).select("event_id", E.clock_text(F.col("elapsed_us") / 1000000).alias("text"))
