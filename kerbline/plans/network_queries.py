"""Queries over edges, tiles, files and stores, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as E
from ..operators import predict, stores, tiles
from ..sources import graph, tile_files
from ..sources.shared import shared_dir
from ..streaming import eta, states
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


def _tiles(spark, sf):
    return tiles.edge_tiles(X.edges(spark, sf))


def _missing(spark, sf):
    return X.missing(tiles.unique_tiles(_tiles(spark, sf))).select("z", "x", "y")


@query("graph_vertices", "vertices", sql="SELECT feature_idx, part_idx, event_id, lon, lat FROM vertices")
def graph_vertices(spark, sf):
    return X.vertices(spark, sf).select("feature_idx", "part_idx", "event_id", "lon", "lat")


@query("graph_edges", "points", sql="SELECT feature_idx, part_idx, count(*) AS n_vertices, arg_min(lon, i) AS first_lon, arg_max(lat, i) AS last_lat FROM points GROUP BY 1, 2")
def graph_edges(spark, sf):
    return X.edges(spark, sf).select("feature_idx", "part_idx", F.size("coords").cast("long").alias("n_vertices"), F.col("coords")[0]["lon"].alias("first_lon"), F.element_at("coords", -1)["lat"].alias("last_lat"))


@query("edge_bbox", "boxes", sql="SELECT feature_idx, part_idx, round(lo0, 6) AS lon_min, round(lo1, 6) AS lon_max, round(la0, 6) AS lat_min, round(la1, 6) AS lat_max FROM boxes")
def edge_bbox(spark, sf):
    return tiles.bounding_boxes(X.edges(spark, sf)).select("feature_idx", "part_idx", *[F.round(c, 6).alias(c) for c in ("lon_min", "lon_max", "lat_min", "lat_max")])


@query(
    "vertex_tile",
    "vertices",
    sql="""SELECT event_id, CAST(floor((lon+180.0)/360.0*1048576) AS BIGINT) AS x,
        CAST(floor((1.0-ln(tan(radians(lat))+1.0/cos(radians(lat)))/pi())/2.0*1048576) AS BIGINT) AS y FROM vertices""",
)
def vertex_tile(spark, sf):
    return X.vertices(spark, sf).select("event_id", F.floor(E.tile_x(F.col("lon"), 20)).alias("x"), F.floor(E.tile_y(F.col("lat"), 20)).alias("y"))


@query("position_filter", "vertices", sql="SELECT feature_idx, part_idx, count(*) AS n_valid FROM vertices WHERE event_id % 5 <> 0 GROUP BY 1, 2")
def position_filter(spark, sf):
    """Every fifth position has lost its latitude."""
    broken = X.vertices(spark, sf).groupBy("feature_idx", "part_idx").agg(F.collect_list(F.struct("lon", F.when(F.col("event_id") % 5 != 0, F.col("lat")).alias("lat"))).alias("coords"))
    return tiles.valid_positions(broken).select("feature_idx", "part_idx", F.size("coords").cast("long").alias("n_valid")).where("n_valid > 0")


@query("edge_tiles", "edge_tiles", sql="SELECT * FROM edge_tiles")
def edge_tiles(spark, sf):
    return _tiles(spark, sf)


@query("unique_tiles", "edge_tiles", sql="SELECT z, x, y, count(*) AS n_edges FROM edge_tiles GROUP BY 1, 2, 3")
def unique_tiles(spark, sf):
    return tiles.unique_tiles(_tiles(spark, sf))


@query("tile_edges", "edge_tiles", sql="SELECT z, x, y, string_agg(feature_idx || ':' || part_idx, ',' ORDER BY feature_idx, part_idx) AS edges FROM edge_tiles GROUP BY 1, 2, 3")
def tile_edges(spark, sf):
    named = F.transform("edges", lambda e: F.concat_ws(":", e["feature_idx"].cast("string"), e["part_idx"].cast("string")))
    return tiles.tile_index(_tiles(spark, sf)).select("z", "x", "y", F.array_join(named, ",").alias("edges"))


@query("missing_tiles", "missing", sql="SELECT * FROM missing")
def missing_tiles(spark, sf):
    """The anti-join of needed tiles and those that exist."""
    needed = tiles.unique_tiles(_tiles(spark, sf))
    there = needed.join(X.missing(needed).select("z", "x", "y"), ["z", "x", "y"], "left_anti")
    return tile_files.tile_source("local", found=there)(needed)


@query("source_missing_remote", "missing", sql="SELECT * FROM missing WHERE false")
def source_missing_remote(spark, sf):
    return tile_files.tile_source("remote", work_dir="cache")(_tiles(spark, sf))


@query("skipped_edges", "edge_tiles", "missing", sql="SELECT feature_idx, part_idx, count(*) AS n_missing, string_agg(x || '_' || y, ',' ORDER BY x, y) AS missing FROM edge_tiles JOIN missing USING (z, x, y) GROUP BY 1, 2")
def skipped_edges(spark, sf):
    out = tiles.skipped_edges(_tiles(spark, sf), _missing(spark, sf))
    named = F.transform("missing", lambda t: F.concat_ws("_", t["x"].cast("string"), t["y"].cast("string")))
    return out.select("feature_idx", "part_idx", F.size("missing").cast("long").alias("n_missing"), F.array_join(named, ",").alias("missing"))


@query("eligible_edges", "boxes", "edge_tiles", "missing", sql="SELECT feature_idx, part_idx, n AS n_vertices FROM boxes WHERE (feature_idx, part_idx) NOT IN (SELECT (feature_idx, part_idx) FROM edge_tiles JOIN missing USING (z, x, y))")
def eligible_edges(spark, sf):
    found = tiles.eligible_edges(X.edges(spark, sf), _tiles(spark, sf), _missing(spark, sf))
    return found.select("feature_idx", "part_idx", F.size("coords").cast("long").alias("n_vertices"))


@query("edge_completeness", "edge_tiles", "missing", sql="SELECT e.feature_idx, e.part_idx, count(*) AS n_tiles, count(m.x) AS n_missing, count(m.x) = 0 AS eligible FROM edge_tiles e LEFT JOIN missing m USING (z, x, y) GROUP BY 1, 2")
def edge_completeness(spark, sf):
    return tiles.completeness(X.edges(spark, sf), _tiles(spark, sf), _missing(spark, sf))


@query(
    "second_pass_filter",
    "edge_tiles",
    "missing",
    sql="""WITH late AS (SELECT DISTINCT z, x, y FROM edge_tiles WHERE (x*13 + y*7) % 499 = 0), gone AS (SELECT * FROM missing UNION SELECT * FROM late),
        lost AS (SELECT DISTINCT feature_idx, part_idx FROM edge_tiles JOIN gone USING (z, x, y))
        SELECT z, x, y, count(*) AS n_edges FROM edge_tiles WHERE (feature_idx, part_idx) NOT IN (SELECT (feature_idx, part_idx) FROM lost) GROUP BY 1, 2, 3""",
)
def second_pass_filter(spark, sf):
    """Tiles that are still needed once those found missing at either pass are out."""
    t = _tiles(spark, sf)
    late = t.where((F.col("x") * 13 + F.col("y") * 7) % 499 == 0).select("z", "x", "y")
    gone = _missing(spark, sf).unionByName(late).distinct()
    return tiles.unique_tiles(tiles.eligible_edges(t, t, gone))


def _files(spark, sf):
    """Tile files that exist, by rank of their candidate path."""
    ranks = F.explode(F.sequence(F.lit(0), F.lit(8))).alias("rank")
    return tiles.unique_tiles(_tiles(spark, sf)).select("z", "x", "y", ranks).where((F.col("x") * 7 + F.col("y") * 3 + F.col("rank") * 5) % 17 == 0)


_FILES = "files AS (SELECT DISTINCT z, x, y, rank FROM edge_tiles, (SELECT unnest(range(9)) rank) r WHERE (x*7 + y*3 + rank*5) % 17 = 0)"


@query(
    "tile_path_rank",
    "edge_tiles",
    sql=f"""WITH {_FILES}, best AS (SELECT z, x, y, min(rank) rank FROM files GROUP BY ALL)
        SELECT z, x, y, CASE coalesce(rank, 0) % 3 WHEN 0 THEN x || '_' || y WHEN 1 THEN z || '/' || x || '/' || y ELSE z || '/' || x || '_' || y END
        || ['.jpg', '.jpeg', '.png'][coalesce(rank, 0) // 3 + 1] AS path, CASE WHEN rank IS NULL THEN 'missing' ELSE 'direct' END AS status
        FROM (SELECT DISTINCT z, x, y FROM edge_tiles) t LEFT JOIN best USING (z, x, y)""",
)
def tile_path_rank(spark, sf):
    return tiles.tile_paths(_tiles(spark, sf), _files(spark, sf))


@query(
    "label_completeness",
    "edge_tiles",
    sql="""SELECT feature_idx, part_idx, count(*) AS n_tiles, count(*) FILTER (ext IS NULL) AS n_missing, min(ext) AS least_ext
        FROM (SELECT *, CASE WHEN (x*31 + y*17) % 97 = 0 THEN NULL WHEN (x + y) % 3 = 0 THEN '.png' WHEN (x + y) % 3 = 1 THEN '.jpg' ELSE '.jpeg' END ext FROM edge_tiles) GROUP BY 1, 2""",
)
def label_completeness(spark, sf):
    """Labels in one or two of the extensions; the first in order counts."""
    t = _tiles(spark, sf)
    u = tiles.unique_tiles(t).where((F.col("x") * 31 + F.col("y") * 17) % 97 != 0)
    kind = (F.col("x") + F.col("y")) % 3
    exts = F.when(kind == 0, F.array(F.lit(".jpeg"), F.lit(".png"))).when(kind == 1, F.array(F.lit(".jpg"), F.lit(".jpeg"))).otherwise(F.array(F.lit(".jpeg")))
    labels = u.select("z", "x", "y", F.explode(exts).alias("ext"))
    found = tile_files.label_paths(t, labels)
    return found.groupBy("feature_idx", "part_idx").agg(F.count("*").alias("n_tiles"), F.count_if(F.col("ext").isNull()).alias("n_missing"), F.min("ext").alias("least_ext"))


@query("image_items", "edge_tiles", "missing", sql="SELECT z, x, y, x || '_' || y AS label_stem, x || '_' || y || '.jpg' AS path FROM (SELECT DISTINCT z, x, y FROM edge_tiles) WHERE (z, x, y) NOT IN (SELECT (z, x, y) FROM missing) AND (x + y) % 4 <> 0")
def image_items(spark, sf):
    """Images still to predict: there, and without a mask yet."""
    u = tiles.unique_tiles(_tiles(spark, sf)).select("z", "x", "y")
    done = u.where((F.col("x") + F.col("y")) % 4 == 0)
    stem = F.concat_ws("_", F.col("x").cast("string"), F.col("y").cast("string"))
    left = u.join(_missing(spark, sf), ["z", "x", "y"], "left_anti").join(done, ["z", "x", "y"], "left_anti")
    return tile_files.images(left.select("*", stem.alias("label_stem"), F.concat(stem, F.lit(".jpg")).alias("path")))


@query("tile_urls", "edge_tiles", sql="SELECT DISTINCT z, x, y, 'tiles?l=sat&x=' || x || '&y=' || y || '&z=' || z AS url FROM edge_tiles")
def tile_urls(spark, sf):
    u = tiles.unique_tiles(_tiles(spark, sf))
    return u.select("z", "x", "y", tiles.tile_url("tiles?l=sat&x={x}&y={y}&z={z}", F.col("z"), F.col("x"), F.col("y")).alias("url"))


_LATEST = "latest AS (SELECT x, y, arg_max(status, (updated_at, event_id)) AS status, arg_max(updated_at, (updated_at, event_id)) AS updated_at, arg_max(event_id, (updated_at, event_id)) AS event_id FROM cache_log GROUP BY 1, 2)"


@query("cache_latest", "cache_log", sql=f"WITH {_LATEST} SELECT x, y, status, event_id FROM latest")
def cache_latest(spark, sf):
    return stores.latest(X.cache_log(spark, sf), ["x", "y"], ["updated_at", "event_id"]).select("x", "y", "status", "event_id")


@query(
    "cache_lookup_ttl",
    "cache_log",
    sql=f"""WITH {_LATEST}, wanted AS (SELECT x, unnest(range(9)) y FROM (SELECT DISTINCT x FROM cache_log))
        SELECT x, y, CASE WHEN status = 1 THEN 'ok' WHEN status = 2 AND updated_at >= (SELECT max(updated_at) FROM cache_log) - INTERVAL 24 HOUR THEN 'missing' ELSE 'absent' END AS state
        FROM wanted LEFT JOIN latest USING (x, y)""",
)
def cache_lookup_ttl(spark, sf):
    log = X.cache_log(spark, sf)
    wanted = log.select("x").distinct().select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("y"))
    now = log.agg(F.max("updated_at")).scalar()
    return stores.lookup(stores.latest(log, ["x", "y"], ["updated_at", "event_id"]), wanted, ["x", "y"], now).select("x", "y", "state")


_ANSWERS = """WITH rows_ AS (SELECT x, y, updated_at, event_id AS number, status FROM cache_log UNION ALL SELECT x, event_id*3 % 7, updated_at, event_id, NULL FROM cache_log),
    seen AS (SELECT *, last_value(status IGNORE NULLS) OVER w AS last, last_value(CASE WHEN status IS NOT NULL THEN updated_at END IGNORE NULLS) OVER w AS since FROM rows_
        WINDOW w AS (PARTITION BY x, y ORDER BY updated_at, number, status IS NULL ROWS UNBOUNDED PRECEDING))
    SELECT x, y, number, CASE WHEN last = 1 THEN 'ok' WHEN last = 2 AND updated_at <= since + INTERVAL 24 HOUR THEN 'missing' ELSE 'absent' END AS state FROM seen WHERE status IS NULL"""


def _asked(log):
    """Each row of the log asks for another tile at the same time."""
    return log.select("x", (F.col("event_id") * 3 % 7).alias("y"), F.col("updated_at").cast("timestamp").alias("at"), F.col("event_id").alias("number"))


def _told(log):
    return log.select("x", "y", F.col("updated_at").cast("timestamp").alias("at"), F.col("event_id").alias("number"), F.col("status").cast("int").alias("status"))


@query("cache_answers", "cache_log", sql=_ANSWERS)
def cache_answers(spark, sf):
    """What the cache said to each question when it was asked."""
    log = X.cache_log(spark, sf)
    return stores.answered(_told(log), _asked(log), ["x", "y"]).select("x", "y", "number", "state")


@query("cache_answers_stream", "cache_log", sql=_ANSWERS)
def cache_answers_stream(spark, sf):
    """The same from a stream of the events, in which missing tiles are state that ages."""
    log = X.cache_log_of(eta.file_stream(spark, sf, "events"))
    rows = _told(log).unionByName(_asked(log).withColumn("status", F.lit(None).cast("int")))
    out = eta.replayed(spark, states.answered_stream(rows, ["x", "y"]), shared_dir(spark) + "/answers", once=True)
    return out.select("x", "y", "number", "state")


@query("cache_violations", "cache_log", sql="SELECT event_id, x, y, status FROM cache_log WHERE (status = 1) <> (event_id % 10 <> 0)")
def cache_violations(spark, sf):
    """Every tenth row has no content."""
    log = X.cache_log(spark, sf).withColumn("content", F.when(F.col("event_id") % 10 != 0, F.lit("jpg")))
    return stores.violations(log).select("event_id", "x", "y", "status")


@query("cache_deleted", "cache_log", sql="SELECT x, y, count(*) AS n FROM cache_log WHERE NOT (x % 3 = 0 AND y = 2) GROUP BY 1, 2")
def cache_deleted(spark, sf):
    log = X.cache_log(spark, sf)
    return stores.deleted(log, ["x", "y"], log.where("x % 3 = 0 AND y = 2")).groupBy("x", "y").agg(F.count("*").alias("n"))


_FETCH = """fetched AS (SELECT user_id AS x, event_id % 7 AS y, event_id, ts, CASE event_id % 8 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 403 ELSE 200 END AS http,
    CASE WHEN event_id % 11 = 0 THEN 'text/html' ELSE 'image/jpeg' END AS kind, event_id % 13 <> 0 AS decodable FROM events),
    outcomes AS (SELECT *, CASE WHEN http = 404 THEN 'missing' WHEN http = 200 AND kind LIKE 'image/%' AND decodable THEN 'ok' ELSE 'failed' END AS outcome FROM fetched)"""


def _fetched(spark, sf):
    e = F.col("event_id")
    http = F.when(e % 8 == 0, 404).when(e % 8 == 1, 429).when(e % 8 == 2, 503).when(e % 8 == 3, 403).otherwise(200)
    kind = F.when(e % 11 == 0, "text/html").otherwise("image/jpeg")
    return X.table(spark, sf, "events").select(F.col("user_id").alias("x"), (e % 7).alias("y"), "event_id", "ts", tiles.fetch_outcome(http, kind, e % 13 != 0).alias("outcome"))


@query("fetch_outcome", sql=f"WITH {_FETCH} SELECT event_id, outcome FROM outcomes")
def fetch_outcome(spark, sf):
    return _fetched(spark, sf).select("event_id", "outcome")


@query(
    "run_failed_set",
    sql=f"""WITH {_FETCH} SELECT event_id, coalesce(max(CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END) OVER
        (PARTITION BY x, y ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS failed_before FROM outcomes""",
)
def run_failed_set(spark, sf):
    return stores.failed_before(_fetched(spark, sf), ["x", "y"], ["ts", "event_id"], F.col("outcome") == "failed").select("event_id", "failed_before")


@query(
    "cache_prepare_actions",
    "edge_tiles",
    "cache_log",
    sql=f"""WITH {_LATEST}, {_FILES}, u AS (SELECT DISTINCT z, x, y FROM edge_tiles),
        local AS (SELECT DISTINCT z, x, y FROM files), cached AS (SELECT u.z, u.x, u.y, l.status FROM u JOIN latest l ON u.x % 50 = l.x AND u.y % 7 = l.y)
        SELECT CASE WHEN local.x IS NOT NULL THEN 'direct' WHEN status = 1 THEN 'skipped' WHEN status = 2 THEN 'missing' ELSE 'downloaded' END AS action, count(*) AS n
        FROM u LEFT JOIN local USING (z, x, y) LEFT JOIN cached USING (z, x, y) GROUP BY 1""",
)
def cache_prepare_actions(spark, sf):
    u = tiles.unique_tiles(_tiles(spark, sf)).select("z", "x", "y")
    last = stores.latest(X.cache_log(spark, sf), ["x", "y"], ["updated_at", "event_id"]).select(F.col("x").alias("cx"), F.col("y").alias("cy"), "status")
    cached = u.join(last, (F.col("x") % 50 == F.col("cx")) & (F.col("y") % 7 == F.col("cy")))
    return tiles.cache_actions(u, _files(spark, sf).select("z", "x", "y").distinct(), cached).groupBy("action").agg(F.count("*").alias("n"))


@query("run_key", sql="SELECT o_orderkey, sha256('v1|' || o_orderkey || '|' || o_custkey || '|20|64|256') AS run_key FROM orders")
def run_key(spark, sf):
    key = stores.run_key(F.lit("v1"), F.col("o_orderkey"), F.col("o_custkey"), F.lit(20), F.lit(64), F.lit(256))
    return X.table(spark, sf, "orders").select("o_orderkey", key.alias("run_key"))


_DONE = """done AS (SELECT l_orderkey % 1000 AS feature_idx, l_orderkey // 1000 AS part_idx, max(l_quantity*3.0) AS width_px FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)"""


def _done(spark, sf):
    k = F.col("l_orderkey")
    rows = X.table(spark, sf, "lineitem").where("l_returnflag = 'A'").select((k % 1000).alias("feature_idx"), F.floor(k / 1000).alias("part_idx"), (F.col("l_quantity") * 3.0).alias("width_px"))
    return rows.groupBy("feature_idx", "part_idx").agg(F.max("width_px").alias("width_px"))


@query("checkpoint_resume", sql=f"WITH {_DONE} SELECT o_orderkey % 1000 AS feature_idx, o_orderkey // 1000 AS part_idx, width_px, width_px IS NOT NULL AS cached FROM orders LEFT JOIN done ON o_orderkey % 1000 = feature_idx AND o_orderkey // 1000 = part_idx")
def checkpoint_resume(spark, sf):
    k = F.col("o_orderkey")
    wanted = X.table(spark, sf, "orders").select((k % 1000).alias("feature_idx"), F.floor(k / 1000).alias("part_idx"))
    return stores.resumed(wanted, _done(spark, sf), ["feature_idx", "part_idx"])


@query("checkpoint_count", sql=f"WITH {_DONE} SELECT part_idx, count(*) AS n FROM done GROUP BY 1")
def checkpoint_count(spark, sf):
    return _done(spark, sf).groupBy("part_idx").agg(F.count("*").alias("n"))


_EXT = "ext AS (SELECT feature_idx, part_idx, min(x) min_x, max(x) max_x, min(y) min_y, max(y) max_y FROM edge_tiles GROUP BY 1, 2)"


@query("mosaic_extent", "edge_tiles", sql=f"WITH {_EXT} SELECT *, (max_x - min_x + 1)*256 AS width, (max_y - min_y + 1)*256 AS height FROM ext")
def mosaic_extent(spark, sf):
    return tiles.mosaic_extents(_tiles(spark, sf))


_PIXEL = f"""{_EXT}, px AS (SELECT p.*, width, height, ((lon+180.0)/360.0*1048576 - min_x)*256 AS px,
    ((1.0-ln(tan(radians(lat))+1.0/cos(radians(lat)))/pi())/2.0*1048576 - min_y)*256 AS py
    FROM points p JOIN (SELECT *, (max_x - min_x + 1)*256 AS width, (max_y - min_y + 1)*256 AS height FROM ext) USING (feature_idx, part_idx))"""


def _pixels(spark, sf):
    return tiles.pixel_points(X.numbered_vertices(spark, sf), tiles.mosaic_extents(_tiles(spark, sf)))


@query("pixel_edges", "points", "edge_tiles", sql=f"WITH {_PIXEL} SELECT feature_idx, part_idx, i, round(px, 3) AS px, round(py, 3) AS py FROM px")
def pixel_edges(spark, sf):
    return _pixels(spark, sf).select("feature_idx", "part_idx", "i", F.round("px", 3).alias("px"), F.round("py", 3).alias("py"))


#: The window over which segments are clipped: metres of longitude and latitude, as integers.
_RECT = (300, 300, 700, 700)
_SEGMENTS = """segs AS (SELECT feature_idx, part_idx, i, (event_id*7919) % 997 AS x0, (event_id*10473) % 991 AS y0,
    lead((event_id*7919) % 997) OVER w AS x1, lead((event_id*10473) % 991) OVER w AS y1 FROM points WINDOW w AS (PARTITION BY feature_idx, part_idx ORDER BY i))"""


def _segments(spark, sf):
    v = X.vertices(spark, sf)
    w = Window.partitionBy("feature_idx", "part_idx").orderBy("ts", "event_id")
    x, y = (F.col("event_id") * 7919) % 997, (F.col("event_id") * 10473) % 991
    rows = v.select("feature_idx", "part_idx", (F.row_number().over(w) - 1).alias("i"), x.alias("x0"), y.alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"))
    return rows.where("x1 IS NOT NULL")


@query(
    "rect_clip",
    "points",
    sql=f"""WITH {_SEGMENTS}, t AS (SELECT *, CASE WHEN x1 = x0 THEN 0 ELSE least((300-x0)/CAST(x1-x0 AS DOUBLE), (700-x0)/CAST(x1-x0 AS DOUBLE)) END ax,
        CASE WHEN x1 = x0 THEN 1 ELSE greatest((300-x0)/CAST(x1-x0 AS DOUBLE), (700-x0)/CAST(x1-x0 AS DOUBLE)) END bx,
        CASE WHEN y1 = y0 THEN 0 ELSE least((300-y0)/CAST(y1-y0 AS DOUBLE), (700-y0)/CAST(y1-y0 AS DOUBLE)) END ay,
        CASE WHEN y1 = y0 THEN 1 ELSE greatest((300-y0)/CAST(y1-y0 AS DOUBLE), (700-y0)/CAST(y1-y0 AS DOUBLE)) END by_ FROM segs WHERE x1 IS NOT NULL)
        SELECT feature_idx, part_idx, i, (x1 <> x0 OR x0 BETWEEN 300 AND 700) AND (y1 <> y0 OR y0 BETWEEN 300 AND 700) AND greatest(0, ax, ay) <= least(1, bx, by_) AS hits FROM t""",
)
def rect_clip(spark, sf):
    s = _segments(spark, sf)
    return s.select("feature_idx", "part_idx", "i", E.clip_hits(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")], _RECT).alias("hits"))


@query("segments", "points", sql=f"WITH {_SEGMENTS} SELECT feature_idx, part_idx, i, x0, y0, x1, y1 FROM segs WHERE x1 IS NOT NULL")
def segments(spark, sf):
    return _segments(spark, sf)


_UNIT = "u AS (SELECT *, sqrt(CAST((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) AS DOUBLE)) AS len FROM segs WHERE x1 IS NOT NULL)"


@query("direction", "points", sql=f"WITH {_SEGMENTS}, {_UNIT} SELECT feature_idx, part_idx, i, round((x1-x0)/nullif(len, 0), 6) + 0.0 AS ux, round((y1-y0)/nullif(len, 0), 6) + 0.0 AS uy FROM u")
def direction(spark, sf):
    ux, uy = E.unit((F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double"))
    return _segments(spark, sf).select("feature_idx", "part_idx", "i", (F.round(ux, 6) + 0.0).alias("ux"), (F.round(uy, 6) + 0.0).alias("uy"))


@query("segment_ops", "points", sql=f"WITH {_SEGMENTS}, {_UNIT} SELECT feature_idx, part_idx, i, round(x0 - 5*(x1-x0)/len, 6) AS ext_x0, round(y1 + 5*(y1-y0)/len, 6) AS ext_y1, CAST(x0 + 12.5 AS DOUBLE) AS moved_x, CAST(y0 - 7.5 AS DOUBLE) AS moved_y FROM u WHERE len > 0")
def segment_ops(spark, sf):
    """A segment extended by 5 at both ends, and moved."""
    ux, uy = E.unit((F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double"))
    rows = _segments(spark, sf).where(ux.isNotNull())
    return rows.select("feature_idx", "part_idx", "i", F.round(F.col("x0") - 5 * ux, 6).alias("ext_x0"), F.round(F.col("y1") + 5 * uy, 6).alias("ext_y1"), (F.col("x0") + F.lit(12.5)).cast("double").alias("moved_x"), (F.col("y0") - F.lit(7.5)).cast("double").alias("moved_y"))


@query(
    "densify",
    "points",
    sql=f"""WITH {_SEGMENTS}, {_UNIT} SELECT feature_idx, part_idx, i, CAST(k AS BIGINT) AS k, round(x0 + (x1-x0)*least(k*100.0, len)/len, 5) AS x, round(y0 + (y1-y0)*least(k*100.0, len)/len, 5) AS y
        FROM u, LATERAL (SELECT unnest(range(0, CAST(floor((len + 1e-6)/100.0) AS BIGINT) + CASE WHEN floor((len + 1e-6)/100.0)*100.0 < len THEN 2 ELSE 1 END)) k) q WHERE len > 0""",
)
def densify(spark, sf):
    """Points each 100 along every segment, and its end."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    s = _segments(spark, sf).withColumn("len", F.sqrt((dx * dx + dy * dy).cast("double"))).where("len > 0")
    steps = F.floor((F.col("len") + 1e-6) / 100.0)
    n = steps + F.when(steps * 100.0 < F.col("len"), 1).otherwise(0)
    rows = s.select("*", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("k"))
    on = lambda start, d: F.round(F.col(start) + d * F.least(F.col("k") * 100.0, F.col("len")) / F.col("len"), 5)
    return rows.select("feature_idx", "part_idx", "i", "k", on("x0", dx).alias("x"), on("y0", dy).alias("y"))


@query("longest_part", "points", sql=f"WITH {_SEGMENTS}, {_UNIT}, parts AS (SELECT feature_idx, part_idx, round(sum(len), 6) AS length FROM u GROUP BY 1, 2) SELECT feature_idx, arg_max(part_idx, (length, -part_idx)) AS part_idx, max(length) AS length FROM parts GROUP BY 1")
def longest_part(spark, sf):
    """The longest part of each feature, the first on ties."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    parts = _segments(spark, sf).groupBy("feature_idx", "part_idx").agg(F.round(F.sum(F.sqrt((dx * dx + dy * dy).cast("double"))), 6).alias("length"))
    return parts.groupBy("feature_idx").agg(F.max_by("part_idx", F.struct("length", -F.col("part_idx"))).alias("part_idx"), F.max("length").alias("length"))


@query("geojson_roundtrip", "points", sql="SELECT CAST(feature_idx AS BIGINT) AS name, part AS part_idx, i, lon, lat FROM (SELECT feature_idx, dense_rank() OVER (PARTITION BY feature_idx ORDER BY part_idx) - 1 AS part, i, lon, lat FROM points)")
def geojson_roundtrip(spark, sf):
    """Edges written as GeoJSON text, then read as a collection for each feature."""
    e = X.edges(spark, sf).withColumn("properties", F.to_json(F.struct(F.col("feature_idx").alias("name"))))
    text = graph.feature_text(e)
    whole = text.select(F.concat(F.lit('{"type":"FeatureCollection","crs":{"properties":{"name":"urn:ogc:def:crs:EPSG::4326"}},"features":['), F.col("feature"), F.lit("]}")).alias("text"))
    back = graph.edges(graph.features(whole))
    name = F.get_json_object("properties", "$.name").cast("long")
    return back.select(name.alias("name"), F.col("part_idx").cast("long").alias("part_idx"), F.posexplode("coords").alias("i", "c")).select("name", "part_idx", "i", "c.lon", "c.lat")


@query(
    "first_success",
    sql="""SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS first_ok, CAST(arg_min(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS DOUBLE) AS price FROM orders GROUP BY 1""",
)
def first_success(spark, sf):
    """The first result that succeeded of each key, with its value as a number or null."""
    o = X.table(spark, sf, "orders")
    ok = F.when(F.col("o_orderstatus") == "F", F.struct("o_orderdate", "o_orderkey"))
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", ok).alias("first_ok"), F.min_by(F.col("o_totalprice").cast("double"), ok).alias("price"))


@query(
    "key_match",
    sql="""WITH ck AS (SELECT p_partkey, replace(replace(replace(k, 'model.', ''), 'backbone.', ''), 'module.', '') AS clean, k FROM
        (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'module.' WHEN 1 THEN 'model.backbone.' ELSE '' END || 'l' || (p_partkey % 40) || '.w' AS k FROM part)),
        mk AS (SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 2 = 0 THEN 'net.' ELSE '' END || 'l' || (s_suppkey % 30) || '.w' AS name FROM supplier)
        SELECT p_partkey, k AS key, coalesce(min(CASE WHEN name = clean THEN name END), arg_min(name, pos) FILTER (name LIKE '%' || clean)) AS matched
        FROM ck LEFT JOIN mk ON name LIKE '%' || clean GROUP BY 1, 2""",
)
def key_match(spark, sf):
    """Checkpoint keys matched to model keys, made from parts and suppliers."""
    p = F.col("p_partkey")
    prefix = F.when(p % 3 == 0, "module.").when(p % 3 == 1, "model.backbone.").otherwise("")
    key = F.concat(prefix, F.lit("l"), (p % 40).cast("string"), F.lit(".w"))
    ck = X.table(spark, sf, "part").select("p_partkey", key.alias("key"))
    s = F.col("s_suppkey")
    name = F.concat(F.when(s % 2 == 0, "net.").otherwise(""), F.lit("l"), (s % 30).cast("string"), F.lit(".w"))
    mk = X.table(spark, sf, "supplier").select(s.alias("pos"), name.alias("name"))
    return predict.match_keys(ck, mk).select("p_partkey", "key", "matched")
