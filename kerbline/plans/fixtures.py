"""Network, tile, mask and measurement tables derived from the driver tables.

Each has a Spark form and the same rows as DuckDB SQL (``SQL``), for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("feature_idx"),
        (F.dayofmonth("ts") % 3).alias("part_idx"),
        "event_id",
        "ts",
        ((37500000 + F.col("user_id") * 200 + (F.col("event_id") * 7919) % 997).cast("double") / 1000000.0).alias("lon"),
        ((55700000 + F.col("user_id") * 100 + (F.col("event_id") * 10473) % 991).cast("double") / 1000000.0).alias("lat"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of at least two vertices, with ``coords`` in order of time."""
    point = F.struct("ts", "event_id", "lon", "lat")
    grouped = vertices(spark, sf_dir).groupBy("feature_idx", "part_idx").agg(F.array_sort(F.collect_list(point)).alias("p"))
    return grouped.where(F.size("p") >= 2).select("feature_idx", "part_idx", F.transform("p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("coords"))


def numbered_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of edges, a row each, with ``i`` from 0."""
    return edges(spark, sf_dir).select("feature_idx", "part_idx", F.posexplode("coords").alias("i", "c")).select("feature_idx", "part_idx", "i", "c.lon", "c.lat")


def missing(tiles: DataFrame) -> DataFrame:
    return tiles.where((F.col("x") * 31 + F.col("y") * 17) % 997 == 0)


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: tile x, y and 64 logits, class-major on a 4 by 4 grid."""
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 25).alias("x"), F.floor(F.col("vec_id") / 25).alias("y"), "vec_id", F.col("embedding").alias("logits"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("edge"),
        F.row_number().over(w).alias("i"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity") * 3.0).alias("width_px"),
    )


def cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_log_of(table(spark, sf_dir, "events"))


def cache_log_of(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("x"), (F.col("event_id") % 7).alias("y"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("status"), F.col("ts").alias("updated_at"), "event_id")


#: The eight directions of a ring's vertices.
RING_X, RING_Y = (2, 2, 0, -2, -2, -2, 0, 2), (0, 2, 2, 2, 0, -2, -2, -2)


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star-shaped rings as arrays ``xs, ys`` of eight vertices, with ``ring``."""
    k = F.col("o_orderkey")
    radius = lambda i: 5 + (k * 31 + i * 17 + k * i) % 16
    return table(spark, sf_dir, "orders").select(
        k.alias("ring"),
        F.array(*[(F.lit(d) * radius(i)).cast("double") for i, d in enumerate(RING_X)]).alias("xs"),
        F.array(*[(F.lit(d) * radius(i)).cast("double") for i, d in enumerate(RING_Y)]).alias("ys"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress samples per run: elapsed microseconds and percent, in order ``i``."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    run = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = Window.partitionBy("user_id")
    top = F.max("value").over(whole)
    return ev.select(
        F.col("user_id").alias("run"), "event_id", F.row_number().over(run).alias("i"),
        (F.col("us") - F.min("us").over(whole)).alias("elapsed_us"),
        F.when(top > 0, F.max("value").over(run.rowsBetween(Window.unboundedPreceding, 0)) / top * 100.0).otherwise(0.0).alias("percent"),
    )


_RING = "CASE i " + " ".join(f"WHEN {i} THEN {{{i}}}" for i in range(8)) + " END"

SQL = {
    "vertices": """SELECT user_id AS feature_idx, CAST(day(ts) AS INT) % 3 AS part_idx, event_id, ts,
        CAST(37500000 + user_id*200 + (event_id*7919) % 997 AS DOUBLE)/1000000.0 AS lon,
        CAST(55700000 + user_id*100 + (event_id*10473) % 991 AS DOUBLE)/1000000.0 AS lat FROM events""",
    "points": """SELECT feature_idx, part_idx, event_id, lon, lat,
        row_number() OVER (PARTITION BY feature_idx, part_idx ORDER BY ts, event_id) - 1 AS i,
        count(*) OVER (PARTITION BY feature_idx, part_idx) AS n FROM vertices QUALIFY n >= 2""",
    "boxes": "SELECT feature_idx, part_idx, min(lon) lo0, max(lon) lo1, min(lat) la0, max(lat) la1, count(*) n FROM points GROUP BY ALL",
    "ranges": """SELECT feature_idx, part_idx,
        CAST(greatest(0, floor((lo0+180.0)/360.0*1048576 - 0.25)) AS BIGINT) x0,
        CAST(least(1048575, floor((lo1+180.0)/360.0*1048576 + 0.25)) AS BIGINT) x1,
        CAST(greatest(0, floor((1.0-ln(tan(radians(la1))+1.0/cos(radians(la1)))/pi())/2.0*1048576 - 0.25)) AS BIGINT) y0,
        CAST(least(1048575, floor((1.0-ln(tan(radians(la0))+1.0/cos(radians(la0)))/pi())/2.0*1048576 + 0.25)) AS BIGINT) y1
        FROM boxes""",
    "edge_tiles": """SELECT feature_idx, part_idx, 20 AS z, x, y
        FROM (SELECT *, unnest(range(x0, x1+1)) x FROM ranges) a, LATERAL (SELECT unnest(range(a.y0, a.y1+1)) y) b""",
    "missing": "SELECT DISTINCT z, x, y FROM edge_tiles WHERE (x*31 + y*17) % 997 = 0",
    "measurements": """SELECT l_orderkey AS edge, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i,
        CASE WHEN l_returnflag <> 'R' THEN l_quantity*3.0 END AS width_px FROM lineitem""",
    "cache_log": "SELECT user_id AS x, event_id % 7 AS y, CASE event_type WHEN 'error' THEN 2 ELSE 1 END AS status, ts AS updated_at, event_id FROM events",
    "pixels": """SELECT vec_id, vec_id % 25 AS x, vec_id // 25 AS y, p,
        [embedding[p+1], embedding[16+p+1], embedding[32+p+1], embedding[48+p+1]] AS a FROM embeddings, (SELECT unnest(range(16)) p) q""",
    "classes": "SELECT vec_id, x, y, p, CAST(array_position(a, list_max(a)) - 1 AS INT) AS class FROM pixels",
    "ring_points": f"""SELECT o_orderkey AS ring, i,
        ({_RING.format(*RING_X)}) * (5 + (o_orderkey*31 + i*17 + o_orderkey*i) % 16) AS vx,
        ({_RING.format(*RING_Y)}) * (5 + (o_orderkey*31 + i*17 + o_orderkey*i) % 16) AS vy
        FROM orders, (SELECT unnest(range(8)) i) q""",
    "samples": """SELECT user_id AS run, event_id, row_number() OVER r AS i, epoch_us(ts) - min(epoch_us(ts)) OVER w AS elapsed_us,
        CASE WHEN max(value) OVER w > 0 THEN max(value) OVER (r ROWS UNBOUNDED PRECEDING) / max(value) OVER w * 100.0 ELSE 0.0 END AS percent
        FROM events WINDOW w AS (PARTITION BY user_id), r AS (PARTITION BY user_id ORDER BY ts, event_id)""",
}
_NEEDS = {"points": ["vertices"], "boxes": ["points"], "ranges": ["boxes"], "edge_tiles": ["ranges"], "missing": ["edge_tiles"], "classes": ["pixels"]}


def using(*names: str, sql: str) -> str:
    """``sql`` after the fixtures it names, in order of need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    sql = sql.strip()
    return f"WITH RECURSIVE {head},\n{sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {head}\n{sql}"
