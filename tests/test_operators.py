"""Hand-made cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from kerbline.functions import exprs as E
from kerbline.operators import measures, progress, stores, tiles
from kerbline.sources import graph, tile_files


def edges(spark, rows):
    return spark.createDataFrame(rows, "feature_idx long, part_idx int, coords array<struct<lon:double,lat:double>>")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_tile_of_the_origin_and_of_the_edges_of_the_map(spark):
    assert one(spark, E.tile_x(F.lit(0.0), 20)) == 524288.0
    assert round(one(spark, E.tile_y(F.lit(0.0), 20)), 6) == 524288.0
    assert abs(one(spark, E.tile_y(F.lit(90.0), 20))) < 0.01
    got = tiles.edge_tiles(edges(spark, [(1, 0, [(-180.0, 90.0), (-179.9999, 85.0511)])])).agg(F.min("x"), F.min("y")).first()
    assert tuple(got) == (0, 0)
    got = tiles.edge_tiles(edges(spark, [(1, 0, [(180.0, -90.0), (179.9999, -85.0511)])])).agg(F.max("x"), F.max("y")).first()
    assert tuple(got) == (2**20 - 1, 2**20 - 1)


def test_edges_split_into_eligible_and_skipped(spark):
    e = edges(spark, [(1, 0, [(37.5, 55.7), (37.5005, 55.7)]), (2, 0, [(38.5, 55.7), (38.5, 55.7001)])])
    t = tiles.edge_tiles(e)
    gone = t.where("feature_idx = 1").limit(1)
    assert [r["feature_idx"] for r in tiles.eligible_edges(e, t, gone).collect()] == [2]
    assert [r["feature_idx"] for r in tiles.skipped_edges(t, gone).collect()] == [1]
    assert tiles.eligible_edges(e, t, gone.limit(0)).count() == 2
    assert tiles.eligible_edges(e, t.limit(0), t).count() == 2  # an edge that needs no tile stays


def test_no_valid_position_is_an_error(spark):
    with pytest.raises(Exception, match="without a valid position"):
        tiles.bounding_boxes(edges(spark, [(1, 0, [(None, 1.0)])])).collect()


TEXT = """{"type":"FeatureCollection","crs":{"properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}},"features":[
{"type":"Feature","properties":{"a":1},"geometry":{"type":"MultiLineString","coordinates":[[[1,2],[3,4,5]],[[0,0]],[[5,6],[7,8]]]}},
{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}},
{"type":"Feature","properties":{},"geometry":null},
{"type":"Feature","properties":{"b":"x"},"geometry":{"type":"LineString","coordinates":[[9,9],[8,8]]}}]}"""


def test_parts_keep_their_numbers_and_other_geometry_is_skipped(spark):
    texts = spark.createDataFrame([(TEXT,)], "text string")
    got = graph.edges(graph.features(texts)).orderBy("feature_idx", "part_idx").collect()
    assert [(r["feature_idx"], r["part_idx"]) for r in got] == [(0, 0), (0, 2), (3, 0)]
    assert got[0]["coords"][1]["lon"] == 3.0 and got[2]["properties"] == '{"b":"x"}'


def test_reference_systems(spark):
    metres = TEXT.replace("CRS84", "EPSG::3857")
    got = graph.edges(graph.features(spark.createDataFrame([(metres,)], "text string"))).first()
    assert got["coords"][0]["lon"] == pytest.approx(math.degrees(1 / 6378137))
    with pytest.raises(Exception, match="reference system"):
        graph.features(spark.createDataFrame([('{"features":[]}',), (TEXT.replace("CRS84", "EPSG::2154"),)], "text string")).collect()


def test_files_round_trip_and_are_not_overwritten(spark, tmp_path):
    texts = spark.createDataFrame([(TEXT,)], "text string")
    e = graph.edges(graph.features(texts))
    graph.write_features(e, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        graph.write_features(e, str(tmp_path / "out"))


def test_width_update(spark):
    feats = spark.createDataFrame([(1, "abc"), (2, "4.5"), (3, None)], "feature_idx long, Width string")
    none = spark.createDataFrame([(1, None)], "feature_idx long, width_m double")
    assert graph.updated_features(feats, none) is feats
    some = spark.createDataFrame([(3, 1.0), (3, 2.0), (9, 5.0)], "feature_idx long, width_m double")
    got = {r["feature_idx"]: r["Width"] for r in graph.updated_features(feats, some).collect()}
    assert got == {1: None, 2: 4.5, 3: 1.5}


def test_local_tile_files(spark, tmp_path):
    for name in ("5_6.png", "20/5/7.jpg", "20/5_8.jpeg", "19/5_9.jpg", "note.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = tile_files.catalogue(tile_files.listed_files(spark, str(tmp_path)).select("path"))
    assert {(r["x"], r["y"], r["rank"]) for r in found.collect()} == {(5, 6, 6), (5, 7, 1), (5, 8, 5)}
    wanted = spark.createDataFrame([(20, 5, y) for y in (6, 7, 8, 9)], "z int, x long, y long")
    got = {r["y"]: (r["path"], r["status"]) for r in tiles.tile_paths(wanted, found).collect()}
    assert got == {6: ("5_6.png", "direct"), 7: ("20/5/7.jpg", "direct"), 8: ("20/5_8.jpeg", "direct"), 9: ("5_9.jpg", "missing")}


def test_masks_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(20, 1, 1, b"a"), (20, 1, 2, b"b")], "z int, x long, y long, mask binary")
    place = str(tmp_path / "masks")
    tile_files.write_new(rows.limit(1), None, place)
    tile_files.write_new(rows, spark.read.parquet(place), place)
    assert spark.read.parquet(place).count() == 2


def test_unknown_sources(spark):
    with pytest.raises(ValueError):
        tile_files.tile_source("ftp")
    with pytest.raises(ValueError):
        tile_files.tile_source("remote")


def test_cache_age_at_its_limit(spark):
    log = spark.sql("SELECT 1L x, 2 status, TIMESTAMP'2024-01-02 00:00:00' updated_at UNION ALL SELECT 2L, 2, TIMESTAMP'2024-01-01 23:59:59' UNION ALL SELECT 3L, 1, TIMESTAMP'2020-01-01 00:00:00'")
    got = stores.lookup(log, log.select("x").union(spark.sql("SELECT 4L")), ["x"], F.lit("2024-01-03 00:00:00").cast("timestamp")).collect()
    assert {r["x"]: r["state"] for r in got} == {1: "missing", 2: "absent", 3: "ok", 4: "absent"}


def test_narrow_widths(spark):
    def kept(values):
        return one(spark, E.narrow_widths(F.array(*[F.lit(v).cast("double") for v in values]) if values else F.array().cast("array<double>")))

    assert kept([]) == []
    assert kept([5.0, None]) == [5.0]
    assert kept([2.0, 1.0, float("nan")]) == [1.0, 2.0]
    assert kept([1.0, 2.0, 3.0]) == [1.0, 2.0, 3.0]
    assert kept([4.0] * 5) == [4.0] * 5
    assert kept([float(i) for i in range(10)]) == [2.0, 3.0, 4.0, 5.0]


def test_rounding_is_half_even(spark):
    assert one(spark, E.half_even(F.lit(0.125), 2)) == 0.12
    assert one(spark, E.metres(F.lit(43.75), 0.08)) == 3.5


def test_status_texts_and_counts(spark):
    rows = spark.createDataFrame([("no_tiles", None), ("missing_images_or_labels", None), ("ok", 2.0)], "status string, width_m double")
    texts = [r[0] for r in rows.select(measures.status_text(F.col("status"))).collect()]
    assert texts[1:] == ["missing_images_or_labels", "ok"] and texts[0] != "no_tiles"
    assert tuple(measures.status_counts(rows).first()) == (1, 2)


def test_late_samples_are_ignored(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 10.0, 20.0), (1, 3, 5.0, 30.0), (1, 4, 12.0, 20.0), (1, 5, 20.0, 100.0)], "run long, i int, elapsed double, percent double")
    got = {r["i"]: r["eta"] for r in progress.remaining(rows).collect()}
    assert set(got) == {1, 2, 5} and got[1] is None and got[5] == 0.0
    rate = 0.7 * 19 / 10 + 0.3 * 2
    assert got[2] == pytest.approx(80 / rate)


def test_argmax_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, 0, 0, [1.0] * 64)], "vec_id long, x long, y long, logits array<double>")
    assert {r["class"] for r in measures.pixel_classes(rows).collect()} == {0}


SHIFTS = "k string, dx double, dy double, dot double, distance double"


def test_shifts_of_a_cell_are_sent_as_plain_numbers(spark):
    plan = measures.shift_clusters(spark.createDataFrame([], SHIFTS), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(dx" in plan and "collect_list(dy" in plan and "struct" not in plan


def test_each_list_of_a_cell_is_sorted_once_and_without_a_comparator(spark):
    plan = measures.shift_clusters(spark.createDataFrame([], SHIFTS), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") == 3 and "array_sort(" not in plan


def test_shift_clusters_of_odd_rows(spark):
    rows = [
        ("a", 13.0, 1.0, 1.0, 3.0), ("a", 7.0, 5.0, 0.5, None), ("a", 13.0, 1.0, None, 6.0),  # the same shift twice
        ("a", 13.0, 40.0, 1.0, 1.0), ("a", 14.0, 43.0, 1.0, 1.0),  # cells of one
        (None, 1.0, 2.0, 0.8, 5.0),
        ("b", None, 3.0, 0.9, 1.0), ("b", None, 4.0, 0.9, 1.0), ("b", 3.0, None, 0.9, 1.0), ("b", None, None, 0.9, 1.0),
    ]
    shifts = spark.createDataFrame(rows, SHIFTS)
    got = {(r["k"], r["kx"], r["ky"]): r for r in measures.shift_clusters(shifts.repartition(5), "k").collect()}
    assert {c: (r["n"], r["mx"], r["my"], r["std"]) for c, r in got.items()} == {
        ("a", 1, 0): (3, 13.0, 1.0, 0.0),
        ("a", 1, 3): (1, 13.0, 40.0, 0.0),
        ("a", 1, 4): (1, 14.0, 43.0, 0.0),
        (None, 0, 0): (1, 1.0, 2.0, 0.0),
        ("b", None, 0): (2, None, 3.5, None),
        ("b", 0, None): (1, 3.0, None, None),
        ("b", None, None): (1, None, None, None),
    }
    assert got["a", 1, 0]["seed"] == pytest.approx(6 + 0.75 * 5 - 4.5 / 240 - 0.001 * math.hypot(13, 1))
    assert got["b", None, 0]["seed"] is None and got["b", None, 0]["dot"] == 0.9
    some = spark.createDataFrame([("a", x, y, 1.0, 1.0) for x, y in ((0.0, 0.0), (1.0, 4.0), (4.0, 0.0), (5.0, 3.0))], SHIFTS)
    (r,) = measures.shift_clusters(some, "k").collect()
    away = sorted(math.hypot(x - 2.5, y - 1.5) for x, y in ((0, 0), (1, 4), (4, 0), (5, 3)))
    assert (r["mx"], r["my"]) == (2.5, 1.5) and r["std"] == pytest.approx((away[1] + away[2]) / 2)
    assert measures.shift_clusters(shifts.limit(0), "k").count() == 0
