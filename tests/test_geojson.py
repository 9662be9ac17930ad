"""The GeoJSON data source: any cut of a file into ranges gives the features of the whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kerbline.sources import geojson, graph

TRICKY = ['{"type":"Feature"}', "a,{", '\\"}]', "\\", "\\\\", '"features":[', "é日本", "]}", '[{"', "\n"]


def collection(seed, n=40, crs="urn:ogc:def:crs:OGC:1.3:CRS84", indent=None):
    rng = random.Random(seed)
    feats = []
    for k in range(n):
        props = {"k": k, rng.choice(TRICKY): rng.choice(TRICKY) * rng.randint(0, 4), "sub": {"type": "Feature", "features": [{"x": [1, {}]}], "crs": {"properties": {"name": "EPSG::2154"}}}, "list": [{}, {"a": [{}]}]}
        line = [[round(rng.uniform(-1, 1), 6), round(rng.uniform(-1, 1), 6), 7] for _ in range(rng.randint(1, 9))]
        geometry = rng.choice([None, {"type": "LineString", "coordinates": line}, {"type": "MultiLineString", "coordinates": [line, line]}, {"type": "Point", "coordinates": line[0]}])
        feats.append({"type": "Feature", "properties": rng.choice([props, props, {}, None]), "geometry": geometry})
    named = {"crs": {"type": "name", "properties": {"name": crs}}} if crs else {}
    other = {"links": [{"type": "Feature"}, {}], "note": '"features": [{}]', "deep": {"features": [{"a": 1}], "crs": {}}}
    whole = {"type": "FeatureCollection", **other, **named, "features": feats} if seed % 2 else {"features": feats, "after": [{}, {"b": [1]}], **other, **named}
    return json.dumps(whole, ensure_ascii=seed % 3 == 0, indent=indent), feats


@pytest.mark.parametrize("seed", range(6))
def test_any_ranges_give_the_same_features(tmp_path, seed):
    text, feats = collection(seed, indent=seed % 4 or None)
    path = str(tmp_path / "a.geojson")
    (tmp_path / "a.geojson").write_text(text)
    for size in (1 << 20, 997, 211, 64, 17) if seed < 3 else (300,):
        ranges = geojson.planned(path, range_bytes=size)
        got = [(r.first + k, json.loads(x)) for r in ranges for k, x in enumerate(geojson.pieces(r))]
        assert got == list(enumerate(feats)), size
    assert {r.crs for r in ranges} == {"CRS84"}


def test_backslashes_across_a_border(tmp_path):
    for n in range(1, 9):
        text = '{"crs":{"properties":{"name":"EPSG::3857"}},"features":[{"a":"' + "\\" * (2 * n) + '"},{"b":"' + "\\" * (2 * n - 1) + '"}{"}]}'
        (tmp_path / "b.geojson").write_text(text)
        for size in range(1, 40):
            ranges = geojson.planned(str(tmp_path / "b.geojson"), range_bytes=size)
            assert [list(json.loads(x)) for r in ranges for x in geojson.pieces(r)] == [["a"], ["b"]]
            assert ranges[0].crs == "3857"


@pytest.mark.parametrize("text,match", [('{"features":[]}', "reference system"), ('{"crs":null,"features":[]}', "reference system"), ('{"type":"Feature"}', "no collection"), ("", "no collection")])
def test_what_is_no_known_collection_is_an_error(tmp_path, text, match):
    (tmp_path / "c.geojson").write_text(text or " ")
    with pytest.raises(ValueError, match=match):
        geojson.planned(str(tmp_path / "c.geojson"))


def test_many_tasks_read_one_file(spark, tmp_path):
    text, feats = collection(1, 400)
    (tmp_path / "d.geojson").write_text(text)
    df = graph.read_features(spark, str(tmp_path / "d.geojson"), range_bytes=8192)
    assert df.rdd.getNumPartitions() == -(-len(text.encode()) // 8192) > 8
    got = [(r["feature_idx"], json.loads(r["feature"])) for r in df.orderBy("feature_idx").collect()]
    assert got == list(enumerate(feats))
    by_text = graph.edges(graph.features(spark.createDataFrame([(text,)], "text string")))
    by_source = graph.edges(graph.parsed(df))
    assert sorted(map(repr, by_text.drop("properties").collect())) == sorted(map(repr, by_source.drop("properties").collect()))
    plain = spark.read.format("geojson").load(str(tmp_path / "d.geojson"))  # planned in the driver
    assert plain.count() == 400


def test_lines_of_features(spark, tmp_path):
    _, feats = collection(2, 60)
    lines = [("\x1e" if k % 3 == 0 else "") + json.dumps(f) + ("\r" if k % 5 == 0 else "") for k, f in enumerate(feats)]
    (tmp_path / "e.geojsonl").write_text("\n\n".join(lines))
    for size in (1 << 20, 500, 37):
        ranges = geojson.planned(str(tmp_path / "e.geojsonl"), range_bytes=size)
        assert [(r.first + k, json.loads(x)) for r in ranges for k, x in enumerate(geojson.pieces(r))] == list(enumerate(feats))
    (tmp_path / "folder").mkdir()
    for k in range(2):
        (tmp_path / "folder" / f"{k}.geojsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "folder" / "_SUCCESS").write_text("")
    got = graph.read_features(spark, str(tmp_path / "folder"), range_bytes=700).agg(F.min("feature_idx"), F.max("feature_idx"), F.countDistinct("feature_idx")).first()
    assert tuple(got) == (0, 119, 120)


def test_own_output_reads_back(spark, tmp_path):
    text, feats = collection(3, 300, "urn:ogc:def:crs:EPSG::3857")
    (tmp_path / "f.geojson").write_text(text)
    df = graph.read_features(spark, str(tmp_path / "f.geojson"), range_bytes=5000)
    out = str(tmp_path / "g.geojson")
    graph.write_collection(df, out, "3857")
    back = json.loads((tmp_path / "g.geojson").read_text())
    assert back["features"] == feats and back["crs"]["properties"]["name"].endswith("3857")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["f.geojson", "g.geojson"]
    again = graph.read_features(spark, out, range_bytes=3000)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, df.collect()))
    with pytest.raises(Exception, match="exists already"):
        graph.write_collection(df, out, "3857")
    graph.write_collection(df.limit(0), str(tmp_path / "h.geojson"))
    assert json.loads((tmp_path / "h.geojson").read_text())["features"] == []
    assert graph.read_features(spark, str(tmp_path / "h.geojson")).count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).select(F.col("id").alias("feature_idx"), F.when(F.col("id") == 33, F.raise_error(F.lit("stop"))).otherwise(F.lit("{}")).alias("feature"))
    with pytest.raises(Exception, match="stop"):
        rows.write.format("geojson").mode("append").save(str(tmp_path / "i.geojson"))
    assert list(tmp_path.iterdir()) == []


def test_widths_in_texts(spark, tmp_path):
    feats = ['{"type":"Feature","properties":{"Width":"abc","é":[1,2.5]},"geometry":null}', '{"type":"Feature","properties":{"Width":"4.5"},"geometry":{"type":"Point","coordinates":[1,2,3]}}', '{"type":"Feature","properties":null,"geometry":null}', '{"type":"Feature","geometry":null}']
    texts = spark.createDataFrame(list(enumerate(feats)), "feature_idx long, feature string")
    none = spark.createDataFrame([(1, None)], "feature_idx long, width_m double")
    assert [r["feature"] for r in graph.updated_texts(texts, none).orderBy("feature_idx").collect()] == feats
    some = spark.createDataFrame([(2, 1.0), (2, 2.0), (9, 5.0)], "feature_idx long, width_m double")
    got = [json.loads(r["feature"]) for r in graph.updated_texts(texts, some).orderBy("feature_idx").collect()]
    assert [f["properties"]["Width"] for f in got] == [None, 4.5, 1.5, None]
    assert got[0]["properties"]["é"] == [1, 2.5] and got[1]["geometry"]["coordinates"] == [1, 2, 3]
