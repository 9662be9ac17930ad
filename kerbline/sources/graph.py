"""Path networks as GeoJSON: files of any size by the data source, texts by JSON functions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import geojson
from .shared import kept

_KNOWN = {"": None, "4326": "degrees", "CRS84": "degrees", "3857": "metres"}
_POINTS = "array<array<double>>"


def read_features(spark: SparkSession, path: str, range_bytes: int = geojson.RANGE_BYTES) -> DataFrame:
    """``crs, feature_idx, feature``: the features of all GeoJSON collections and
    newline-delimited files at a path, as texts, numbered from 0.

    Tasks read ranges of bytes, so one large file is the work of many. The files are planned
    now and mustn't change before they are read.
    """
    spark.dataSource.register(geojson.GeoJson)
    ranges = geojson.planned(path, spark, range_bytes)
    return spark.read.format("geojson").option("ranges", json.dumps([asdict(r) for r in ranges])).load(path)


def parsed(feats: DataFrame) -> DataFrame:
    """``crs, feature_idx, geometry, properties`` of feature texts."""
    shape = "struct<properties:string,geometry:struct<type:string,coordinates:string>>"
    return feats.select("crs", "feature_idx", F.from_json("feature", shape).alias("f")).select("crs", "feature_idx", "f.geometry", "f.properties")


def write_collection(feats: DataFrame, path: str, crs: str = "CRS84") -> None:
    """One GeoJSON file of the texts ``feature``, in the order of ``feature_idx``; it must not
    exist already."""
    feats.sparkSession.dataSource.register(geojson.GeoJson)
    feats.select("feature_idx", "feature").orderBy("feature_idx").write.format("geojson").mode("append").option("crs", crs).save(path)


def _with_width(field: str):
    def number(value) -> float | None:
        if isinstance(value, bool) or not isinstance(value, (int, float, str)):
            return None
        try:
            return float(value)
        except ValueError:
            return None

    def one(text: str, new: float | None) -> str:
        feature = json.loads(text)
        props = feature.get("properties") or {}
        props[field] = number(props.get(field)) if new is None else new
        feature["properties"] = props
        return json.dumps(feature, ensure_ascii=False, separators=(",", ":"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [one(t, w) for t, w in zip(batch.column("feature").to_pylist(), batch.column("new_width").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("feature_idx"), pa.array(texts, pa.string())], names=["feature_idx", "feature"])

    return run


def updated_texts(feats: DataFrame, widths: DataFrame, field: str = "Width") -> DataFrame:
    """``feature_idx, feature`` with the median width of each feature's parts, by the rules of
    ``updated_features``; geometry of any kind and other properties stay."""
    per = kept(feature_widths(widths), "graph-widths")
    if per.isEmpty():
        return feats.select("feature_idx", "feature")
    return feats.select("feature_idx", "feature").join(per, "feature_idx", "left").mapInArrow(_with_width(field), "feature_idx long, feature string")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole GeoJSON files, a row each, in a column ``text``."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def features(texts: DataFrame) -> DataFrame:
    """Features of FeatureCollections with their place, geometry and properties.

    A collection must name its reference system: 4326, CRS84 or 3857; others are an error.
    """
    shape = "struct<crs:struct<properties:struct<name:string>>,features:array<struct<properties:string,geometry:struct<type:string,coordinates:string>>>>"
    parsed = texts.select(F.from_json("text", shape).alias("g"))
    name = F.coalesce(F.regexp_extract(F.col("g.crs.properties.name"), r"(4326|3857|CRS84)$", 1), F.lit(""))
    checked = F.when(name == "", F.raise_error(F.lit("missing or unknown reference system"))).otherwise(name)
    return parsed.select(checked.alias("crs"), F.posexplode("g.features").alias("feature_idx", "f")).select("crs", F.col("feature_idx").cast("long"), "f.geometry", "f.properties")


def edges(feats: DataFrame) -> DataFrame:
    """Parts of lines with at least two vertices; parts keep their number, others are skipped."""
    kind = F.col("geometry.type")
    one = F.array(F.from_json("geometry.coordinates", _POINTS))
    parts = F.when(kind == "LineString", one).when(kind == "MultiLineString", F.from_json("geometry.coordinates", f"array<{_POINTS}>"))
    exploded = feats.withColumn("parts", parts).where("parts IS NOT NULL").select("crs", "feature_idx", "properties", F.posexplode("parts").alias("part_idx", "points"))
    radius = 6378137.0
    lon = lambda p: F.when(F.col("crs") == "3857", F.degrees(p[0] / radius)).otherwise(p[0])
    lat = lambda p: F.when(F.col("crs") == "3857", F.degrees(F.atan(F.sinh(p[1] / radius)))).otherwise(p[1])
    coords = F.transform("points", lambda p: F.struct(lon(p).alias("lon"), lat(p).alias("lat")))
    return exploded.where(F.size("points") >= 2).select("feature_idx", "part_idx", coords.alias("coords"), "properties")


def feature_text(edges_: DataFrame, properties: str = "properties") -> DataFrame:
    """One GeoJSON feature a row; a feature of several parts is a MultiLineString."""
    points = F.transform("coords", lambda p: F.array(p["lon"], p["lat"]))
    parts = edges_.select("feature_idx", F.struct("part_idx", points.alias("points")).alias("part"), F.col(properties).alias("properties"))
    grouped = parts.groupBy("feature_idx").agg(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["points"]).alias("parts"), F.first("properties", ignorenulls=True).alias("properties"))
    multi = F.size("parts") > 1
    geometry = F.concat(F.lit('{"type":"'), F.when(multi, "MultiLineString").otherwise("LineString"), F.lit('","coordinates":'), F.when(multi, F.to_json("parts")).otherwise(F.to_json(F.get("parts", F.lit(0)))), F.lit("}"))
    text = F.concat(F.lit('{"type":"Feature","properties":'), F.coalesce("properties", F.lit("{}")), F.lit(',"geometry":'), geometry, F.lit("}"))
    return grouped.select("feature_idx", text.alias("feature"))


def write_features(edges_: DataFrame, path: str) -> None:
    """Newline-delimited features, in parallel parts; the place must not exist already, so
    a source is never overwritten while it is read."""
    feature_text(edges_).select("feature").write.mode("errorifexists").text(path)


def feature_widths(widths: DataFrame) -> DataFrame:
    """``feature_idx, new_width``: the median of the widths that are known, in centimetres."""
    return widths.where("width_m IS NOT NULL").groupBy("feature_idx").agg((F.rint(F.median("width_m") * 100) / 100).alias("new_width"))


def updated_features(feats: DataFrame, widths: DataFrame, field: str = "Width") -> DataFrame:
    """``feats`` with the median width of their parts in ``field``.

    ``widths`` has (feature_idx, width_m). If no width is known, the table stays as it is
    and no column is added; else features without one keep their old value as a number,
    or null where it is none. Widths of unknown features are ignored.
    """
    per = kept(feature_widths(widths), "graph-widths")  # whether it is empty mustn't cost the plan twice
    if per.isEmpty():
        return feats
    old = F.expr(f"try_cast(`{field}` AS DOUBLE)") if field in feats.columns else F.lit(None).cast("double")
    return feats.withColumn(field, old).join(per, "feature_idx", "left").withColumn(field, F.coalesce("new_width", field)).drop("new_width")
