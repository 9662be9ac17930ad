"""Whole runs over a made-up network: strips of known width, missing tiles, and runs that end."""

import json
import math

import numpy as np
import pytest
import stand_ins

from kerbline.plans import run
from kerbline.sources import graph

SIZE, STRIP, N = 64, 20, 5
X, Y = 600_000, 500_000
IMAGE = "z int, x long, y long, content binary"


def place(x, y):
    return [x / 2**20 * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / 2**20))))]


def network(tmp_path, n=N):
    feats = [{"type": "Feature", "properties": {"k": k, "Width": "old"}, "geometry": {"type": "LineString", "coordinates": [place(X + 0.2, Y + 3 * k + 0.5), place(X + 1.8, Y + 3 * k + 0.5)]}} for k in range(n)]
    feats += [{"type": "Feature", "properties": {"k": n}, "geometry": {"type": "Point", "coordinates": place(X, Y)}}]
    text = {"type": "FeatureCollection", "crs": {"properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}, "features": feats}
    (tmp_path / "paths.geojson").write_text(json.dumps(text))
    return str(tmp_path / "paths.geojson")


def strip():
    logits = np.zeros((4, SIZE, SIZE), "<f4")
    middle = slice((SIZE - STRIP) // 2, (SIZE + STRIP) // 2)
    logits[3] = 1
    logits[0, middle] = 2
    return logits.tobytes()


def images(spark, n=N, gone=(), bad=()):
    rows = [(20, X + dx, Y + 3 * k, b"bad" if (dx, k) in bad else strip()) for k in range(n) for dx in range(-1, 3) if (dx, k) not in gone]
    return spark.createDataFrame(rows, IMAGE)


def measure(spark, tmp_path, tiles, output, counted=None, listen=None, batch=50):
    network_ = stand_ins.Together(3, counted if counted is not None else spark.sparkContext.accumulator(0))
    return run.measure_network(spark, network(tmp_path), tiles, network_, str(tmp_path / "work"), str(tmp_path / output), size=SIZE, edges_per_batch=batch, listen=listen)


def widths(tmp_path, name):
    return {f["properties"]["k"]: f["properties"].get("Width") for f in json.loads((tmp_path / name).read_text())["features"]}


def test_a_run_from_file_to_file(spark, tmp_path):
    folder, events = tmp_path / "tiles", []
    for k in range(N):
        for dx in range(-1, 3):
            file = folder / (f"{X + dx}_{Y + 3 * k}.png" if k % 2 else f"20/{X + dx}/{Y + 3 * k}.jpg")
            file.parent.mkdir(parents=True, exist_ok=True)
            if (dx, k) != (0, 2):
                file.write_bytes(strip())
    (folder / f"{X}_{Y}.jpeg").write_bytes(b"not looked at: a later candidate")
    report = measure(spark, tmp_path, str(folder), "out.geojson", listen=events.append)
    assert (report.edges, report.eligible, report.resumed, report.computed, report.calculated, report.failed) == (N, N - 1, 0, N - 1, N - 1, 0)
    got = widths(tmp_path, "out.geojson")
    assert got[2] is None and got[N] is None  # no tile; no line
    assert all(got[k] == pytest.approx((STRIP - 1) * 0.08, abs=0.01) for k in range(N) if k != 2)
    back = graph.edges(graph.parsed(graph.read_features(spark, str(tmp_path / "out.geojson"))))
    assert back.count() == N
    percents = [e["percent"] for e in events]
    assert percents == sorted(percents) and percents[0] == 0 and percents[-1] == 100
    assert list(dict.fromkeys(e["stage"] for e in events)) == ["load_graph", "tile_indices", "find_tiles", "prepare_tiles", "predict_masks", "calculate_widths", "update_graph"]


class Ended(Exception):
    pass


def test_a_run_that_ended_is_taken_up(spark, tmp_path):
    seen = []

    def end(event):
        seen.append(event)
        if event["stage"] == "calculate_widths" and 0 < event["current"] < event["total"]:
            raise Ended

    with pytest.raises(Ended):
        measure(spark, tmp_path, images(spark, bad={(1, 1)}), "out.geojson", listen=end, batch=3)
    done = seen[-1]["current"]
    assert 0 < done < N and not (tmp_path / "out.geojson").exists()
    first = spark.read.parquet(str(tmp_path / "work" / "widths")).collect()
    assert len(first) == done

    calls = spark.sparkContext.accumulator(0)
    report = measure(spark, tmp_path, images(spark), "out.geojson", counted=calls)
    again = sum(r["status"] == run.AGAIN for r in first)  # for want of the tile that failed
    assert (report.resumed, report.computed, report.calculated) == (done - again, N - done + again, N)
    assert calls.value == 1  # no tile is predicted again but the one that failed
    rows = spark.read.parquet(report.results)
    assert rows.count() == N + again and rows.select("feature_idx", "part_idx").distinct().count() == N  # no edge is computed again
    assert all(widths(tmp_path, "out.geojson")[k] == pytest.approx((STRIP - 1) * 0.08, abs=0.01) for k in range(N))


def test_no_tile_at_all(spark, tmp_path):
    report = measure(spark, tmp_path, images(spark).limit(0), "out.geojson")
    assert (report.eligible, report.computed, report.calculated) == (0, 0, 0)
    assert widths(tmp_path, "out.geojson") == {k: "old" for k in range(N)} | {N: None}
    assert "Width" not in json.loads((tmp_path / "out.geojson").read_text())["features"][N]["properties"]


def test_another_model_has_results_of_its_own(spark, tmp_path):
    path = network(tmp_path)
    keys = {run.key_of(spark, path, *x) for x in (("a", "local", 20, 0.25, 64, run.WidthParams()), ("b", "local", 20, 0.25, 64, run.WidthParams()), ("a", "remote", 20, 0.25, 64, run.WidthParams()), ("a", "local", 20, 0.25, 64, run.WidthParams(step=9.0)))}
    assert len(keys) == 4


def test_an_edge_off_its_mosaic_is_finished_too(spark, tmp_path):
    edges = spark.createDataFrame([(1, 0, "m", [500.0, 500.0, 600.0, 600.0]), (2, 0, "m", [1.0, 32.0, 60.0, 32.0])], "feature_idx long, part_idx int, mosaic string, line array<double>")
    cells = spark.createDataFrame([("m", 5, 5)], "mosaic string, x long, y long")
    mask = np.frombuffer(strip(), "<f4").reshape(4, SIZE, SIZE).argmax(0).astype(np.uint8).tobytes()
    masks = spark.createDataFrame([(20, 5, 5, mask)], "z int, x long, y long, mask binary")
    got = {r["feature_idx"]: r["status"] for r in run.width_batch(edges, edges, cells, masks, 20, run.WidthParams(), SIZE).collect()}
    assert got == {1: run.NO_ROW, 2: "ok"}
